"""The n-gram join and connected components against brute force."""

import random
import re

import pytest

from lodestone.llm import ngram_join
from lodestone.llm.common import components


def classes(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows):
    sets = []
    for _, text in rows:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = classes(range(len(rows)), pairs)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], k), k)
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    return sorted((k, len(sets[i]), low[root[i]], links[i]) for i, (k, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, n = [], 0
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6, 30 if g == 3 else 3])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
            if rng.random() < 0.3:
                text = passage + "\n" + text
            rows.append((n, text.upper() if rng.random() < 0.1 else text.replace(" ", "\t", 2)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "É a b"), (n + 4, "é a b"), (n + 5, rows[0][1]), (n + 5, rows[0][1]), (n + 6, "one two"), (n + 6, passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block", "often", "spare"), [(1, 10**6, 2, 12), (2, 300, 3, 8), (3, 2000, 1, 4)])
def test_against_brute_force(spark, monkeypatch, seed, block, often, spare):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SPARE", spare)
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, component int, size int")
    got = ngram_join.similar_documents(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == brute(rows)


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_documents(none).collect() == []
    got = ngram_join.similar_documents(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((r["component_id"] or -1, r["n_links"]) for r in got) == [(-1, 0), (4, 2), (4, 2), (4, 2)]


def test_rows_without_ids_link_and_bridge(spark):
    """A near copy without an id links; it ties two documents that only it is near to; very long texts are whole."""
    w = [f"w{i}" for i in range(44)]
    one, two = " ".join(w), " ".join(w[:-2] + ["x", "y"])
    far, mid, near = " ".join(w[:38] + ["p"] * 1), " ".join(w), " ".join(w[4:] + ["q"])
    long = " ".join(f"v{i % 7001}_{i % 13}" for i in range(60_000))
    rows = [(1, one), (None, two), (9, far), (None, mid), (8, near), (None, "lone text of its own that has no copy at all"), (20, long), (None, long + " end"), (None, long + " fin")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_documents(df).collect()
    want = brute([(1000 + k if i is None else i, t) for k, (i, t) in enumerate(rows)])
    assert sorted(r["n_links"] for r in got) == sorted(x[3] for x in want)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, _, c, _ in want if i < 1000}
    assert sorted(r["component_id"] or 0 for r in got if r["doc_id"] is None) == sorted(c if c < 1000 else 0 for i, _, c, _ in want if i >= 1000)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300) if i % 37] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5000, 5000 + k) for k in range(200)]
    want = classes({x for e in links for x in e}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items() if x in got}
    assert set(want) - set(got) == {x for a, b in links if a == b for x in (a,) if sum(x in e for e in links if e[0] != e[1]) == 0}
