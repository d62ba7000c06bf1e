"""Retrieval, linking, containment, walks, noise, order statistics, paged sources and ledgers against plain versions."""

import hashlib
import itertools
import json
import math
import random
import statistics

import pytest
from lodestone.operators import analytics, audit, containment, ledger, linking, noise, topk, traversal
from lodestone.plans.graph import Edges, Graph, Nodes
from lodestone.sources import paged, tables, workbooks
from lodestone.streaming import ledger as stream
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- top-k --------------------------------------------------------------------------------------------------------
def texts(n, seed, words=60, longest=40):
    """Texts of words whose frequencies fall off, so that some are very common."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, longest))) for _ in range(n)]


def plain_bm25(passages, questions):
    cut = {p: [w for w in t.lower().split() if len(w) > 1] if t is not None else None for p, t in passages}
    known = {p: t for p, t in cut.items() if t is not None}
    mean = sum(map(len, known.values())) / len(known)
    df = {}
    for t in known.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(len(cut) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = topk.EPSILON * sum(idf.values()) / len(idf)
    out = {}
    for q, text in questions:
        for p, t in known.items():
            score, met = 0.0, False
            for w in text.lower().split():
                tf = t.count(w)
                if tf:
                    met = True
                    score += (floor if idf[w] < 0 else idf[w]) * tf * (topk.K1 + 1) / (tf + topk.K1 * (1 - topk.B + topk.B * len(t) / mean))
            if met:
                out.setdefault(q, {})[p] = score
    return out


def first(scores, k):
    return sorted(scores.items(), key=lambda e: (-round(e[1], topk.DIGITS), e[0]))[:k]


def test_lexical_top_prunes_and_stays_exact(spark):
    passages = list(enumerate(texts(1500, 1))) + [(5000, None), (5001, ""), (5002, texts(1, 9)[0])] + [(6000 + i, "w1 w1 w2 w3") for i in range(30)]
    questions = [(f"q{i}", t) for i, t in enumerate(texts(12, 2, longest=8)) if t] + [("empty", ""), ("rare", "w1 w2 w59 w58"), ("unknown", "zz yy")]
    p = spark.createDataFrame(passages, "pid long, text string").repartition(3)
    q = spark.createDataFrame([*questions, (None, "w1")], "qid string, text string")
    want = {qid: [(pid, pytest.approx(s)) for pid, s in first(scores, 7)] for qid, scores in plain_bm25(passages, questions).items()}
    for prune in (True, False):
        got = {}
        for r in sorted(topk.lexical_top(p, q, 7, prune=prune).collect(), key=lambda r: (r["qid"], r["rank"])):
            got.setdefault(r["qid"], []).append((r["pid"], r["score"]))
        assert got == want
    few, whole = topk.lexical_top(p, q, 7, counts=True).first()
    assert few < 0.8 * whole and topk.lexical_top(p, q, 7, prune=False, counts=True).first() == (whole, whole)
    assert topk.lexical_top(p.limit(0), q, 7).collect() == [] == topk.lexical_top(p, q.limit(0), 7).collect()


def test_dense_and_hybrid_top(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)  # several blocks of questions
    monkeypatch.setattr(topk, "SCORES", 64)
    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]
    passages = [(i, t, vec()) for i, t in enumerate(texts(300, 4, words=20))] + [(900, "w1", None), (901, "w1 w2", [1.0]), (902, None, vec())]
    questions = [(i, t or "w1", vec()) for i, t in enumerate(texts(9, 5, words=20))]
    p, q = spark.createDataFrame(passages, "pid long, text string, vector array<float>"), spark.createDataFrame(questions, "qid long, text string, vector array<float>")
    fine = [x for x in passages if x[2] is not None and len(x[2]) == 4]
    dense = {qi: {pi: sum(a * b for a, b in zip(v, qv)) for pi, _, v in fine} for qi, _, qv in questions}
    lex = plain_bm25([(pi, t) for pi, t, _ in passages], [(qi, t) for qi, t, _ in questions])
    scale = lambda s: {k: (v - min(s.values())) / (max(s.values()) - min(s.values())) if max(s.values()) > min(s.values()) else 0.0 for k, v in s.items()}
    hybrid = {}
    for qi in dense:
        d, x = scale(dense[qi]), scale({pi: lex.get(qi, {}).get(pi, 0.0) for pi in dense[qi]})
        hybrid[qi] = {pi: 0.3 * d[pi] + 0.7 * x[pi] for pi in d}
    for want, df in ((dense, topk.dense_top(p, q, 5)), (hybrid, topk.hybrid_top(p, q, 5, 0.3))):
        got = {}
        for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
            got.setdefault(r["qid"], []).append((r["pid"], pytest.approx(r["score"])))
        assert got == {k: first(v, 5) for k, v in want.items()}
    assert "Cartesian" not in plan_of(topk.hybrid_top(p, q, 5)) and "NestedLoop" not in plan_of(topk.hybrid_top(p, q, 5))


def test_sweep_is_as_separate_indexes(spark):
    rng = random.Random(6)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    passages = [(i, t, vec(), 0.0 if i < 100 else rng.choice([0.5, 1.0])) for i, t in enumerate(texts(160, 7, words=25))]
    questions = [(i, t or "w1", vec()) for i, t in enumerate(texts(5, 8, words=25))]
    p, q = spark.createDataFrame(passages, "pid long, text string, vector array<double>, level double"), spark.createDataFrame(questions, "qid long, text string, vector array<double>")
    got = {}
    for r in topk.sweep_top(p, q, 6, [0.0, 0.5, 1.0]).collect():
        got.setdefault((r["system"], r["share"], r["qid"]), []).append((r["rank"], r["pid"], pytest.approx(r["score"])))
    for share in (0.0, 0.5, 1.0):
        own = p.where(F.col("level") <= share)
        for system, df in (("lexical", topk.lexical_top(own, q, 6)), ("vector", topk.dense_top(own, q, 6)), ("hybrid", topk.hybrid_top(own, q, 6))):
            alone = {}
            for r in df.collect():
                alone.setdefault(r["qid"], []).append((r["rank"], r["pid"], r["score"]))
            for qid, rows in alone.items():
                assert sorted(got.pop((system, share, qid)), key=lambda x: x[0]) == sorted(rows)
    assert not got


# -- names in texts -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("small", [100_000, 0])
def test_names_in_texts(spark, monkeypatch, small):
    monkeypatch.setattr(tables, "SMALL", small)
    monkeypatch.setattr(linking, "HOT", 0.02)  # where the trie is not sent to all, most first tokens are dealt over salts
    rng = random.Random(8)
    vocabulary = "a b c d e f".split()
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "a-b; c_d e.f")]
    names = sorted({" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(40)} | {"c d e", "a", "none here", "one two three four five six"})
    df, dictionary = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(n,) for n in [*names, names[0], None, ""]], "alias string")
    want = set()
    for i, text in rows:
        t = [w for w in "".join(c if c.isalnum() else " " for c in text or "").split()]
        want |= {(i, at + 1, n, " ".join(t[at : at + n])) for at in range(len(t)) for n in range(1, 6) if at + n <= len(t) and " ".join(t[at : at + n]) in names}
    assert {tuple(r) for r in linking.names_in(df, ["id"], dictionary).collect()} == want
    longest = {}
    for i, at, n, key in want:
        longest[i, at] = max(longest.get((i, at), (0, "")), (n, key))
    assert {tuple(r) for r in linking.names_in(df, ["id"], dictionary, only_longest=True).collect()} == {(*k, *v) for k, v in longest.items()}
    assert linking.names_in(df.limit(0), ["id"], dictionary).collect() == [] == linking.names_in(df, ["id"], dictionary.limit(0)).collect()


def test_links_and_refinement(spark):
    q = spark.createDataFrame([(1, "Which drugs for EGFR with the variant L858R?"), (2, "EGFR and Lung Cancer, lung"), (3, "a mutation of nothing known"), (4, "variant L858R of EGFR")], "qid int, text string")
    names = spark.createDataFrame([("EGFR", "g1", "Gene"), ("L858R", "v1", "Variant"), ("L8", "v2", "Variant"), ("lung cancer", "d1", "Disease"), ("lung", "d2", "Disease"), ("of", "x", "Gene")], "alias string, node string, label string")
    links = linking.mentions(q, names)
    got = {}
    for r in links.collect():
        got.setdefault(r["qid"], []).append((r["place"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {1: ["g1", "v1"], 2: ["d1", "g1", "d2"], 4: ["v1", "g1"]}
    variants = spark.createDataFrame([("g1", "EGFR", "v1", "L858R"), ("g1", "EGFR", "v2", "L8"), ("g1", "EGFR", "v3", "T790M")], "gene string, gene_name string, node string, name string")
    refined = linking.refined(q, links, variants, ("variant", "mutation"), most=3)
    assert {(r["qid"], r["node"], r["place"]) for r in refined.collect() if r["qid"] != 2} == {(1, "g1", 1), (1, "v1", 2), (1, "v2", 3), (4, "g1", 1)}


# -- containment --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("small", [100_000, 0])
def test_contained(spark, monkeypatch, small):
    monkeypatch.setattr(tables, "SMALL", small)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abc", k=n))
    needles, hay = {word(rng.randint(1, 5)) for _ in range(60)} | {"zz", "", "abcabcabc"}, {word(rng.randint(0, 12)) for _ in range(200)} | {"x", "𝔘é𝔘"}
    needles |= {"é𝔘", "𝔘"}
    n, h = spark.createDataFrame([(x,) for x in [*needles, None]], "needle string"), spark.createDataFrame([(x,) for x in [*hay, None]], "text string")
    df = containment.contained(n, h)
    assert {tuple(r) for r in df.collect()} == {(a, b) for a in needles for b in hay if a and a in b}
    assert "Cartesian" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_fitting(spark):
    synonyms = {"nsclc": ["lung", "non small cell"], "aml": ["leukemia"]}
    left, right = ["NSCLC", " stage iv nsclc ", "breast", "solid tumor", "", None, "acute"], ["Lung cancer", "cell", "breast cancer", "solid tumor", "", "leukemia", "small"]

    def fits(a, b):
        a, b = (a or "").strip().lower(), (b or "").strip().lower()
        if not a or not b:
            return False
        if a in b or b in a or "solid tumor" in (a, b):
            return True
        return any(w in b or b in w for w in synonyms.get(a, [])) or any(k in a and w in b for k, words in synonyms.items() for w in words)

    got = containment.fitting(spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(x,) for x in right], "y string"), synonyms)
    assert {tuple(r) for r in got.collect()} == {(a.strip().lower(), b.strip().lower()) for a in left for b in right if fits(a, b)}


def test_audit_lowers_off_tumour(spark):
    cases = spark.createDataFrame([(1, "lung", "a+b/c"), (2, "lung", "a"), (3, "lung", "zz"), (4, "skin", "a + zz"), (5, "lung", "a")], "case_id int, tumour string, expected string")
    rows = [(1, "S", "L1", "lung cancer", "A1"), (1, "T", "L2", "lung", "xb"), (2, "S", "L1", "skin", "aa"), (3, "S", "L1", "lung", "a"), (4, "S", "L3", "skin", "A"), (5, "S", "L1", "skin", "a"), (5, "T", "L4", "lung", "a")]
    got = audit.audited(cases, spark.createDataFrame(rows, "case_id int, source string, level string, disease string, drug string"), {})
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "PARTIAL", "A,B", "S+T", "L1/L2", True), (2, "PARTIAL", "A", "S", "L1", True), (3, "GAP", "", "S", "L1", False),
        (4, "PARTIAL", "A", "S", "L3", False), (5, "COVERED", "A", "S+T", "L1/L4", False),
    ]


# -- walks --------------------------------------------------------------------------------------------------------
def test_some_path_is_exact(spark):
    rng = random.Random(10)
    steps = [("R", False), ("S", False), ("S", True), ("R", True), ("R", False), ("S", False)]
    for seed in range(3):
        links = {(f"a{rng.randrange(4)}", "R", f"b{rng.randrange(5)}") for _ in range(9)} | {(f"b{rng.randrange(5)}", "S", f"c{rng.randrange(5)}") for _ in range(8)}
        near = lambda n, rel, back: [s if back else t for s, r, t in links if r == rel and (t if back else s) == n]  # noqa: B023, E731

        def walk(path, left):
            if not left:
                return True
            return any(walk([*path, n], left[1:]) for n in near(path[-1], *left[0]) if n not in path)  # noqa: B023

        anchors = [f"a{i}" for i in range(5)]
        start = spark.createDataFrame([(a, a) for a in anchors], "anchor string, node string")
        edges = spark.createDataFrame(list(links), "src string, rel string, dst string")
        got = {r["anchor"]: r["path"] for r in traversal.some_path(start, edges, steps, most=1, grow=2).collect()}
        assert set(got) == set(anchors)
        for a in anchors:
            assert (got[a] is not None) == walk([a], steps)
            if got[a]:
                assert len(got[a]) == 7 == len(set(got[a])) and got[a][0] == a
                assert all(y in near(x, *s) for x, y, s in zip(got[a], got[a][1:], steps))


def test_relationships_are_used_once(spark):
    nodes = lambda *ids: Nodes(spark.createDataFrame([(i,) for i in ids], "id int"), "id")
    links = spark.createDataFrame([(1, 10, "x"), (1, 10, "y"), (1, 11, "x"), (2, 11, None)], "src int, dst int, k string")
    g = Graph({"A": nodes(1, 2), "B": nodes(10, 11)}, {"R": Edges("A", "B", links), "T": Edges("B", "A", spark.createDataFrame([(10, 1), (11, 1)], "src int, dst int"))})
    there = g.match("a", "A").hop("a", "R", "b").hop("b", "R", "c", back=True)
    assert sorted(tuple(r) for r in there.select(a="a__id", b="b__id", c="c__id").collect()) == [(1, 10, 1), (1, 10, 1), (1, 11, 2), (2, 11, 1)]
    again = g.match("a", "A").hop("a", "R", "b").again().hop("b", "R", "c", back=True)
    assert again.df.count() == 4 + 4  # each relationship once more
    closed = g.match("a", "A").hop("a", "R", "b").hop("b", "T", "a")
    assert sorted(tuple(r) for r in closed.select(a="a__id", b="b__id").collect()) == [(1, 10), (1, 10), (1, 11)]
    with pytest.raises(ValueError):
        g.match("a", "A").hop("a", "R", "b").hop("b", "T", "b")


# -- noise --------------------------------------------------------------------------------------------------------
def test_false_edges(spark):
    rng = random.Random(11)
    truth = {("K", f"s{rng.randrange(12)}", f"t{rng.randrange(30):02}") for _ in range(90)} | {("L", "s1", "u1"), ("L", "s2", "u2"), ("L", "s3", "u1"), ("L", "s3", "u2")}
    got = noise.false_edges(spark.createDataFrame(list(truth), "rel string, src string, dst string"), 1.5).collect()
    pool = {r: sorted({d for k, _, d in truth if k == r}) for r in "KL"}
    want = []
    for rel, src in {(r, s) for r, s, _ in truth}:
        own, targets = {d for r, s, d in truth if (r, s) == (rel, src)}, pool[rel]
        need, drawn = min(round(1.5 * len(own)), len(targets) - len(own)), []
        for j in itertools.count():
            if len(drawn) >= need:
                break
            d = targets[int(hashlib.md5(f"{src}|{j}".encode()).hexdigest()[:8], 16) % len(targets)]
            if d not in own and d not in drawn:
                drawn.append(d)
        want += [(rel, src, d, n, len(own)) for n, d in enumerate(drawn)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 60


def test_reach_at_all_shares_in_one_walk(spark):
    rng = random.Random(12)
    edges = {rel: {(f"{rel}{rng.randrange(6)}", f"{nxt}{rng.randrange(6)}"): rng.choice([0.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(14)} for rel, nxt in (("a", "b"), ("b", "c"))}
    frames = {r: spark.createDataFrame([(s, d, x) for (s, d), x in e.items()], "src string, dst string, level double") for r, e in edges.items()}
    starts = spark.createDataFrame([(f"a{i}", f"a{i}") for i in range(6)], "start string, node string")
    got = {(r["start"], r["node"]): r["level"] for r in noise.reached_by_share(starts, [("a", ">"), ("b", ">")], frames).collect()}
    for share in (0.0, 0.25, 0.5, 1.0):
        there = {(s, t) for (s, m), x in edges["a"].items() for (m2, t), y in edges["b"].items() if m == m2 and max(x, y) <= share}
        assert {k for k, v in got.items() if v <= share} == there


# -- order statistics and profiles --------------------------------------------------------------------------------
def test_quantiles_and_profiles(spark):
    rng = random.Random(13)
    rows = [(rng.choice("ab"), rng.choice([None, *range(20)])) for _ in range(400)] + [("c", 5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: (r["q"], r["m"]) for r in analytics.quantiles(df, "v", {"q": 0.3, "m": 0.5}, ["g"]).collect()}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g and v is not None)
        at = 0.3 * (len(own) - 1)
        want = own[int(at)] + (own[min(int(at) + 1, len(own) - 1)] - own[int(at)]) * (at - int(at))
        assert got[g] == (pytest.approx(want), statistics.median(own))
    assert "d" not in got
    profile = {r["column"]: (r["n"], r["nulls"], r["values"]) for r in analytics.column_profile(df, ["g", "v"]).collect()}
    assert profile == {"g": (402, 0, 4), "v": (402, sum(v is None for _, v in rows), len({v for _, v in rows} - {None}))}
    assert "Expand" not in plan_of(analytics.column_profile(df, ["g", "v"]))


# -- sources ------------------------------------------------------------------------------------------------------
def play(folder, pages):
    for term, chain in pages.items():
        for i, items in enumerate(chain):
            at = folder / f"term={term}" / f"token={'first' if i == 0 else f'k{i}'}"
            at.mkdir(parents=True)
            (at / "part-0").write_text(json.dumps({"studies": items} | ({"nextPageToken": f"k{i + 1}"} if i + 1 < len(chain) else {})))


def test_paged_source(spark, tmp_path):
    play(tmp_path, {"x": [[{"id": 1}, {"id": 2}], [{"id": 3}]], "y": [[{"id": 4}], [], [{"id": 5}]], "z": [[]]})
    df = paged.paged(spark, str(tmp_path), ["x", "y", "z"])
    assert df.rdd.getNumPartitions() == 3
    want = [("x", "", 1), ("x", "", 2), ("x", "k1", 3), ("y", "", 4)]  # an empty page ends its chain
    assert sorted((r["term"], r["pageToken"], json.loads(r["item"])["id"]) for r in df.collect()) == want
    with pytest.raises(Exception, match="none"):
        paged.paged(spark, str(tmp_path), ["none"], pause="0").collect()
    assert paged.paged(spark, str(tmp_path), ["none", "x"], pause="0", lenient="true").count() == 3


def test_busy_pages_are_asked_for_again(monkeypatch):
    answers = iter([paged.Busy(), OSError("reset"), {"studies": [1], "nextPageToken": "t"}])

    def fetched(*_):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    monkeypatch.setattr(paged, "_fetched", fetched)
    monkeypatch.setattr(paged.time, "sleep", lambda s: None)
    assert paged.Pages({"base": "x", "terms": "a"}).page("a", "") == ([1], "t")


def test_paged_stream_goes_on_after_a_restart(spark, tmp_path):
    play(tmp_path / "in", {"x": [[{"id": 1}, {"id": 2}], [{"id": 3}]], "y": [[{"id": 4}]]})

    def run():
        q = paged.paged_stream(spark, str(tmp_path / "in"), ["x", "y"], pause="0").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted(json.loads(r["item"])["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2, 3, 4] and run() == [1, 2, 3, 4]


def test_workbooks(spark):
    made = workbooks.workbook({"a": [["x", "y"], ["1", None], [2, "b & <c>"]], "b": [["z"]]})
    books = spark.createDataFrame([("one", made), ("two", workbooks.workbook({"a": [["y"], ["q"]]}))], "path string, content binary")
    got = sorted((tuple(r) for r in workbooks.sheet_of(books, "a", ["x", "y", "none"]).collect()), key=repr)
    assert got == sorted([("one", "1", None, None), ("one", "2", "b & <c>", None), ("two", None, "q", None)], key=repr)
    assert workbooks.sheet_of(books, "none", ["x"]).collect() == []


def test_workbook_files(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbooks.workbook({"a": [["x"], ["1"]]}))
    assert [r["x"] for r in workbooks.sheet(spark, str(tmp_path), "a", ["x"]).collect()] == ["1"]


# -- ledgers ------------------------------------------------------------------------------------------------------
def test_chain_grows_from_trigger_to_trigger(spark, tmp_path):
    rows = [("r1", n, f"t{n}") for n in range(6)] + [("r2", n, "x") for n in range(3)]
    schema = "run string, n long, body string"
    put = lambda some, name: spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = stream.chained_stream(src, "run", "n", ["run", "n", "body"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(180)
        q.stop()

    put(rows[:3], "a")
    run()
    put([*rows[1:3], rows[3], rows[6]], "b")  # two events come again
    run()
    put([*rows[4:6], *rows[7:], rows[7]], "c")
    run()
    got = {(r["run"], r["at"]): (r["sequence"], r["event_hash"], r["previous_hash"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = ledger.chained(spark.createDataFrame(rows, schema), "run", "n", ["run", "n", "body"])
    assert got == {(r["run"], r["n"]): (r["n"] + 1, r["event_hash"], r["previous_hash"]) for r in batch.collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
