"""The prefix trie against a plain version."""

import hashlib
import random
import zlib

from lodestone.llm import prefix_trie
from lodestone.llm.prefix_trie import conversation_trie, ordered_turns

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, key binary"


def ordered(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in own.items()}


def brute(rows):
    own = ordered(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, kids = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                kids.setdefault(turns[: d - 1], set()).add(turns[:d])

    def sums(node):
        leaves, saved = 0, 0
        todo = [node]
        while todo:
            x = todo.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            todo += kids.get(x, ())
        return leaves, saved

    out = []
    for node, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own_members), len(node), parent, len(own_members), len(kids.get(node, ())), *sums(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def built(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1, b"x") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, conversation_trie(df).collect()), key=lambda r: (r[0], r[1]))


def conversations(n, seed, texts=3, longest=12):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"][: 1 + t % 2]), f"é{rng.randrange(texts)}" * rng.randrange(1, 3)) for c in range(n) for t in range(rng.randint(1, longest)) if c % 10 != 5]


def test_random_conversations(spark):
    rows = conversations(60, 1)
    assert built(spark, rows) == brute(rows)


def test_copies_odd_rows_and_one_hot_start(spark):
    rows = conversations(40, 2)
    rows += [(1000 + i, t, "user", "same start" if t == 0 else f"t{t}" if i % 3 else f"t{i}") for i in range(40) for t in range(3)]
    rows += [(2000 + i, t, "user", f"copy {t}") for i in range(0, 200, 5) for t in range(5)]  # exact copies, as their base is each itself
    rows += [(None, 1, "user", "no id"), (3001, None, None, None), (3001, None, "user", "before"), (3001, 2, "a", "x"), (3001, 2, "a", "x"), (3001, 2, None, "x"), (-7, 0, "u", "y"), (-5, 0, "u", "z"), (-5, 1, "u", "")]
    rows += [(4000, 0, "user", "long " * 40_000), (4001, t, "user", "x") if False else (4001, 0, "user", "x")]
    assert built(spark, rows) == brute(rows)


def test_order_across_partitions_and_long_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = [(10, t, "user", f"turn {t % 50}") for t in range(400)] + [(5 * i, 0, "user", "only") for i in range(3, 60)]
    rows += [(7, t // 3, "user", f"x{t % 3}") for t in range(300)]
    df = spark.createDataFrame([(*r, "clash", 1, b"x") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r["conv"], r["nth"], r["bytes"]) for r in ordered_turns(df).collect())
        assert built(spark, rows, 5) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((c, n, len(x[1].encode())) for c, v in ordered(rows).items() for n, x in enumerate(v, 1))


def test_turnless_and_empty(spark):
    turnless = next(c for c in range(10_001, 20_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    rows = [(turnless, 0, "user", "gone"), (turnless, 1, "user", "too")]
    assert built(spark, rows) == brute(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert built(spark, [(5, 0, "u", "x")]) == brute([(5, 0, "u", "x")])
    assert built(spark, []) == []
