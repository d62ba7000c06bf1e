"""Hard negatives against a brute-force version in Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives
from lodestone.llm.hard_negatives import first_of, mine_negatives, products

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, best double"


def brute(rows):
    fine = {(i, k, tuple(x)) for i, x, k in rows if None not in (i, x, k) and len(x) and all(c is not None and math.isfinite(c) for c in x)}
    whole = [(i, k, [math.floor(256 * c) if abs(c) < 1e300 else int(c) * 256 for c in x]) for i, k, x in fine]
    out = []
    for i, k, a in whole:
        if i % 100:
            continue
        scored = {(-sum(p * q for p, q in zip(a, b)), j, m == k) for j, m, b in whole if j != i}
        for s, j, _ in sorted(x for x in scored if x[2])[:5]:
            near = sorted((t, n) for t, n, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            cut = lambda v: max(-(2**63), min(2**63 - 1, v))
            out += [(i, j, r, n, cut(-s), cut(-t)) for r, (t, n) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7, 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r)[:6] for r in mine_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect())


def rows_of(n, seed, wide=6, labels=3, step=None):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.standard_normal((n, wide))) + 0.5
    x = np.round(x / step) * step if step else x
    return [(i, v.tolist(), int(rng.integers(labels))) for i, v in enumerate(x)]


def test_random_rows(spark):
    rows = rows_of(900, 1)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_ties_copies_and_repeated_rows(spark):
    rows = rows_of(700, 2, wide=2, step=0.5)  # few different vectors: most scores tie
    rows += rows[:150] + [(100, rows[3][1], 1), (200, rows[4][1], rows[200][2])]
    assert mined(spark, rows) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    rows = rows_of(1200, 3)
    monkeypatch.setattr(hard_negatives, "BLOCK", 8 * 6 * 2)  # two anchors a block
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    odd = [(None, [1.0, 2.0], 1), (5000, None, 1), (5100, [1.0, None], 1), (5200, [float("nan")], 1), (5300, [float("inf")], 1), (5400, [], 1), (5500, [1.0], None)]
    uneven = [(6000, [1.0, 2.0, 3.0], 1), (6001, [1.0, 2.0], 1), (6002, [0.9, 2.0], 2), (6003, [3.0], 1), (6004, [2.9, 0.0, 0.0, 9.0], 0)]
    zero = [(7000, [0.0, 0.0, 0.0], 8), (7001, [0.0, 1.0, 1.0], 8), (7002, [1.0, 0.0, 0.0], 9)]
    low = [(8000, [-1.0, 0.0], 7), (8001, [1.0, 0.0], 7), (8002, [1.0, 0.5], 6)]  # a negative positive score has no window
    rows = odd + uneven + zero + low
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []


@pytest.mark.parametrize("size", [1e7, 1e9, 1e200, 1.7e308])
def test_scores_beyond_doubles_are_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (size * (1 - 1e-9 * rng.random(3))).tolist(), i % 2) for i in range(0, 120)]
    assert mined(spark, rows) == brute(rows)


def test_products_and_order():
    a, b = np.array([[3.0, 4.0]]), np.array([[1.0, 2.0, 9.0], [2.0**40, 0.0, 0.0]])
    assert products(a, b).tolist() == [[11, 3 * 2**40]]
    assert products(a * 2.0**30, b).tolist() == [[11 * 2**30, 3 * 2**70]]
    slot, score, ids = first_of(np.array([1, 0, 0, 0, 0]), np.array([5.0, 1, 2, 2, 2]), np.array([9, 1, 8, 3, 3]), 2)
    assert (slot.tolist(), score.tolist(), ids.tolist()) == ([0, 0, 1], [2, 2, 5], [3, 8, 9])
