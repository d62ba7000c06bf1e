"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, node long, rank int"


def brute(rows, top):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df, top=20):
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, top).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, SCHEMA)), brute(rows, 20)
    assert got.keys() == want.keys()
    assert all(len(v) == 20 and [k for k, _ in v] == [k for k, _ in sorted(v, key=lambda t: (-t[1], t[0]))] for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_equal_vectors_bad_vectors_and_few_rows(spark):
    rng = np.random.default_rng(1)
    one = rng.standard_normal(4).astype(np.float32).tolist()
    rows = [(i, one if i % 3 else rng.standard_normal(4).astype(np.float32).tolist(), 0, 0) for i in range(200)]
    bad = [(1000, None, 0, 0), (1020, [0.0] * 4, 0, 0), (1040, [float("nan")] + one[1:], 0, 0), (1060, [None] + one[1:], 0, 0), (1080, [float("inf")] * 4, 0, 0), (None, one, 0, 0), (1100, one[:3], 0, 0), rows[0]]
    got, want = found(spark.createDataFrame(rows + bad, SCHEMA)), brute(rows, 20)
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}
    assert np.allclose([s for v in got.values() for _, s in v], [s for q in got for _, s in want[q]], atol=1e-12)
    few = [(20, one, 0, 0), (21, [1.0, 0.0, 0.0, 0.0], 0, 0)]
    assert [a for a, _ in found(spark.createDataFrame(few, SCHEMA))[20]] == [21]
    assert found(spark.createDataFrame(few[:1], SCHEMA)) == {}
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_recall_over_norms(spark):
    """Vectors far longer and far shorter than half precision reaches, together and each by themselves."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for norms in (10 ** rng.uniform(-10, 8, 4000), np.full(4000, 1e-10), np.full(4000, 1e8)):
        rows = [(i, v.tolist(), 0, 0) for i, v in enumerate((x * norms[:, None]).astype(np.float32))]
        got, want = found(spark.createDataFrame(rows, SCHEMA)), brute(rows, 20)
        assert got.keys() == want.keys()
        assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_hub_and_growth(spark):
    """One vector is nearest to all: what meets it is bounded, and all find it. Work of the start grows in proportion."""
    from lodestone.llm import neighbours

    rng = np.random.default_rng(5)
    x = np.abs(rng.standard_normal((3000, 12))).astype(np.float32)
    x[7] *= 50
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, SCHEMA).repartition(8)), brute(rows, 20)
    assert all(v[0][0] == 7 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.95
    codes = neighbours._codes(x)
    assert len(codes) == neighbours.TABLES and all(0 <= c.min() and c.max() < 1 << neighbours.BITS for c in codes)
