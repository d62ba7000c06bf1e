"""What must not grow faster than the tables: draws of noise, walks, answers, audits and retrieval."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest

from lodestone.functions.cases import ROUTES
from lodestone.operators import noise, routes, topk, traversal
from lodestone.plans import catalog, noise_queries, question_queries, template_queries
from lodestone.plans.graph import Edges, Graph, Nodes
from lodestone.sources.projection import evidence_graph

DATA = "/root/testdata/sf0.001"


def against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cursor = con.execute(catalog.SQL[name])
    at = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
    return want


@pytest.mark.parametrize("many", [100_000, 3, 0])
def test_sources_draw_alike_as_one_row_and_row_by_row(spark, monkeypatch, many):
    truth = [("a", f"s{i}", f"t{(i * 7 + k * k) % 40}") for i in range(30) for k in range(i % 9 + 1)] + [("b", f"s{i}", f"d{i % 5}") for i in range(60)] + [("c", "s1", f"t{k}") for k in range(40)]
    frame = spark.createDataFrame(truth * 2, "rel string, src string, dst string")
    want = sorted(map(tuple, noise._drawn_in_rows(frame, noise._numbered(frame.select("rel", "dst").distinct()), 1.0).collect()))
    monkeypatch.setattr(noise, "MANY", many)
    assert sorted(map(tuple, noise.false_edges(frame, 1.0).collect())) == want and len(want) > 100


def levels_of_ends(truth, fronts, names, shares):
    """(rel, start, name) -> the least share at which it is reached, by drawing one target after the other."""
    pool, out = {r: sorted({d for k, _, d in truth if k == r}) for r, _, _ in truth}, {}
    for rel, front in fronts.items():
        for start, node, level in front:
            own, targets, drawn = {d for r, s, d in truth if (r, s) == (rel, node)}, pool[rel], []
            need = min(round(max(shares) * len(own)), len(targets) - len(own))
            for j in itertools.count():
                if len(drawn) == need:
                    break
                d = targets[int(hashlib.md5(f"{node}|{j}".encode()).hexdigest()[:8], 16) % len(targets)]
                if d not in own and d not in drawn:
                    drawn.append(d)
            ends = [(d, 0.0) for d in own] + [(d, next((s for s in sorted(shares) if n < round(s * len(own))), None)) for n, d in enumerate(drawn)]
            for d, at in ends:
                key = (rel, start, names.get((rel, d)))
                if at is not None and key[2]:
                    out[key] = min(out.get(key, 9.0), max(at, level))
    return out


@pytest.mark.parametrize(("many", "rows"), [(100_000, 10_000), (100_000, 7), (6, 7), (0, 50)])
def test_names_by_share_are_those_of_single_draws(spark, monkeypatch, many, rows):
    rng = random.Random(21)
    truth = {("a", f"s{rng.randrange(25)}", f"t{rng.randrange(60):02}") for _ in range(150)} | {("b", f"s{i}", f"d{i % 5}") for i in range(40)} | {("c", "s1", f"t{k}") for k in range(9)}
    fronts = {r: sorted({(rng.randrange(4), f"s{rng.randrange(30)}", rng.choice([0.0, 0.0, 0.5])) for _ in range(30)} | {(7, "none", 0.0)}) for r in "abc"}
    fronts = {r: [(a, n, min(x for b, m, x in f if (a, n) == (b, m))) for a, n in sorted({f[:2] for f in f})] for r, f in fronts.items()}
    names = {(r, d): f"{r}{i % 40}" for i, (r, d) in enumerate(sorted({(r, d) for r, _, d in truth})) if i % 9}
    frame = lambda rows, of: spark.createDataFrame(sorted(rows), of)
    monkeypatch.setattr(noise, "MANY", many)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = noise.named_by_share({r: frame(f, "start long, node string, level double") for r, f in fronts.items()}, frame(list(truth) * 2, "rel string, src string, dst string"), frame([(*k, v) for k, v in names.items()], "rel string, dst string, name string"), [0.0, 0.25, 0.5, 1.0]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = levels_of_ends(truth, fronts, names, [0.0, 0.25, 0.5, 1.0])
    assert {(r["rel"], r["start"], r["name"]): r["level"] for r in got} == want and len(got) == len(want) and len(set(want.values())) == 4


def test_starts_that_reach_every_name_need_no_noise(spark, monkeypatch):
    reached = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), ("a", 2, "x"), ("b", 1, "z"), ("b", 2, "z")], "rel string, start long, name string")
    names = spark.createDataFrame([("a", "t1", "x"), ("a", "t2", "x"), ("a", "t3", None), ("b", "t1", "z")], "rel string, dst string, name string")
    starts = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3")], "start long, node string")
    assert sorted(map(tuple, noise.lacking(starts, reached, names).collect())) == [("a", 2, "n2"), ("a", 3, "n3"), ("b", 3, "n3")]

    def fails(*_):
        raise AssertionError("true edges reach all names of these tables")

    monkeypatch.setattr(noise, "false_edges", fails)
    monkeypatch.setattr(noise, "named_by_share", fails)
    assert noise_queries._graph_sweep(spark, DATA).count() == 60


def test_graph_under_noise_where_names_are_lacking(spark, tmp_path):
    """Parts of different names, and one line in twelve."""
    con = duckdb.connect()
    for f in os.listdir(DATA):
        t = f.removesuffix(".parquet")
        rows = {"part": "SELECT * REPLACE (p_name || ' ' || p_partkey AS p_name) FROM", "lineitem": "SELECT * EXCLUDE k FROM (SELECT *, l_orderkey % 12 AS k FROM"}.get(t, "SELECT * FROM") + f" '{DATA}/{f}'" + (") WHERE k = 0" if t == "lineitem" else "")
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{f}'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{f}'")
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    want = plain(con.execute(f"WITH {noise_queries._graph_sql()} SELECT rho, recall, noisy FROM gsys").fetchall())
    assert plain(noise_queries._graph_sweep(spark, str(tmp_path)).select("rho", "recall", "noisy").collect()) == want
    assert any(noisy > 0 for _, _, noisy in want)


def test_schema_triples_are_those_of_the_catalog(spark):
    assert len(against_sql(spark, "j27_schema_triples")) == 9


# -- walks --------------------------------------------------------------------------------------------------------
STEPS = [("x", False), ("y", False), ("x", True), ("y", False)]


def all_walks(start, edges, steps):
    paths = [[s] for s in start]
    for rel, back in steps:
        hops = {(d, s) if back else (s, d) for s, r, d, _ in edges if r == rel}
        paths = [[*p, b] for p in paths for a, b in hops if a == p[-1] and b not in p]
    return sorted(paths)


@pytest.fixture
def web():
    hops = [(f"a{i}", "x", f"b{(i * 5 + j) % 7}", False) for i in range(9) for j in range(4)]
    hops += [(f"b{i}", "y", f"c{(i + j) % 6}", False) for i in range(7) for j in range(3)] + [(f"c{i}", "x", f"a{i}", False) for i in range(6)]
    # x backwards from c: only the last nodes have any, so that the first paths are dead ends.
    return hops + [("d1", "x", "c5", False), ("d1", "y", "e1", False), ("d2", "x", "c5", False), ("d2", "y", "e0", False)]


@pytest.mark.parametrize("most", [1, 3, 1_000])
def test_least_path_is_found_behind_dead_ends(spark, web, most):
    edges, start = spark.createDataFrame(web, "src string, rel string, dst string, noise boolean"), spark.createDataFrame([(f"a{i}", f"a{i}") for i in range(10)], "anchor string, node string")
    got = {r["anchor"]: r["path"] for r in traversal.least_path(start, edges, STEPS, most, 4).collect()}
    whole = all_walks([f"a{i}" for i in range(10)], web, STEPS)
    assert got == {f"a{i}": next((p for p in whole if p[0] == f"a{i}"), None) for i in range(10)}
    assert any(got.values()) and not all(got.values())


@pytest.mark.parametrize("most", [1, 5, 20])
def test_walks_stop_at_the_first_paths_of_a_level(spark, web, most):
    edges, start = spark.createDataFrame(web, "src string, rel string, dst string, noise boolean"), spark.createDataFrame([(f"a{i}", f"a{i}") for i in range(9)], "anchor string, node string")
    for k, level in enumerate(traversal.walk_levels(start, edges, STEPS[:2], most), 1):
        whole = all_walks([f"a{i}" for i in range(9)], web, STEPS[:k])
        if k == 1 or most >= 4:  # the cut of the first level leaves out none that the second would keep
            assert sorted(r["path"] for r in level.collect()) == sorted(p for i in range(9) for p in [p for p in whole if p[0] == f"a{i}"][:most])


def test_first_path_of_every_anchor(spark):
    assert len(against_sql(spark, "j22_first_path")) == 5


# -- top-k --------------------------------------------------------------------------------------------------------
def test_a_batch_hands_on_only_what_may_be_among_the_first():
    scores = np.random.default_rng(1).normal(size=(50, 4_000))
    scores[3, 10:20], scores[4] = 9.0, np.nan
    found, fit = topk.Foremost(50, 5), np.arange(4_000) % 3 > 0
    q, row = found.foremost_of(scores, fit)
    assert len(q) <= 50 * 5 + 10 and 4 not in q and fit[row].all()
    found.add(q, scores[q, row], row)
    want = [sorted(np.flatnonzero(fit), key=lambda i, s=s: (-np.round(s[i], topk.DIGITS), i))[:5] for s in scores]
    slot, _, name, _ = found.held
    assert all(name[slot == i].tolist() == want[i] for i in range(50) if i != 4)


# -- routes -------------------------------------------------------------------------------------------------------
def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chains_share_their_walks(spark):
    """Seven chains read the lines twice: once by order and once by supplier."""
    ways = [(label, steps) for route in ROUTES if route != routes.BRIDGE for label, steps, _ in routes.chains(route)]
    graph = evidence_graph(spark, DATA)
    starts = routes.names_of(graph, ["Gene", "Variant", "Drug"]).select(routes.F.col("node").alias("start"))
    assert sum("Relation" in line and "l_partkey" in line for line in plan_of(routes.answers(graph, starts, ways)).splitlines()) == 2
    assert len(against_sql(spark, "r05_graph_facts")) > 1_000 and len(against_sql(spark, "r12_question_sets")) > 10 and against_sql(spark, "r16_router_ablation")


def test_chains_that_share_a_walk_keep_their_own_starts(spark):
    frame = lambda rows: spark.createDataFrame([(str(a), str(b)) for a, b in rows], "src string, dst string")
    hops = {"AB": [(0, 0), (0, 1), (1, 1), (1, 1), (2, 3)], "BC": [(0, 5), (1, 5), (1, 6), (4, 7)], "TARGETS_DRUG": [(5, 1), (5, 2), (6, 2), (7, 3), (5, 1)], "DE": [(1, 8), (2, 8), (3, 9)]}
    node = lambda keys: Nodes(spark.createDataFrame([(str(k), f"n{k % 2}") for k in keys], "id string, name string"), "id")
    graph = Graph({"A": node(range(3)), "B": node(range(5)), "C": node(range(5, 8)), "Drug": node(range(1, 4)), "E": node((8, 9))}, {k: Edges(*("Drug" if x == "D" else x for x in ("CD" if k == "TARGETS_DRUG" else k)), frame(v)) for k, v in hops.items()})
    steps = [(k, ">") for k in hops]
    ways = [("A", tuple(steps)), ("A", tuple(steps[:3])), ("B", tuple(steps[1:3])), ("A", tuple(steps[:1])), ("E", (("DE", "<"),))]
    number = routes.numbered(graph, ways)
    assert number[ways[1]] == number[ways[2]] and len(set(number.values())) == 4
    starts = [("A", 0), ("A", 1), ("A", 2), ("B", 1), ("B", 4), ("B", 1), ("E", 9)]
    got = {tuple(r) for r in routes.answers(graph, spark.createDataFrame([(f"{a}:{k}",) for a, k in starts], "start string"), ways).collect()}
    for label, chain in ways:
        for a, k in starts:
            if a == label:
                at = {k}
                for rel, way in chain:
                    at = {y for x, y in (hops[rel] if way == ">" else [(b, c) for c, b in hops[rel]]) if x in at}
                want = {f"n{x % 2}" if routes.leaf_of(graph, label, chain) == "Drug" else str(x) for x in at}
                assert {name for start, tail, name in got if start == f"{label}:{k}" and tail == number[label, chain]} == want
    with pytest.raises(ValueError, match="two ways"):
        routes.numbered(graph, [("A", tuple(steps[:2])), ("A", (steps[0], steps[0][:1] + ("<",), *steps[:2]))])


def test_questions_are_made_once(spark):
    assert "Relation" not in plan_of(question_queries.questions(spark, DATA).where("qid > 'D'"))


# -- full paths ---------------------------------------------------------------------------------------------------
def test_full_paths_are_dealt_to_more_tasks_as_lines_grow(spark, monkeypatch):
    monkeypatch.setattr(template_queries, "LINES", 100)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    plan = catalog.QUERIES["q23_full_paths"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for by in (r"e#\d+L", r"gene#\d+, variant#\d+, drug#\d+, end#\d+L"):
        assert set(re.findall(rf"hashpartitioning\({by}, (\d+)\)", plan)) == {str(lines // 100)}
    assert len(against_sql(spark, "q23_full_paths")) == 25
