"""What SQL does not hold: look-ahead patterns, hash chains, streams, readers, path patterns, plans."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rules, text
from lodestone.operators import joins, ledger, retrieval, traversal
from lodestone.plans.graph import Edges, Graph, Nodes
from lodestone.plans.templates import any_condition, any_keyword
from lodestone.sources import tables
from lodestone.streaming import ledger as stream


def one(spark, value, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]) if columns else spark.range(1)
    return row.select(value.alias("v")).first()["v"]


def test_links(spark):
    got = one(spark, text.linked_pmids(F.lit("PMID: 12345678 and PMID 7654321 (x), PMID:123")))
    assert got == "[PMID 12345678](https://pubmed.ncbi.nlm.nih.gov/12345678/) and PMID 7654321 (x), PMID:123"


def test_keywords(spark):
    assert one(spark, any_keyword(F.lit("Lung cancer"), ["x", "LUNG"])) is True
    assert one(spark, any_keyword(F.lit("Lung"), [""])) is True
    assert one(spark, any_keyword(F.lit(None).cast("string"), [""])) is None
    assert one(spark, any_condition([F.array(F.lit("a")), F.array(F.lit("Colon"))], ["colon"])) is True


@pytest.mark.parametrize(("support", "fits", "section"), [("contradicted", "compatible", "excluded"), ("uncertain", "not_compatible", "review"), ("supported_as_written", "not_compatible", "supported_not_compatible"), ("supported_after_contextualization", "indeterminate", "supported_indeterminate"), ("supported_as_written", "compatible", "supported_compatible")])
def test_sections(spark, support, fits, section):
    assert one(spark, rules.section(F.lit(support), F.lit(fits))) == section


def test_therapeutic_match_reads_long_reports_as_text(spark):
    report = "x" * 201 + " osimertinib"
    assert one(spark, rules.therapeutic_match(F.lit(report), F.lit("Osimertinib"), text.drug_parts)) == 1.0
    assert one(spark, rules.therapeutic_match(F.lit("a + b"), F.lit("b and c"), text.drug_parts)) == 0.5


def test_chain_and_tampering(spark):
    rows = [("r", i, f"t{i}") for i in range(5)] + [("s", 0, "x")]
    df = spark.createDataFrame(rows, "run string, n long, body string")
    chain = ledger.chained(df, "run", "n", ["run", "n", "body"])
    previous = "GENESIS"
    for r in chain.where("run = 'r'").orderBy("n").collect():
        want = hashlib.sha256(f"r|{r['n']}|t{r['n']}|{previous}".encode()).hexdigest()
        assert (r["previous_hash"], r["event_hash"]) == (previous, want)
        previous = want
    whole = df.join(chain, ["run", "n"])
    changed = whole.withColumn("body", F.when(F.col("n") == 3, "other").otherwise(F.col("body")))
    assert {r["run"]: r["valid"] for r in ledger.verified(whole, "run", "n", ["run", "n", "body"]).collect()} == {"r": True, "s": True}
    assert {r["run"]: r["valid"] for r in ledger.verified(changed, "run", "n", ["run", "n", "body"]).collect()} == {"r": False, "s": True}
    assert ledger.public_view(df.union(spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", 1, "p")], df.schema)), "run", "body").collect() == [("123e4567-e89b-12d3-a456-426614174000", 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\tlist\n1\tx\ta;b\t\t\nbad\ty\t\n")
    raw = tables.all_text(spark, str(tmp_path / "a.tsv"), ["id", "name", "list"], "\t")
    got = tables.converted(raw, {"id": "int"}, {"list": ";"}).collect()
    assert [(r["id"], r["name"], r["list"]) for r in got] == [(1, "x", ["a", "b"]), (None, "y", [])]
    (tmp_path / "a.json").write_text('[{"id": 1, "d": {"t": "x"}}, {"id": 2}]')
    assert [(r["id"], r["d"]["t"] if r["d"] else None) for r in tables.json_documents(spark, str(tmp_path / "a.json"), "id int, d struct<t:string>").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "a.xml").write_text("<set><art><pmid>7</pmid><title>T</title></art><art><pmid>8</pmid></art></set>")
    assert [(r["pmid"], r["title"]) for r in tables.xml_rows(spark, str(tmp_path / "a.xml"), "art", "pmid int, title string").collect()] == [(7, "T"), (8, None)]
    tables.write_delimited(spark.createDataFrame([(1, "a")], "id int, t string"), str(tmp_path / "out"))
    assert tables.delimited(spark, str(tmp_path / "out"), "id int, t string").collect() == [(1, "a")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "old")], "id int, t string")
    new = spark.createDataFrame([(1, "new", 1), (2, "first", 2), (2, "last", 3)], "id int, t string, at int")
    assert sorted(tables.upserted(old, new, ["id"], "at").collect()) == [(1, "old"), (2, "first")]
    assert sorted(tables.upserted(old, new, ["id"], "at", latest=True).collect()) == [(1, "new"), (2, "last")]
    rows, made = joins.get_or_create(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), spark.createDataFrame([("a", "1")], "k string, i string"), "k", "i", "fda:")
    assert sorted(rows.collect()) == [("a", "1"), ("b", "fda:b"), ("b", "fda:b")] and made.collect() == [("b", "fda:b")]


def test_optional_hops_and_multiplicity(spark):
    nodes = lambda *ids: Nodes(spark.createDataFrame([(i,) for i in ids], "id int"), "id")
    links = lambda *e: spark.createDataFrame(list(e), "src int, dst int, k string")
    g = Graph({"A": nodes(1, 2), "B": nodes(10, 11)}, {"R": Edges("A", "B", links((1, 10, "x"), (1, 10, "y"), (1, 11, "x")))})
    rows = g.match("a", "A").hop("a", "R", "b", optional=True, where="id = 10").select(a="a__id", b="b__id")
    assert sorted(rows.collect(), key=repr) == [(1, 10), (1, 10), (2, None)]
    assert g.match("b", "B").hop("b", "R", "a", back=True, rel_where="k = 'y'").select(b="b__id", a="a__id").collect() == [(10, 1)]
    with pytest.raises(ValueError):
        g.match("b", "B").hop("b", "R", "a")


def test_simple_paths_are_capped_in_order(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a", "a")], "anchor string, node string")
    assert sorted(r["path"] for r in traversal.simple_paths(start, edges, 2).collect()) == [["a", "b", "d"], ["a", "c", "d"]]
    assert [r["path"] for r in traversal.simple_paths(start, edges, 2, most=1).collect()] == [["a", "b", "d"]]


def test_simple_walks(spark):
    edges = spark.createDataFrame([("a", "R", "c"), ("a", "R", "b"), ("b", "R", "d"), ("c", "R", "d"), ("a", "X", "d"), ("c", "R", "a")], "src string, rel string, dst string")
    start = spark.createDataFrame([("a", "a")], "anchor string, node string")
    walk = lambda steps, most: sorted("".join(r["path"]) for r in traversal.simple_walks(start, edges, steps, most).collect())
    assert walk([("R", False)] * 2, None) == ["abd", "acd"] and walk([("R", False)] * 2, 1) == ["abd"]
    assert walk([("R", False), ("R", False), ("R", True)], None) == ["abdc", "acdb"]
    assert walk([("X", False), ("R", True)], 4000) == ["adb", "adc"] and walk([("X", True)], 4000) == []
    mesh = spark.createDataFrame([(f"{i}", "R", f"{j}") for i in range(9) for j in range(9) if i != j and (i + j) % 4], "src string, rel string, dst string")
    start = spark.createDataFrame([("0", "0"), ("1", "1")], "anchor string, node string")
    got = traversal.simple_walks(start, mesh, [("R", False)] * 3, 37).collect()
    full = {"0": [("0",)], "1": [("1",)]}
    near = {f"{i}": [f"{j}" for j in range(9) if i != j and (i + j) % 4] for i in range(9)}
    for _ in range(3):
        full = {a: [(*p, n) for p in ps for n in near[p[-1]] if n not in p][:37] for a, ps in full.items()}
    assert sorted(tuple(r["path"]) for r in got) == sorted(p for ps in full.values() for p in ps)


def test_abstention(spark):
    assert one(spark, retrieval.abstaining(F.lit("  "), F.lit("x"))) == "not in the knowledge base"


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    src = stream.event_stream(spark, str(tmp_path / "in/*"), events.schema)
    q = stream.append_to(stream.once(src, late="4000 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_plans_push_down_and_do_not_cross(spark):
    from lodestone.plans import catalog

    plan = catalog.QUERIES["q07_target_point"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)" in plan
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_landed_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"nextPageToken": "b", "rows": [{"id": 1}, {"id": 2}]}\n{"pageToken": "b", "nextPageToken": "c", "rows": [{"id": 3}]}\n')
    (tmp_path / "again.json").write_text('{"pageToken": "b", "nextPageToken": "c", "rows": [{"id": 3}]}\n{"pageToken": "d", "rows": []}\n')
    pages = tables.landed_pages(spark, str(tmp_path), "rows", "struct<id: long>")
    assert sorted(r["id"] for r in tables.page_items(pages, "rows").collect()) == [1, 2, 3]
    assert [r["pageToken"] for r in tables.missing_pages(pages).collect()] == ["c"]


def test_gene_fallback(spark):
    from lodestone.plans.templates import with_gene_fallback

    cases = spark.createDataFrame([(1, "G", "T790M"), (2, "G", "L858R"), (3, "H", "x"), (4, "G", None)], "case_id int, gene string, variant string")
    primary = spark.createDataFrame([(1, "T790M", 10)], "case_id int, found string, evidence int")
    by_gene = spark.createDataFrame([("G", "l858r", 20), ("G", "C797S", 21), ("G", "exon 19 deletion", 22), ("G", None, 23)], "gene string, found string, evidence int")
    got = sorted(tuple(r) for r in with_gene_fallback(cases, primary, by_gene).select("case_id", "evidence", "fallback").collect())
    assert got == [(1, 10, False), (2, 21, True), (4, 20, True), (4, 21, True)]


def test_checkpoint_folder_is_not_guessed_on_a_cluster(spark):
    from types import SimpleNamespace as Some

    unset = Some(getCheckpointDir=lambda: Some(isEmpty=lambda: True))
    far = Some(sparkContext=Some(master="yarn", _jsc=Some(sc=lambda: unset)), conf=Some(get=lambda *_: None))
    with pytest.raises(ValueError):
        tables.shared_path(far, "x")
