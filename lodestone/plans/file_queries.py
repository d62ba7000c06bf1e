"""Readers and sinks over files that each query writes in the shared folder, and the gene-level fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.plans import templates as T
from lodestone.plans.registry import query
from lodestone.sources import tables as S
from lodestone.sources.projection import evidence_graph, read, store_graph, stored_graph

col, lit = F.col, F.lit


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def io13_written_and_read(spark, d):
    """A comma-separated sink, read back under a schema (IO1, IO13)."""
    path = S.shared_path(spark, "parts")
    S.write_delimited(read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), path)
    return S.delimited(spark, path, "p_partkey long, p_name string, p_brand string, p_size int")


@query("SELECT s_suppkey, s_name FROM supplier")
def io02_trailing_fields(spark, d):
    """Tab-separated lines with fields beyond the schema: they do not shift the columns."""
    path = S.shared_path(spark, "suppliers")
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", lit("").alias("blank"))
    rows.write.csv(path, sep="\t", header=True)
    return S.delimited(spark, path, "s_suppkey long, s_name string", sep="\t")


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size END AS code, p_size % 5 > 0 AS strict FROM part")
def io04_malformed_rows(spark, d):
    """Rows that do not parse: kept with nulls by the robust scan, left out by the strict one."""
    path = S.shared_path(spark, "codes")
    code = F.when(col("p_size") % 5 > 0, col("p_size").cast("string")).otherwise(F.concat(lit("x"), "p_size"))
    S.write_delimited(read(spark, d, "part").select("p_partkey", code.alias("code")), path)
    schema = "p_partkey long, code int"
    good = S.delimited(spark, path, schema, strict=True).select("p_partkey", "code").where("code is not null").select("p_partkey", lit(True).alias("strict"))
    return S.delimited(spark, path, schema).join(good, "p_partkey", "left").na.fill(False, ["strict"])


@query("SELECT p_partkey, try_cast(p_brand AS INTEGER) AS brand_no, p_size, replace(p_name, ' ', '|') AS words FROM part")
def io05_text_then_types(spark, d):
    path = S.shared_path(spark, "texts")
    S.write_delimited(read(spark, d, "part").select("p_partkey", col("p_brand").alias("brand_no"), "p_size", col("p_name").alias("words")), path)
    raw = S.all_text(spark, path, ["p_partkey", "brand_no", "p_size", "words"])
    out = S.converted(raw, {"p_partkey": "long", "brand_no": "int", "p_size": "int"}, {"words": " "})
    return out.withColumn("words", F.array_join("words", "|"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io07_json_arrays(spark, d):
    """One JSON array in each file, a file for each region."""
    path = S.shared_path(spark, "nations")
    whole = read(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    whole.write.partitionBy("n_regionkey").text(path)
    return S.json_documents(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT s_suppkey, s_name FROM supplier")
def io09_xml_rows(spark, d):
    path = S.shared_path(spark, "xml")
    read(spark, d, "supplier").select("s_suppkey", "s_name").write.format("xml").option("rowTag", "supplier").save(path)
    return S.xml_rows(spark, path, "supplier", "s_suppkey long, s_name string")


PAGE_ROWS = 50


def _pages(spark, d):
    """Customers in pages as a paged source hands them out; the third page is lost, the second was asked for twice."""
    page = F.floor(col("c_custkey") / PAGE_ROWS)
    rows = read(spark, d, "customer").select(page.alias("page"), F.struct(col("c_custkey").alias("id"), col("c_name").alias("title")).alias("study"))
    token = lambda n: F.concat(lit("t"), n.cast("string"))
    pages = rows.groupBy("page").agg(F.collect_list("study").alias("studies")).where("page <> 2")
    pages = pages.select(token(col("page")).alias("pageToken"), token(col("page") + 1).alias("nextPageToken"), "studies")
    path = S.shared_path(spark, "pages")
    pages.union(pages.where("pageToken = 't1'")).write.json(path)
    return S.landed_pages(spark, path, "studies", "struct<id: long, title: string>")


@query(f"SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey // {PAGE_ROWS} <> 2")
def io11_landed_items(spark, d):
    return S.page_items(_pages(spark, d), "studies")


@query(f"SELECT 't' || p AS pageToken FROM (SELECT c_custkey // {PAGE_ROWS} + 1 AS p FROM customer WHERE c_custkey // {PAGE_ROWS} <> 2 GROUP BY 1 EXCEPT SELECT c_custkey // {PAGE_ROWS} FROM customer WHERE c_custkey // {PAGE_ROWS} <> 2)")
def io11_missing_pages(spark, d):
    """Pages that are named as next but did not land: the lost one, and the one after the last."""
    return S.missing_pages(_pages(spark, d))


@query(f"SELECT 'n' || c_nationkey AS term, CASE WHEN k = 0 THEN '' ELSE 't' || k END AS pageToken, c_custkey AS id, c_name AS title FROM (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // {PAGE_ROWS} AS k FROM customer)")
def io11_paged_chains(spark, d):
    """A chain of pages for each nation, followed page by page by a task of its own (IO11)."""
    from pyspark.sql import Window

    from lodestone.sources.paged import FIRST, paged

    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = read(spark, d, "customer").select(F.concat(lit("n"), col("c_nationkey").cast("string")).alias("term"), F.floor(nth / PAGE_ROWS).alias("k"), F.struct(col("c_custkey").alias("id"), col("c_name").alias("title")).alias("x"))
    pages = rows.groupBy("term", "k").agg(F.array_sort(F.collect_list("x")).alias("studies"))
    more = pages.select("term", (col("k") - 1).alias("k"), F.concat(lit("t"), col("k").cast("string")).alias("nextPageToken"))
    whole = pages.join(more, ["term", "k"], "left").select("term", F.when(col("k") == 0, FIRST).otherwise(F.concat(lit("t"), col("k").cast("string"))).alias("token"), F.to_json(F.struct("studies", "nextPageToken")).alias("value"))
    path = S.shared_path(spark, "chains")
    whole.write.partitionBy("term", "token").text(path)
    terms = [f"n{r['n_nationkey']}" for r in read(spark, d, "nation").select("n_nationkey").collect()]  # the search terms, a stated list
    chains = [t for t in terms if t in {r["term"] for r in pages.select("term").distinct().collect()}]
    item = F.from_json("item", "id long, title string")
    return paged(spark, path, chains).select("term", "pageToken", item["id"].alias("id"), item["title"].alias("title"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS c_name, c_mktsegment FROM customer")
def io03_sheets(spark, d):
    """Customers as workbooks of five hundred rows, each read by one task (IO3)."""
    import pyarrow as pa

    from lodestone.sources.workbooks import sheet_of, workbook

    rows = read(spark, d, "customer").select(F.floor(col("c_custkey") / 500).alias("book"), F.struct(F.col("c_custkey"), F.when(col("c_custkey") % 7 > 0, col("c_name")).alias("c_name"), col("c_mktsegment")).alias("x"))

    def made(batches):
        for b in batches:
            books = [workbook({"notes": [["none"]], "customers": [["c_mktsegment", "c_custkey", "c_name"], *([x["c_mktsegment"], x["c_custkey"], x["c_name"]] for x in own)]}) for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"book{n}" for n in b.column(0).to_pylist()]), pa.array(books, pa.binary())], ["path", "content"])

    books = rows.groupBy("book").agg(F.collect_list("x").alias("x")).mapInArrow(made, "path string, content binary")
    return sheet_of(books, "customers", ["c_custkey", "c_name", "c_mktsegment"]).drop("path")


@query("""SELECT 'Gene' AS label, count(*) AS n FROM region UNION ALL SELECT 'Variant', count(*) FROM nation UNION ALL SELECT 'MolecularProfile', count(*) FROM customer UNION ALL SELECT 'Evidence', count(*) FROM orders
 UNION ALL SELECT 'Drug', count(*) FROM part UNION ALL SELECT 'Publication', count(*) FROM supplier UNION ALL SELECT 'Device', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'Disease', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'ClinicalTrial', count(*) FROM supplier
 UNION ALL SELECT 'path', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""")
def io15_stored_graph(spark, d):
    """The evidence graph written and read back: its nodes by label, and paths from a variant to a drug."""
    model, path = evidence_graph(spark, d), S.shared_path(spark, "graph")
    store_graph(model, path)
    held = stored_graph(spark, path, model)
    paths = held.match("v", "Variant").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e").hop("e", "TARGETS_DRUG", "d")
    out = paths.df.agg(F.count("*").alias("n")).select(lit("path").alias("label"), "n")
    for label, nodes in held.nodes.items():
        out = out.unionByName(nodes.table.agg(F.count("*").alias("n")).select(lit(label).alias("label"), "n"))
    return out


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def io18_reloaded(spark, d):
    """Stale tables are wiped when their successors are loaded."""
    path = S.shared_path(spark, "reload")
    nation = read(spark, d, "nation").select(col("n_nationkey").cast("long").alias("id"), col("n_name").alias("name"))
    supplier = read(spark, d, "supplier").select((col("s_suppkey") + 1000000).cast("long").alias("id"), col("s_name").alias("name"))
    S.store_tables({"nation": nation.union(supplier), "supplier": nation}, path)
    S.store_tables({"nation": nation, "supplier": supplier}, path)
    return spark.read.parquet(f"{path}/nation").union(spark.read.parquet(f"{path}/supplier"))


CASE = "CASE WHEN n_nationkey % 3 = 0 THEN 'exon ' || n_nationkey ELSE 'T' || n_nationkey || 'M' END"
ROWS = f"(SELECT n_nationkey AS case_id, n_regionkey AS gene, {CASE} AS found, c_custkey AS evidence FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)"


@query(f"""WITH r AS {ROWS} SELECT case_id, found, evidence, FALSE AS fallback FROM r
 UNION ALL SELECT n_nationkey, found, evidence, TRUE FROM nation JOIN r ON gene = n_regionkey WHERE n_nationkey NOT IN (SELECT case_id FROM r) AND lower(found) <> lower({CASE}) AND regexp_matches(found, '^[A-Za-z]\\d{{1,4}}[A-Za-z*]+$') AND NOT regexp_matches(lower(found), '{'|'.join(X.DRIVER_WORDS)}')""")
def pf15_gene_fallback(spark, d):
    """Resistance rows of every variant; where it has none, those of the acquired variants of its gene."""
    n = col("n_nationkey").cast("string")
    name = F.when(col("n_nationkey") % 3 == 0, F.concat(lit("exon "), n)).otherwise(F.concat(lit("T"), n, lit("M")))
    cases = read(spark, d, "nation").select(col("n_nationkey").alias("case_id"), col("n_regionkey").alias("gene"), name.alias("variant"))
    strong = read(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(col("c_nationkey").alias("case_id"), col("c_custkey").alias("evidence"))
    rows = cases.join(strong, "case_id").select("case_id", "gene", col("variant").alias("found"), "evidence")
    return T.with_gene_fallback(cases, rows.select("case_id", "found", "evidence"), rows.select("gene", "found", "evidence"))
