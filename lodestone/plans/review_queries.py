"""Merging, matching, grounding, safety and question experiments over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import cases as C
from lodestone.functions import rules
from lodestone.functions import text as X
from lodestone.operators import ledger as L
from lodestone.operators import retrieval as R
from lodestone.plans import templates as T
from lodestone.plans.registry import query
from lodestone.plans.template_queries import DRUG, KWS, LV, SPINE
from lodestone.sources import tables as S
from lodestone.sources.projection import evidence_graph, read

col, lit = F.col, F.lit


# -- loading ------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, (props->>'$.k')::BIGINT AS k, coalesce(event_type, '') || ' | ' || coalesce(props->>'$.k', '') AS summary FROM events")
def io12_flattened(spark, d):
    """Nested documents as flat rows: struct fields, defaults and joined lists."""
    nested = F.from_json(F.concat(lit('{"section": {"body": '), "props", lit("}}")), "section struct<body: struct<k: long>>")
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", nested["section"]["body"]["k"].alias("k"))
    return rows.withColumn("summary", F.concat(F.coalesce("event_type", lit("")), lit(" | "), F.coalesce(col("k").cast("string"), lit(""))))


@query("SELECT o_orderkey, CASE lower(f) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS flag, lower(f) IN ('yes', 'true') AS accepted FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'Yes' ELSE 'n/a' END AS f FROM orders)")
def f25_flags(spark, d):
    k = col("o_orderkey") % 4
    rows = read(spark, d, "orders").select("o_orderkey", F.when(k == 0, "True").when(k == 1, "False").when(k == 2, "Yes").otherwise("n/a").alias("f"))
    flag = F.when(F.lower("f").isin("true", "false"), F.expr("try_cast(f as boolean)"))
    return rows.select("o_orderkey", flag.alias("flag"), F.lower("f").isin("yes", "true").alias("accepted"))


@query("SELECT p_name AS nct_id, min(p_brand) AS title, min(p_type) AS phase, min(p_size::VARCHAR) AS status, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS drug_tested FROM part WHERE p_size > 1 GROUP BY 1 UNION ALL SELECT NULL, p_brand, p_type, p_size::VARCHAR, p_brand FROM part WHERE p_size = 1")
def a27_trials_once(spark, d):
    """Repeated trials as one row with their drugs; rows without an id pass as they are."""
    rows = read(spark, d, "part").select(F.when(col("p_size") > 1, col("p_name")).alias("nct_id"), col("p_brand").alias("title"), col("p_type").alias("phase"), col("p_size").cast("string").alias("status"), col("p_brand").alias("drug_tested"))
    return T.trials_once(rows)


@query("SELECT l_suppkey, l_partkey, arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS first_quantity FROM lineitem GROUP BY 1, 2")
def a28_first_rows(spark, d):
    """Of rows with equal keys the first by position."""
    line = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", col("l_quantity").alias("first_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    return S.kept(line, ["l_suppkey", "l_partkey"], col("at")).drop("at")


# -- statistics ---------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS v FROM customer) GROUP BY 1")
def a21_mean_without_nan(spark, d):
    value = F.when(col("c_custkey") % 5 > 0, col("c_acctbal")).otherwise(float("nan"))
    rows = read(spark, d, "customer").select("c_mktsegment", F.when(~F.isnan(value), value).alias("v"))
    return rows.groupBy("c_mktsegment").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


@query("SELECT o_orderpriority, avg(ok::INTEGER) AS rate, count(*) - count(ok) AS unknown FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS ok FROM orders) GROUP BY 1")
def a22_known_rate(spark, d):
    """Share of true among the known ones."""
    ok = F.when(col("o_orderstatus") != "P", col("o_orderstatus") == "F")
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(ok.cast("int")).alias("rate"), F.count_if(ok.isNull()).alias("unknown"))


# -- matching -----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, contains(p_name, 'red') OR contains(p_name, 'bolt') AS similar FROM part")
def j18_similar_names(spark, d):
    """Two lists of names of which one holds a part of a name of the other."""
    return read(spark, d, "part").select("p_partkey", X.similar_names(F.array("p_name"), F.array(lit("red"), lit("bolt"))).alias("similar"))


@query("SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'und') AS anchored FROM documents")
def f17_anchored(spark, d):
    return read(spark, d, "documents").select("doc_id", X.any_anchor(F.array(lit("the"), lit("und")), col("text")).alias("anchored"))


@query("SELECT o_custkey, bool_or(s_suppkey IS NOT NULL) AS grounded, count(DISTINCT s_suppkey) AS in_graph, count(DISTINCT l_suppkey) AS cited FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 3000 GROUP BY 1")
def v14_grounding(spark, d):
    """Cited ids that the graph knows: whether there is one, and how many of how many."""
    cited = read(spark, d, "orders").join(read(spark, d, "lineitem"), col("l_orderkey") == col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    known = read(spark, d, "supplier").where("s_acctbal > 3000").select(col("s_suppkey").alias("l_suppkey"), lit(True).alias("known"))
    met = cited.join(known, "l_suppkey", "left").groupBy("o_custkey")
    return met.agg(F.coalesce(F.bool_or("known"), lit(False)).alias("grounded"), F.count("known").alias("in_graph"), F.count("*").alias("cited"))


@query("SELECT l_suppkey, NOT bool_or(p_brand = 'Brand#11' AND l_returnflag = 'R' OR p_brand = 'Brand#22' AND l_returnflag = 'A') AS safe FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def v15_safety(spark, d):
    """A report is safe if it names nothing that is ruled out for its case."""
    ruled_out = spark.createDataFrame([("Brand#11", "R"), ("Brand#22", "A")], "p_brand string, l_returnflag string").withColumn("hit", lit(True))
    named = read(spark, d, "lineitem").join(read(spark, d, "part"), col("p_partkey") == col("l_partkey")).select("l_suppkey", "p_brand", "l_returnflag").distinct()
    met = named.join(F.broadcast(ruled_out), ["p_brand", "l_returnflag"], "left")  # a fixed list
    return met.groupBy("l_suppkey").agg((~F.bool_or(F.coalesce("hit", lit(False)))).alias("safe"))


@query("""WITH known AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size > 10),
 arms AS (SELECT l_orderkey, l_returnflag AS arm, list(CASE WHEN l_linenumber % 3 = 0 THEN 'placebo' ELSE lower(p_name) END) AS names FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N' GROUP BY 1, 2)
 SELECT l_orderkey, 'arm ' || arm AS arm_name, coalesce((SELECT string_agg(DISTINCT x, '+' ORDER BY x) FROM (SELECT unnest(names) AS x) WHERE x IN (SELECT name FROM known)), '') AS interventions FROM arms""")
def v04_arms(spark, d):
    """Arms of every order under the vocabulary of all larger parts' names: unnamed ones go, those without a known intervention stay, empty."""
    from lodestone.operators.joins import normalised_arms

    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), col("p_partkey") == col("l_partkey"))
    said = F.when(col("l_linenumber") % 3 == 0, "placebo").otherwise(F.concat(lit(" "), F.upper("p_name")))
    arms = rows.groupBy("l_orderkey", col("l_returnflag").alias("arm")).agg(F.collect_list(said).alias("interventions"))
    arms = arms.withColumn("arm_name", F.when(col("arm") == "N", "  ").otherwise(F.concat(lit(" arm "), "arm")))
    known = read(spark, d, "part").where("p_size > 10").select(col("p_name").alias("name"))
    return normalised_arms(arms, known, "l_orderkey").select("l_orderkey", "arm_name", F.array_join("interventions", "+").alias("interventions"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'supported' WHEN o_orderkey % 4 = 1 THEN 'supported' WHEN o_orderkey % 4 = 2 THEN 'blocked' ELSE 'insufficient' END AS status,
 concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'stage' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'line' END) AS unconfirmed, o_orderkey % 4 > 1 OR o_orderstatus = 'P' OR o_orderpriority = '5-LOW' AS has_question FROM orders""")
def v11_checks(spark, d):
    """Support as a check's status, fields that the case does not confirm, and whether a question is left."""
    k = col("o_orderkey") % 4
    support = F.when(k == 0, "supported_as_written").when(k == 1, "supported_after_contextualization").when(k == 2, "contradicted").otherwise("uncertain")
    lacking = F.array_compact(F.array(F.when(col("o_orderstatus") == "P", "stage"), F.when(col("o_orderpriority") == "5-LOW", "line")))
    status = C.check_status(support)
    return read(spark, d, "orders").select("o_orderkey", status.alias("status"), F.array_join(lacking, ",").alias("unconfirmed"), ((status != "supported") | (F.size(lacking) > 0)).alias("has_question"))


RUN_ID = "CASE WHEN conv_id % 2 = 0 THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) ELSE 'run-' || conv_id END"


@query(f"SELECT {RUN_ID} AS run, turn, role, count(*) OVER (PARTITION BY conv_id) AS turns, NOT bool_or(conv_id % 3 = 0 AND turn % 4 = 1) OVER (PARTITION BY conv_id) AS valid FROM (SELECT *, md5(conv_id::VARCHAR) AS m FROM conversations) WHERE conv_id % 2 = 0")
def v30_public_ledger(spark, d):
    """Events read back without their payload, of runs that have a UUID, each with whether its run's chain holds; some are tampered with."""
    fields = ["run", "turn", "role", "text"]
    m = F.md5(col("conv_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(m, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    turns = read(spark, d, "conversations").withColumn("run", F.when(col("conv_id") % 2 == 0, uuid).otherwise(F.concat(lit("run-"), col("conv_id").cast("string"))))
    written = turns.join(L.chained(turns, "run", "turn", fields), ["run", "turn"])
    altered = F.when((col("conv_id") % 3 == 0) & (col("turn") % 4 == 1), F.concat(F.coalesce("text", lit("")), lit("!"))).otherwise(col("text"))
    stands = written.withColumn("text", altered)
    checked = L.verified(stands, "run", "turn", fields)
    return L.public_view(stands, "run", "text").join(checked, "run").select("run", "turn", "role", col("n").alias("turns"), "valid")


# -- questions ----------------------------------------------------------------------------------------------------


@query("""WITH ev AS (SELECT r_name AS gene, 'Profile ' || c_name || ' has evidence of level ' || o_orderpriority || ' in ' || c_mktsegment || '. Cited in PMID ' || string_agg(DISTINCT l_suppkey::VARCHAR, ', ' ORDER BY l_suppkey::VARCHAR) || '. Drugs: ' || string_agg(DISTINCT p_name, ', ' ORDER BY p_name) || '.' AS chunk
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' GROUP BY r_name, c_name, c_mktsegment, o_orderpriority, o_orderkey),
 tr AS (SELECT r_name AS gene, 'Trial NCT' || lpad(s_suppkey::VARCHAR, 8, '0') || ' of ' || r_name || ' tests ' || string_agg(DISTINCT p_name, ', ' ORDER BY p_name) || '.' AS chunk FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY r_name, s_suppkey),
 said AS (SELECT gene, ' ' || string_agg(DISTINCT trim(regexp_replace(lower(chunk), '[^a-z0-9]+', ' ', 'g')), ' # ') || ' ' AS t FROM (SELECT * FROM ev UNION ALL SELECT * FROM tr) GROUP BY 1),
 cd AS (SELECT DISTINCT gene, 'Drug ' || p_name || ' has companion diagnostic ' || p_brand || '.' AS chunk FROM said JOIN (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size <= 25) ON contains(t, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' '))
 SELECT gene, 'evidence' AS kind, chunk FROM ev UNION ALL SELECT gene, 'trial', chunk FROM tr UNION ALL SELECT gene, 'diagnostic', chunk FROM cd""")
def r19_scoped_chunks(spark, d):
    """The chunks of every gene's index: its evidence, its trials, and diagnostics of the drugs that these chunks name."""
    from lodestone.operators.linking import folded_words, names_in

    graph = evidence_graph(spark, d)
    path = graph.match("g", "Gene").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e", where=T.levels(T.STRONGEST))
    rows = path.hop("e", "TARGETS_DRUG", "d").df.groupBy("g__symbol", "mp__name", "mp__disease", "e__id", "e__level").agg(F.array_sort(F.collect_set("d__name")).alias("drugs"))
    cited = graph.edges["CITED_IN"].table.groupBy(col("src").alias("e__id")).agg(F.array_sort(F.collect_set(col("dst").cast("string"))).alias("pmids"))
    text = F.concat(lit("Profile "), "mp__name", lit(" has evidence of level "), "e__level", lit(" in "), "mp__disease", lit(". Cited in PMID "), F.array_join("pmids", ", "), lit(". Drugs: "), F.array_join("drugs", ", "), lit("."))
    evidence = rows.join(cited, "e__id").select(col("g__symbol").alias("gene"), lit("evidence").alias("kind"), text.alias("chunk"))
    tested = graph.match("t", "ClinicalTrial").hop("t", "ASSOCIATED_GENE", "g").hop("t", "TESTS_DRUG", "d").df.groupBy("g__symbol", "t__nct_id").agg(F.array_sort(F.collect_set("d__name")).alias("drugs"))
    trials = tested.select(col("g__symbol").alias("gene"), lit("trial").alias("kind"), F.concat(lit("Trial "), "t__nct_id", lit(" of "), "g__symbol", lit(" tests "), F.array_join("drugs", ", "), lit(".")).alias("chunk"))
    chunks = evidence.union(trials)
    devices = graph.match("d", "Drug").hop("d", "HAS_COMPANION_DIAGNOSTIC", "x").df.select(col("d__name").alias("alias"), col("x__id").alias("device")).distinct()
    named = names_in(chunks.select("gene", col("chunk").alias("text")), ["gene"], devices.select("alias").distinct(), 5, folded_words).select("gene", "key").distinct()
    met = named.join(devices.withColumn("key", F.array_join(folded_words(col("alias")), " ")), "key")
    return chunks.union(met.select("gene", lit("diagnostic"), F.concat(lit("Drug "), "alias", lit(" has companion diagnostic "), "device", lit(".")).alias("chunk")).distinct())


@query("SELECT qid, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS score, pid FROM (SELECT s_nationkey AS qid, s_suppkey AS pid, s_acctbal AS score, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS hi FROM supplier)")
def w04_scaled(spark, d):
    rows = read(spark, d, "supplier").select(col("s_nationkey").alias("qid"), col("s_suppkey").alias("pid"), col("s_acctbal").alias("score"))
    return R.scaled(rows).withColumn("score", F.round("score", 6))


@query("SELECT c_nationkey AS anchor, 'x' || c_nationkey AS node, min(c_custkey) AS first_seen FROM customer GROUP BY 1")
def f26_first_seen(spark, d):
    """Distinct values in the order in which they come up."""
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    first = read(spark, d, "customer").withColumn("k", k).where("k = 1")
    return first.select(col("c_nationkey").alias("anchor"), F.concat(lit("x"), col("c_nationkey").cast("string")).alias("node"), col("c_custkey").alias("first_seen"))


@query("SELECT o_orderpriority AS level, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS p, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) / nullif(count(*) FILTER (WHERE o_orderkey % 2 = 0), 0) AS r FROM orders GROUP BY 1)")
def f18_scores(spark, d):
    """Precision, recall and F1 with zero guards."""
    said, true = col("o_orderstatus") == "F", col("o_orderkey") % 2 == 0
    n = read(spark, d, "orders").groupBy(col("o_orderpriority").alias("level")).agg(F.count_if(said & true).alias("hit"), F.count_if(said).alias("np"), F.count_if(true).alias("ng"))
    p, r, f1 = rules.scores(col("hit"), col("np"), col("ng"))
    return n.select("level", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


SKIPPED = ("red", "steel")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'steel'))")
def pf16_skipped_names(spark, d):
    """Names that hold none of the words to be skipped."""
    return read(spark, d, "part").where(~T.any_keyword(col("p_name"), list(SKIPPED))).select("p_partkey", "p_name")


@query("SELECT 'ev_' || left(o_orderpriority || '_' || o_orderstatus, 7) AS id, arg_min(o_orderpriority || '_' || o_orderstatus, o_orderkey) AS label, count(DISTINCT o_orderpriority || '_' || o_orderstatus) AS names FROM orders GROUP BY 1")
def f23_truncated_ids(spark, d):
    """Nodes that are named by a cut identity: of names that fall together the first is the label."""
    name = F.concat_ws("_", "o_orderpriority", "o_orderstatus")
    rows = read(spark, d, "orders").select(F.concat(lit("ev_"), F.left(name, lit(7))).alias("id"), name.alias("name"), "o_orderkey")
    return rows.groupBy("id").agg(F.min_by("name", "o_orderkey").alias("label"), F.count_distinct("name").alias("names"))
