"""Routing, serialising, policies, audits and experiments over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import cases as C
from lodestone.operators import retrieval as R
from lodestone.operators import traversal as V
from lodestone.plans import templates as T
from lodestone.plans.graph import top
from lodestone.plans.registry import query
from lodestone.plans.template_queries import DRUG, KWS, LV, OPUB, SPINE
from lodestone.sources.projection import evidence_graph, read

col, lit = F.col, F.lit

RULES = [(("trial", "the in"), "GENE_TO_TRIALDRUG"), (("variant", "tion and"), "VARIANT_TO_DRUG"), (("disease", " of "), "GENE_TO_DISEASE")]


@query("SELECT item_id, CASE WHEN contains(t, 'trial') OR contains(t, 'the in') THEN 'GENE_TO_TRIALDRUG' WHEN contains(t, 'variant') OR contains(t, 'tion and') THEN 'VARIANT_TO_DRUG' WHEN contains(t, 'disease') OR contains(t, ' of ') THEN 'GENE_TO_DISEASE' ELSE 'GENE_TO_DRUG' END AS route FROM (SELECT item_id, lower(text) AS t FROM benchmark)")
def f07_routed(spark, d):
    return read(spark, d, "benchmark").select("item_id", C.routed(col("text"), RULES).alias("route"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'GENE_TO_CDX' WHEN 1 THEN 'VARIANT_TO_DRUG' ELSE 'GENE_TO_DRUG' END AS route FROM orders")
def f08_route_label(spark, d):
    answer = F.when(col("o_orderkey") % 3 == 0, " gene_to_cdx.\n").when(col("o_orderkey") % 3 == 1, "**VARIANT_TO_DRUG**").otherwise("no idea")
    return read(spark, d, "orders").select("o_orderkey", C.route_label(answer).alias("route"))


@query(f"SELECT DISTINCT CASE WHEN d.p_size <= 25 THEN n.n_name || ' has evidence for ' || d.p_name || '.' ELSE n.n_name || ' -> ' || c.c_mktsegment || ' -> ' || d.p_name END AS sentence FROM {SPINE} {DRUG} WHERE r.r_name = 'EUROPE' AND {KWS} AND {LV}")
def f09_sentences(spark, d):
    path = T.point(evidence_graph(spark, d), "EUROPE", None, ["build"]).hop("e", "TARGETS_DRUG", "d")
    leaf = F.when(col("d__approved"), "Drug").otherwise("Other")
    return path.df.select(C.sentence(lit("Variant"), leaf, F.array("v__name", "mp__disease", "d__name"), {("Variant", "Drug"): (" has evidence for ", ".")}).alias("sentence")).distinct()


@query("SELECT o_orderkey, concat_ws(' ', 'Evidence ' || o_orderkey || '.', CASE WHEN o_orderstatus <> 'P' THEN 'Status: ' || o_orderstatus || '.' END, 'Level: ' || o_orderpriority || '.') AS chunk FROM orders")
def f24_chunks(spark, d):
    text = F.concat_ws(" ", F.concat(lit("Evidence "), col("o_orderkey").cast("string"), lit(".")), F.when(col("o_orderstatus") != "P", F.concat(lit("Status: "), "o_orderstatus", lit("."))), F.concat(lit("Level: "), "o_orderpriority", lit(".")))
    return read(spark, d, "orders").select("o_orderkey", text.alias("chunk"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'structuralVariants' WHEN p_partkey % 3 = 1 THEN 'copyNumberAlterations' ELSE 'mutations/byProteinChange' END AS endpoint, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS gene_a, CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_type = 'SMALL' THEN 'AMPLIFICATION' ELSE 'DELETION' END END AS change FROM part")
def f27_annotation(spark, d):
    kind = F.when(col("p_partkey") % 3 == 0, "fusion").when(col("p_partkey") % 3 == 1, "cna").otherwise("point_mutation")
    variant = F.when(col("p_type") == "SMALL", "Amplification").otherwise("loss")
    m = C.annotation(kind, col("p_brand"), variant)
    return read(spark, d, "part").select("p_partkey", F.element_at(m, "endpoint").alias("endpoint"), F.element_at(m, "hugoSymbolA").alias("gene_a"), F.element_at(m, "copyNameAlterationType").alias("change"))


@query("SELECT p_partkey, p_size < 20 AND NOT (contains(p_name, 'red') OR contains(p_name, 'blue')) AS is_new FROM part")
def f28_new_treatments(spark, d):
    level = F.when(col("p_size") < 20, "LEVEL_1").otherwise("LEVEL_3A")
    first = F.slice(F.split("p_name", " "), 1, 1)
    return read(spark, d, "part").select("p_partkey", C.new_treatments(level, first, F.array(lit("red"), lit("blue"))).alias("is_new"))


@query("SELECT c_custkey, coalesce(f.n, 0) AS done, coalesce(o.n, 0) AS open FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON o.o_custkey = c_custkey")
def j24_side_by_side(spark, d):
    """Results of two systems beside the full list of cases, in one aggregation."""
    counts = read(spark, d, "orders").groupBy(col("o_custkey").alias("c_custkey")).agg(F.count_if(col("o_orderstatus") == "F").alias("done"), F.count_if(col("o_orderstatus") == "O").alias("open"))
    return read(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0)


@query("SELECT a.conv_id, a.turn, a.role AS asked, b.role AS answered FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) b ON a.conv_id = b.conv_id AND b.k = a.k + 1")
def j25_positional(spark, d):
    """Each turn with the one at the next position."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", col("role").alias("asked"), F.lead("role").over(w).alias("answered")).where("answered is not null")


@query("SELECT c_nationkey, any_value(n) AS n, list_has_any(a, b) AS overlap, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM (SELECT c_nationkey, count(*) AS n, list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal > 9000) AS a, list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal < 2000) AS b FROM customer GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY c_nationkey, a, b")
def u06_subsets(spark, d):
    pick = lambda c: F.collect_set(F.when(c, col("c_mktsegment")))
    s = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), pick(col("c_acctbal") > 9000).alias("a"), pick(col("c_acctbal") < 2000).alias("b")).where("size(a) > 0 and size(b) > 0")
    return s.select("c_nationkey", "n", F.arrays_overlap("a", "b").alias("overlap"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


@query("SELECT 'events' AS name, count(*) AS n, NULL::BIGINT AS extra FROM events UNION ALL SELECT 'orders', count(*), max(o_orderkey) FROM orders")
def u02_concat(spark, d):
    a = read(spark, d, "events").agg(F.count("*").alias("n")).withColumn("name", lit("events"))
    b = read(spark, d, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("extra")).withColumn("name", lit("orders"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT p_name, row_number() OVER (ORDER BY k)::INTEGER AS id, (row_number() OVER (ORDER BY k) + 100000)::INTEGER AS device_id FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)")
def w10_surrogate_ids(spark, d):
    """Ids in first-seen order: keys fall in a thousand ranges, and each range counts on from the totals of those before."""
    names = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    parted = names.crossJoin(names.agg((F.max("k") + 1).alias("end"))).withColumn("part", F.expr("(k * 1000) div end"))  # one row
    sizes = parted.groupBy("part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # over the thousand totals
    before = sizes.select("part", F.coalesce(upto, lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("k"))
    out = parted.join(before, "part").withColumn("id", (nth + col("before")).cast("int"))
    return out.select("p_name", "id", (col("id") + 100000).alias("device_id"))


@query("SELECT o_orderpriority AS system, round(a, 4) AS base, round(b - a, 4) AS delta, round(b / a, 6) AS speedup FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1)")
def w13_deltas(spark, d):
    t = read(spark, d, "orders").groupBy(col("o_orderpriority").alias("system")).pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return t.select("system", F.round("F", 4).alias("base"), F.round(col("O") - col("F"), 4).alias("delta"), F.round(col("O") / col("F"), 6).alias("speedup"))


# -- retrieval experiments ----------------------------------------------------------------------------------------


@query("""SELECT l_suppkey, CASE WHEN np > 0 THEN hit / np ELSE 0 END AS precision, CASE WHEN ng > 0 THEN found / ng ELSE 0 END AS recall, np > 0 AND hit = np AND found = ng AS exact FROM (SELECT l_suppkey, len(p) AS np, len(g) AS ng, len(list_filter(p, lambda x: len(list_filter(g, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS hit, len(list_filter(g, lambda y: len(list_filter(p, lambda x: contains(x, y) OR contains(y, x))) > 0)) AS found
 FROM (SELECT l_suppkey, coalesce(list(DISTINCT p_name) FILTER (WHERE l_returnflag = 'A'), []) AS p, coalesce(list(DISTINCT split_part(p_name, ' ', 1)) FILTER (WHERE l_returnflag = 'R'), []) AS g FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1))""")
def r10_answer_scores(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), col("p_partkey") == col("l_partkey"))
    lists = rows.groupBy("l_suppkey").agg(F.collect_set(F.when(col("l_returnflag") == "A", col("p_name"))).alias("p"), F.collect_set(F.when(col("l_returnflag") == "R", F.split_part("p_name", lit(" "), lit(1)))).alias("g"))
    precision, recall, _, exact = C.answer_scores(col("p"), col("g"))
    return lists.select("l_suppkey", precision.alias("precision"), recall.alias("recall"), exact.alias("exact"))


@query(f"SELECT gene, string_agg(name, ', ' ORDER BY name) AS answer, sum(words)::BIGINT AS words FROM (SELECT *, sum(words) OVER (PARTITION BY gene ORDER BY name) AS upto, row_number() OVER (PARTITION BY gene ORDER BY name) AS k FROM (SELECT DISTINCT r.r_name AS gene, d.p_name AS name, len(string_split(d.p_name, ' ')) + 1 AS words FROM {SPINE} {DRUG} WHERE {LV})) WHERE k = 1 OR upto <= 40 GROUP BY 1")
def r07_multi_answer(spark, d):
    """Answer sets by frontier, sorted and packed under a word budget; a name costs a word more than it has."""
    path = evidence_graph(spark, d).match("g", "Gene").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e", where=T.levels(T.LEVELS)).hop("e", "TARGETS_DRUG", "d")
    names = path.df.select(col("g__symbol").alias("qid"), col("d__name").alias("text")).distinct()
    ranked = names.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("text")))
    taken = R.packed(ranked, 40, F.size(F.split("text", " ")) + 1, stop_when_full=False)
    return taken.groupBy(col("qid").alias("gene")).agg(F.array_join(F.array_sort(F.collect_list("text")), ", ").alias("answer"), F.sum("words").alias("words"))


# -- policies, states, audits -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT a THEN 'assess_complexity' END, CASE WHEN NOT i THEN 'interpret_variant' END, CASE WHEN i AND NOT t THEN 'identify_targets' END, CASE WHEN i THEN 'check_resistance' END, CASE WHEN i AND t THEN 'match_trials' END, CASE WHEN i AND o_orderkey % 7 = 0 THEN 'enrich_oncokb' END, CASE WHEN i AND t THEN 'finish' END], lambda x: x IS NOT NULL), ',') AS tools
 FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS i, o_orderkey % 5 = 0 AS t FROM orders)""")
def v23_allowed_tools(spark, d):
    key = col("o_orderkey")
    done = F.array_compact(F.array(F.when(key % 2 == 0, "assess_complexity"), F.when(key % 3 == 0, "interpret_variant"), F.when(key % 5 == 0, "identify_targets")))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(C.allowed_tools(done, key % 7 == 0, ("interpret_variant", "identify_targets")), ",").alias("tools"))


@query("SELECT o_custkey, 'llm_core' AS source, 'cited_' || (k - 1) AS target, o_orderkey AS pmid FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 8")
def v25_citation_star(spark, d):
    """The first eight cited ids of each report as a star."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return read(spark, d, "orders").withColumn("k", k).where("k <= 8").select("o_custkey", lit("llm_core").alias("source"), F.concat(lit("cited_"), (col("k") - 1).cast("string")).alias("target"), col("o_orderkey").alias("pmid"))


@query(f"SELECT n.n_name AS subject, coalesce(string_agg(DISTINCT d.p_name, ', ' ORDER BY d.p_name), c.c_name) AS object, CASE WHEN p.s_suppkey IS NOT NULL THEN 'PMID:' || p.s_suppkey END AS source_id, e.o_orderkey AS evidence_id FROM {SPINE} {DRUG} {OPUB} WHERE r.r_name = 'EUROPE' AND {KWS} AND {LV} GROUP BY n.n_name, c.c_name, p.s_suppkey, e.o_orderkey")
def v26_evidence_items(spark, d):
    path = T.point(evidence_graph(spark, d), "EUROPE", None, ["build"]).hop("e", "TARGETS_DRUG", "d").hop("e", "CITED_IN", "p", optional=True)
    g = path.df.groupBy(col("v__name").alias("subject"), "mp__name", "p__pmid", col("e__id").alias("evidence_id")).agg(F.array_sort(F.collect_set("d__name")).alias("t"))
    return g.select("subject", F.coalesce(F.when(F.size("t") > 0, F.array_join("t", ", ")), col("mp__name")).alias("object"), C.evidence_source(col("p__pmid")).alias("source_id"), "evidence_id")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS gene, CASE c_nationkey % 3 WHEN 0 THEN 'NSCLC' WHEN 1 THEN 'melanoma' ELSE 'other' END AS tumour, 'first-line' AS line FROM customer")
def v27_case_state(spark, d):
    """A case row as the state it starts with: tumour names mapped, pseudo-genes blank, defaults filled."""
    names = F.create_map(*[lit(x) for kv in {0: "NSCLC", 1: "melanoma"}.items() for x in kv])
    tumour = F.coalesce(F.element_at(names, (col("c_nationkey") % 3).cast("int")), lit("other"))
    return read(spark, d, "customer").select("c_custkey", F.when(col("c_mktsegment") == "MACHINERY", "").otherwise(col("c_mktsegment")).alias("gene"), tumour.alias("tumour"), lit("first-line").alias("line"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F')::INTEGER AS n_results, count(*) FILTER (WHERE o_orderstatus = 'O')::INTEGER AS n_trials, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS done FROM orders GROUP BY 1")
def v28_observations(spark, d):
    some = lambda s: F.collect_list(F.when(col("o_orderstatus") == s, col("o_orderkey")))
    state = read(spark, d, "orders").groupBy("o_custkey").agg(some("F").alias("results"), some("O").alias("trials"), F.collect_set("o_orderpriority").alias("tools"))
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<bigint>")))
    return state.select("o_custkey", size("results").alias("n_results"), size("trials").alias("n_trials"), F.array_join(F.array_sort("tools"), ",").alias("done"))


TIERS = ("IA", "IB", "IIA", "III", "IV")


@query("""SELECT c_custkey, contains(report, 'red') AND contains(report, 'bolt') AS drug_found, list_contains(cited, c_custkey % 10 + 1) AS anchor_cited, len(cited) AS n_cited, len(cited) - known AS n_unknown, (len(cited) - known) / len(cited) AS rate, ['IA', 'IB', 'IIA', 'III', 'IV'][level] = ['IA', 'IB', 'IIA', 'III', 'IV'][c_nationkey % 5 + 1] AS tier_match
 FROM (SELECT c_custkey, c_nationkey, string_agg(DISTINCT p_name, ' ') AS report, list(DISTINCT l_suppkey) AS cited, count(DISTINCT l_suppkey) FILTER (WHERE s_acctbal > 3000) AS known, min(o_orderpriority)[1]::INTEGER AS level FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)""")
def v16_report_metrics(spark, d):
    """Of a report's text: are all parts of the expected drug there, is the anchor cited, how many cited ids are unknown, does the tier match."""
    rows = read(spark, d, "customer").join(read(spark, d, "orders"), col("o_custkey") == col("c_custkey")).join(read(spark, d, "lineitem"), col("l_orderkey") == col("o_orderkey"))
    rows = rows.join(read(spark, d, "part"), col("p_partkey") == col("l_partkey")).join(read(spark, d, "supplier"), col("s_suppkey") == col("l_suppkey"))
    per = rows.groupBy("c_custkey", "c_nationkey").agg(
        F.collect_set("p_name").alias("names"), F.collect_set("l_suppkey").alias("ids"), F.collect_set(F.when(col("s_acctbal") > 3000, col("l_suppkey"))).alias("known"), F.min("o_orderpriority").alias("level")
    )
    tier = lambda at: F.element_at(F.array(*map(lit, TIERS)), at.cast("int"))
    cites = F.transform("ids", lambda x: F.concat(lit("PMID: "), x.cast("string")))
    report = per.select("c_custkey", "c_nationkey", "known", F.concat_ws(" ", F.array_join("names", " "), F.array_join(cites, ", "), lit("ESCAT"), tier(F.left("level", lit(1)))).alias("report"))
    return report.select("c_custkey", *C.report_metrics(col("report"), lit("Red / Bolt"), col("c_custkey") % 10 + 1, col("known"), tier(col("c_nationkey") % 5 + 1)))


@query(f"SELECT n.n_name AS variant, e.o_orderpriority AS level, ld.l_returnflag AS significance, d.p_name AS drug, coalesce(c.c_mktsegment, 'none') AS disease, count(*) AS n FROM {SPINE} {DRUG} WHERE r.r_name = 'EUROPE' AND e.o_orderstatus = 'F' GROUP BY ALL")
def q29_coverage_point(spark, d):
    path = evidence_graph(spark, d).match("g", "Gene", col("symbol") == "EUROPE").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e", where="statement = 'F'").hop("e", "TARGETS_DRUG", "d")
    keys = {"variant": "v__name", "level": "e__level", "significance": "d__rel__significance", "drug": "d__name"}
    return path.df.groupBy(*[col(v).alias(k) for k, v in keys.items()], F.coalesce("mp__disease", lit("none")).alias("disease")).agg(F.count("*").alias("n"))


@query("SELECT a, count(*) FILTER (WHERE k <= 3)::BIGINT AS kept, max(l)::INTEGER AS longest FROM (SELECT c_nationkey AS a, length(c_name) AS l, row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_name) DESC, c_name) AS k FROM customer) GROUP BY 1")
def f06_longest_names(spark, d):
    """Of the names that fit, the three longest of each group."""
    rows = read(spark, d, "customer").select(col("c_nationkey").alias("a"), "c_name")
    k = F.row_number().over(Window.partitionBy("a").orderBy(F.length("c_name").desc(), "c_name"))
    return rows.withColumn("k", k).groupBy("a").agg(F.count_if(col("k") <= 3).alias("kept"), F.max(F.length("c_name")).alias("longest"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey LIMIT 20")
def l05_mixed_order(spark, d):
    return top(read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), 20, F.desc("c_mktsegment"), F.asc_nulls_last("c_acctbal"), col("c_custkey")).drop("c_mktsegment")


@query("WITH RECURSIVE w AS (SELECT 's' || s_suppkey AS anchor, 'n' || s_nationkey AS node FROM supplier) SELECT anchor, 'r' || n_regionkey AS node FROM w JOIN nation ON node = 'n' || n_nationkey")
def r06_terminal(spark, d):
    """What is reached against the direction of the edges."""
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    edges = s.select(F.concat(lit("n"), "s_nationkey").alias("src"), lit("N").alias("rel"), F.concat(lit("s"), "s_suppkey").alias("dst")).union(n.select(F.concat(lit("r"), "n_regionkey"), lit("R"), F.concat(lit("n"), "n_nationkey")))
    start = s.select(F.concat(lit("s"), "s_suppkey").alias("anchor")).withColumn("node", col("anchor"))
    return V.reach(start, edges, [("N", True), ("R", True)])
