"""The templates over the projected graph, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans import templates as T
from lodestone.plans.graph import top
from lodestone.plans.registry import query
from lodestone.sources.projection import evidence_graph as graph

GENE, VARIANT, DRIVER, KW = "EUROPE", "NATION_3", "NATION_8", ["build"]
# Fixed SQL fragments that the checks share.
SPINE = "region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders e ON e.o_custkey = c.c_custkey"
MP = "customer c JOIN orders e ON e.o_custkey = c.c_custkey"
LV = "e.o_orderpriority IN ('1-URGENT', '2-HIGH')"
KWS = "contains(lower(c.c_mktsegment), 'build')"
POINT = f"{SPINE} WHERE r.r_name = '{{gene}}' AND n.n_name = '{{variant}}' AND {KWS} AND {LV}"
DRUG = "JOIN lineitem ld ON ld.l_orderkey = e.o_orderkey JOIN part d ON d.p_partkey = ld.l_partkey"
PUB = "JOIN lineitem lp ON lp.l_orderkey = e.o_orderkey JOIN supplier p ON p.s_suppkey = lp.l_suppkey"
ODRUG = "LEFT JOIN (lineitem ld JOIN part d ON d.p_partkey = ld.l_partkey) ON ld.l_orderkey = e.o_orderkey"
OPUB = "LEFT JOIN (lineitem lp JOIN supplier p ON p.s_suppkey = lp.l_suppkey) ON lp.l_orderkey = e.o_orderkey"
DEVICE = "(SELECT p_brand AS id, min(p_type) AS platform FROM part GROUP BY 1)"
ODEVICE = f"LEFT JOIN (SELECT p_partkey, id, platform FROM part JOIN {DEVICE} dv ON dv.id = p_brand WHERE p_size <= 25) cd ON cd.p_partkey = d.p_partkey"
SEG = "['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']"
TRIALS = f"""(SELECT s_suppkey, s_nationkey, 'NCT' || lpad(s_suppkey::VARCHAR, 8, '0') AS nct_id, s_name AS title, 'PHASE' || (s_suppkey % 4 + 1) AS phase,
  CASE WHEN s_acctbal > 0 THEN 'RECRUITING' ELSE 'COMPLETED' END AS status, [{SEG}[s_suppkey % 5 + 1], {SEG}[(s_suppkey + 2) % 5 + 1]] AS conditions, [{SEG}[(s_suppkey + 1) % 5 + 1]] AS keywords FROM supplier)"""
TESTS = "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"
ANYC = "len(list_filter({}, lambda x: contains(lower(x), 'build'))) > 0"
CITED = """SELECT e.o_orderpriority AS evidence_level, c.c_mktsegment AS disease, e.o_orderstatus AS evidence_statement, p.s_suppkey AS pmid, p.s_name AS citation_text,
  c.c_name AS molecular_profile, e.o_orderkey AS evidence_id, coalesce(string_agg(DISTINCT d.p_name, ',' ORDER BY d.p_name), '') AS therapies"""
CITED_ORDER = "ORDER BY evidence_level, length(molecular_profile), evidence_level, disease, evidence_statement, pmid, citation_text, molecular_profile, evidence_id, therapies LIMIT 15"
TARGET = "SELECT d.p_name AS drug_name, d.p_size <= 25 AS approved, cd.id AS companion_diagnostic, cd.platform AS cd_platform, e.o_orderpriority AS evidence_level"
RESIST = "SELECT {v} AS variant, e.o_orderpriority AS evidence_level, c.c_mktsegment AS disease, e.o_orderstatus AS statement, p.s_suppkey AS pmid, p.s_name AS citation_text, d.p_name AS drug_name"
RORDER = "ORDER BY evidence_level, {more} variant, evidence_level, disease, statement, pmid, citation_text, drug_name LIMIT {n}"
PROFILE_WHERE = f"contains(lower(c.c_name), 'customer') AND contains(lower(c.c_name), '1') AND {KWS} AND {LV}"
BIO_WHERE = f"lower(replace(c.c_name, '-', ' ')) = 'customer#000000013' AND {LV}"


def at(variant=VARIANT):
    return POINT.format(gene=GENE, variant=variant)


def _point(spark, d, variant=VARIANT, names=T.LEVELS):
    return T.point(graph(spark, d), GENE, variant, KW, names)


def _profile(spark, d, names=T.LEVELS):
    return T.profile(graph(spark, d), T.both_in_name("Customer", "1"), KW, names)


def _biomarker(spark, d):
    return T.profile(graph(spark, d), T.biomarker_name("Customer#000000013"), [""])


PRE = "SELECT count(DISTINCT e.o_orderkey) AS n_evidence, coalesce(string_agg(DISTINCT ld.l_returnflag, ',' ORDER BY ld.l_returnflag), '') AS significances"


@query(f"""SELECT * FROM ({PRE} FROM {SPINE} {ODRUG} WHERE r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {LV}),
 (SELECT count(DISTINCT t.nct_id) AS n_trials FROM {TRIALS} t JOIN nation tn ON tn.n_nationkey = t.s_nationkey JOIN region tr ON tr.r_regionkey = tn.n_regionkey WHERE tr.r_name = '{GENE}' AND {ANYC.format('t.conditions')})""")
def q01_pre_point(spark, d):
    return T.pre_point(graph(spark, d), GENE, VARIANT, KW)


@query(f"{PRE}, 0::BIGINT AS n_trials FROM {MP} {ODRUG} WHERE {PROFILE_WHERE}")
def q02_pre_profile(spark, d):
    return T.pre_profile(_profile(spark, d))


@query(f"{PRE}, 0::BIGINT AS n_trials FROM {MP} {ODRUG} WHERE {BIO_WHERE}")
def q03_pre_biomarker(spark, d):
    return T.pre_profile(_biomarker(spark, d))


@query(f"SELECT * FROM ({CITED} FROM {SPINE} {PUB} {ODRUG} WHERE r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {LV} GROUP BY ALL) {CITED_ORDER}")
def q04_variant_point(spark, d):
    return T.variant_evidence(_point(spark, d))


@query(f"SELECT * FROM ({CITED} FROM {MP} {PUB} {ODRUG} WHERE {PROFILE_WHERE} GROUP BY ALL) {CITED_ORDER}")
def q05_variant_profile(spark, d):
    return T.variant_evidence(_profile(spark, d))


@query(f"{CITED} FROM {MP} {PUB} {ODRUG} WHERE {BIO_WHERE} GROUP BY ALL {CITED_ORDER.replace('length(molecular_profile),', '')}")
def q06_variant_biomarker(spark, d):
    return T.variant_evidence(_biomarker(spark, d), by_length=False)


@query(f"{TARGET} FROM {SPINE} {DRUG} {ODEVICE} WHERE ld.l_returnflag = 'A' AND r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {LV}")
def q07_target_point(spark, d):
    return T.targets(_point(spark, d))


@query(f"{TARGET} FROM {MP} {DRUG} {ODEVICE} WHERE ld.l_returnflag = 'A' AND {PROFILE_WHERE}")
def q08_target_profile(spark, d):
    return T.targets(_profile(spark, d))


@query(f"{TARGET} FROM {MP} {DRUG} {ODEVICE} WHERE ld.l_returnflag = 'A' AND {BIO_WHERE}")
def q09_target_biomarker(spark, d):
    return T.targets(_biomarker(spark, d))


TRIAL_ROWS = f"""SELECT t.nct_id, t.title, t.phase, t.status, td.p_name AS drug_tested FROM {TRIALS} t JOIN nation tn ON tn.n_nationkey = t.s_nationkey JOIN region tr ON tr.r_regionkey = tn.n_regionkey
 LEFT JOIN (SELECT * FROM {TESTS} ts JOIN part ON p_partkey = ts.l_partkey WHERE {{drugs}}) td ON td.l_suppkey = t.s_suppkey WHERE tr.r_name = '{GENE}' AND {{cond}} ORDER BY phase DESC NULLS FIRST, nct_id, title, phase, status, drug_tested LIMIT 5"""


def _names(spark, d):
    return [r[0] for r in spark.read.parquet(f"{d}/part.parquet").where("p_partkey in (1, 2, 3)").select("p_name").collect()]


@query(f"""WITH x AS ({TRIAL_ROWS.format(drugs="p_name IN (SELECT p_name FROM part WHERE p_partkey IN (1, 2, 3))", cond=f"({ANYC.format('t.conditions')} OR {ANYC.format('t.keywords')})")})
 SELECT nct_id, min(title) AS title, min(phase) AS phase, min(status) AS status, coalesce(string_agg(DISTINCT drug_tested, ',' ORDER BY drug_tested), '') AS drug_tested FROM x GROUP BY 1""")
def q10_trials(spark, d):
    return T.trials_once(T.trials_for(graph(spark, d), GENE, KW, _names(spark, d)))


@query(f"{RESIST.format(v='n.n_name')} FROM {SPINE} {DRUG} {OPUB} WHERE ld.l_returnflag = 'R' AND r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {LV} {RORDER.format(more='', n=5)}")
def q11_resistance_point(spark, d):
    return T.resistance(_point(spark, d), "v__name")


@query(f"{RESIST.format(v='c.c_name')} FROM {MP} {DRUG} {OPUB} WHERE ld.l_returnflag = 'R' AND {PROFILE_WHERE} {RORDER.format(more='', n=5)}")
def q12_resistance_profile(spark, d):
    return T.resistance(_profile(spark, d), "mp__name")


@query(f"{RESIST.format(v='c.c_name')} FROM {MP} {DRUG} {OPUB} WHERE ld.l_returnflag = 'R' AND {BIO_WHERE} {RORDER.format(more='', n=5)}")
def q13_resistance_biomarker(spark, d):
    return T.resistance(_biomarker(spark, d), "mp__name")


@query(f"SELECT DISTINCT * FROM ({RESIST.format(v='n.n_name')} FROM {SPINE} {DRUG} {OPUB} WHERE ld.l_returnflag = 'R' AND r.r_name = '{GENE}' AND {KWS} AND {LV}) {RORDER.format(more='variant,', n=15)}")
def q14_resistance_gene(spark, d):
    return T.resistance(_point(spark, d, None), "v__name", 15, once=True)


@query(f"""SELECT coalesce(string_agg(x, ',' ORDER BY x), '') AS exclude_drugs FROM (SELECT DISTINCT d.p_name AS x FROM {SPINE} {DRUG} WHERE ld.l_returnflag = 'A' AND r.r_name = '{GENE}' AND n.n_name = '{DRIVER}' AND {KWS} AND {LV}
 EXCEPT SELECT d.p_name FROM {SPINE} {DRUG} WHERE ld.l_returnflag = 'A' AND r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {LV})""")
def q15_exclude_drugs(spark, d):
    return T.exclude_drugs(graph(spark, d), GENE, DRIVER, VARIANT, KW)


@query(f"SELECT DISTINCT p.s_suppkey AS pmid, p.s_name AS citation_text FROM supplier p JOIN lineitem l ON l.l_suppkey = p.s_suppkey JOIN orders e ON e.o_orderkey = l.l_orderkey WHERE {LV} AND p.s_suppkey IN (1, 5, 9, 999999)")
def q16_verify_pmids(spark, d):
    return T.verified_pmids(graph(spark, d), [1, 5, 9, 999999])


SUB = """SELECT {g} AS gene, {v} AS variant, c.c_custkey AS mp_id, c.c_name AS mp_name, e.o_orderkey AS evidence_id, e.o_orderpriority AS evidence_level, ld.l_returnflag AS significance, c.c_mktsegment AS disease,
  p.s_suppkey AS pmid, p.s_name AS citation, d.p_name AS drug_name, d.p_size <= 25 AS approved, cd.id AS device"""
SUB_ORDER = "ORDER BY evidence_level, gene, variant, mp_id, mp_name, evidence_id, evidence_level, significance, disease, pmid, citation, drug_name, approved, device LIMIT 40"
URGENT = "e.o_orderpriority IN ('1-URGENT')"
SUB_POINT = f"{SUB.format(g='r.r_name', v='n.n_name')} FROM {SPINE} {ODRUG} {ODEVICE} {OPUB} WHERE r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {URGENT} {SUB_ORDER}"


@query(SUB_POINT)
def q17_subgraph_point(spark, d):
    return T.subgraph(_point(spark, d, names=T.STRONGEST), GENE, VARIANT)


@query(f"{SUB.format(g='NULL::VARCHAR', v='NULL::VARCHAR')} FROM {MP} {ODRUG} {ODEVICE} {OPUB} WHERE {PROFILE_WHERE.replace(LV, URGENT)} {SUB_ORDER}")
def q18_subgraph_profile(spark, d):
    return T.subgraph(_profile(spark, d, T.STRONGEST), None, None)


@query(TRIAL_ROWS.format(drugs="TRUE", cond=ANYC.format("t.conditions")))
def q19_subgraph_trials(spark, d):
    return T.trials_for(graph(spark, d), GENE, KW, None, ("conditions",))


@query(f"SELECT DISTINCT n.n_name AS variant, e.o_orderpriority AS level, c.c_mktsegment AS disease, d.p_name AS drug FROM {SPINE} {DRUG} WHERE ld.l_returnflag = 'R' AND r.r_name = '{GENE}' AND {KWS} AND {URGENT} ORDER BY level, variant, level, disease, drug LIMIT 10")
def q20_subgraph_resistance(spark, d):
    path = _point(spark, d, None, T.STRONGEST).hop("e", "TARGETS_DRUG", "d", rel_where="significance = 'R'")
    return top(path.select(variant="v__name", level="e__level", disease="mp__disease", drug="d__name").distinct(), 10, F.col("level").asc_nulls_last())


@query(f"""SELECT c.c_name AS profile, e.o_orderpriority AS level, c.c_mktsegment AS disease, e.o_orderstatus AS statement, e.o_orderkey AS evidence_id,
  coalesce(string_agg(DISTINCT p.s_suppkey::VARCHAR, ',' ORDER BY p.s_suppkey::VARCHAR), '') AS pmids, coalesce(string_agg(DISTINCT p.s_name, ',' ORDER BY p.s_name), '') AS citations, coalesce(string_agg(DISTINCT d.p_name, ',' ORDER BY d.p_name), '') AS drugs
  FROM {MP} {ODRUG} {OPUB} WHERE contains(lower(c.c_name), '#00000001') GROUP BY ALL""")
def q21_chunk_evidence(spark, d):
    path = graph(spark, d).match("mp", "MolecularProfile", T.both_in_name("#00000001", "")).hop("mp", "HAS_EVIDENCE", "e").hop("e", "TARGETS_DRUG", "d", optional=True).hop("e", "CITED_IN", "p", optional=True)
    keys = {"profile": "mp__name", "level": "e__level", "disease": "mp__disease", "statement": "e__statement", "evidence_id": "e__id"}
    return path.df.withColumn("p__id", F.col("p__pmid").cast("string")).groupBy(*[F.col(v).alias(k) for k, v in keys.items()]).agg(T.joined("p__id").alias("pmids"), T.joined("p__citation").alias("citations"), T.joined("d__name").alias("drugs"))


@query(f"""SELECT t.nct_id, t.title, coalesce(string_agg(DISTINCT tr.r_name, ',' ORDER BY tr.r_name), '') AS genes, count(DISTINCT td.p_name) AS n_drugs FROM {TRIALS} t JOIN nation tn ON tn.n_nationkey = t.s_nationkey JOIN region tr ON tr.r_regionkey = tn.n_regionkey
 LEFT JOIN (SELECT * FROM {TESTS} ts JOIN part ON p_partkey = ts.l_partkey) td ON td.l_suppkey = t.s_suppkey WHERE tr.r_name = '{GENE}' GROUP BY 1, 2""")
def q22_chunk_trials(spark, d):
    path = graph(spark, d).match("t", "ClinicalTrial").hop("t", "ASSOCIATED_GENE", "g", where=F.col("symbol") == GENE).hop("t", "TESTS_DRUG", "d", optional=True)
    return path.df.groupBy(F.col("t__nct_id").alias("nct_id"), F.col("t__title").alias("title")).agg(T.joined("g__symbol").alias("genes"), F.count_distinct("d__name").alias("n_drugs"))


@query(f"SELECT p_name AS drug, dv.id AS device, dv.platform FROM part JOIN {DEVICE} dv ON dv.id = p_brand WHERE p_size <= 25")
def q22_chunk_diagnostics(spark, d):
    return graph(spark, d).match("d", "Drug").hop("d", "HAS_COMPANION_DIAGNOSTIC", "cd").select(drug="d__name", device="cd__id", platform="cd__platform")


#: Lines that a task of full paths takes at most, about.
LINES = 500_000


@query(f"SELECT r.r_name AS gene, n.n_name AS variant, count(*) AS paths, count(DISTINCT d.p_partkey) AS drugs, count(DISTINCT p.s_suppkey) AS pmids, count(DISTINCT c.c_mktsegment) AS diseases FROM {SPINE} {DRUG} {PUB} GROUP BY 1, 2")
def q23_full_paths(spark, d):
    """Ways are counted as products of an evidence's drugs and citations, and distinct ends as different pairs, so that the
    product of both sides is never made. Drugs and citations are dealt by evidence once, for their numbers and for their
    ends, to more tasks if there are more of them."""
    g = graph(spark, d)
    tasks = g.edges["TARGETS_DRUG"].table.count() // LINES
    few = tasks <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *by: df.repartition(*by) if few else df.repartition(tasks, *by)
    key = ["gene", "variant"]
    spine = g.match("g", "Gene").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e").select(gene="g__symbol", variant="v__name", disease="mp__disease", e="e__id")
    sides = []
    for rel, drug in (("TARGETS_DRUG", True), ("CITED_IN", False)):
        node = g.nodes[g.edges[rel].target]
        edge = g.edges[rel].table.select(F.col("src").alias("e"), F.col("dst").alias("end"))
        sides.append(edge.join(node.table.select(F.col(node.key).alias("end")), "end").select("e", "end", F.lit(drug).alias("drug")))
    ends = dealt(sides[0].union(sides[1]), "e")
    sums = ends.groupBy("e").agg((F.count_if("drug") * F.count_if(~F.col("drug"))).alias("ways")).where("ways > 0")
    whole = spine.join(sums, "e")
    ways = whole.groupBy(*key, "disease").agg(F.sum("ways").alias("ways"))
    met = dealt(whole.select(*key, "e").join(ends, "e").select(*key, "drug", "end"), *key, "drug", "end").distinct()
    both = ways.withColumn("drug", F.lit(None).cast("boolean")).unionByName(met.select(*key, "drug"), allowMissingColumns=True)
    return both.groupBy(*key).agg(F.sum("ways").alias("paths"), F.count_if("drug").alias("drugs"), F.count_if(~F.col("drug")).alias("pmids"), F.count("disease").alias("diseases"))


DIRECT = f"(SELECT DISTINCT n_regionkey AS g, l_partkey AS dst FROM {TESTS} t JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"
HUB = f"""WITH far AS (SELECT r.r_name AS gene, count(DISTINCT d.p_partkey) AS n FROM {SPINE} {DRUG} WHERE ld.l_returnflag = 'A' AND {LV} GROUP BY 1),
 near AS (SELECT r_name AS gene, count(DISTINCT p_name) AS n FROM region JOIN {DIRECT} x ON x.g = r_regionkey JOIN part ON p_partkey = x.dst GROUP BY 1)
 SELECT coalesce(far.gene, near.gene) AS gene, coalesce(far.n, 0) AS {{far}}, coalesce(near.n, 0) AS {{near}} {{more}} FROM far FULL JOIN near ON far.gene = near.gene"""


def _hubs(spark, d, far, near):
    g = graph(spark, d)
    deep = g.match("g", "Gene").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e", where=T.levels(T.LEVELS)).hop("e", "TARGETS_DRUG", "d", rel_where="significance = 'A'")
    a = deep.df.groupBy(F.col("g__symbol").alias("gene")).agg(F.count_distinct("d__id").alias(far))
    b = g.match("g", "Gene").hop("g", "INTERACTS_WITH", "d").df.groupBy(F.col("g__symbol").alias("gene")).agg(F.count_distinct("d__name").alias(near))
    return a.join(b, "gene", "full").select("gene", F.coalesce(far, F.lit(0)).alias(far), F.coalesce(near, F.lit(0)).alias(near))


@query(HUB.format(far="civic", near="dgidb", more=", coalesce(far.n, 0) + coalesce(near.n, 0) AS total") + " WHERE coalesce(far.n, 0) + coalesce(near.n, 0) > 0 ORDER BY total DESC, gene LIMIT 15")
def q24_hub_centrality(spark, d):
    hubs = _hubs(spark, d, "civic", "dgidb").withColumn("total", F.col("civic") + F.col("dgidb")).where("total > 0")
    return hubs.orderBy(F.desc("total"), "gene").limit(15)


@query("SELECT gene, hop1, hop4 FROM (" + HUB.format(far="hop4", near="hop1", more="") + ") WHERE hop1 + hop4 > 0 ORDER BY hop4 DESC, gene LIMIT 15")
def q25_hop_comparison(spark, d):
    return _hubs(spark, d, "hop4", "hop1").where("hop1 + hop4 > 0").select("gene", "hop1", "hop4").orderBy(F.desc("hop4"), "gene").limit(15)


@query(f"""SELECT n.n_name AS variant, e.o_orderpriority AS level, d.p_name AS drug, coalesce(c.c_mktsegment, e.o_orderstatus) AS disease, p.s_suppkey AS pmid FROM {SPINE} {DRUG} {OPUB} WHERE r.r_name = 'ASIA' AND {LV} AND ld.l_returnflag = 'A'
 ORDER BY level, variant, level, drug, disease, pmid LIMIT 15""")
def q26_gene_case(spark, d):
    g = graph(spark, d).match("g", "Gene", F.col("symbol") == "ASIA").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e", where=T.levels(T.LEVELS))
    path = g.hop("e", "TARGETS_DRUG", "d", rel_where="significance = 'A'").hop("e", "CITED_IN", "p", optional=True)
    return top(path.select(variant="v__name", level="e__level", drug="d__name", disease="coalesce(mp__disease, e__statement)", pmid="p__pmid"), 15, F.col("level").asc_nulls_last())


CASE = f"SELECT d.p_name AS drug, e.o_orderpriority AS level, c.c_mktsegment AS tumour, {{f}} AS type FROM {SPINE} {{join}} WHERE r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' {{w}} ORDER BY level, drug, level, tumour, type LIMIT 15"


def _case(spark, d):
    return graph(spark, d).match("g", "Gene", F.col("symbol") == GENE).hop("g", "HAS_VARIANT", "v", where=F.col("name") == VARIANT).hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e")


@query(CASE.format(f="ld.l_returnflag", join="LEFT JOIN (lineitem ld JOIN part d ON d.p_partkey = ld.l_partkey AND ld.l_returnflag = 'R') ON ld.l_orderkey = e.o_orderkey", w=""))
def q27_resistance_case_as_written(spark, d):
    """The predicate stands after the optional match, so that it narrows the drugs, not the rows."""
    path = _case(spark, d).hop("e", "TARGETS_DRUG", "d", optional=True, rel_where="significance = 'R'")
    return top(path.select(drug="d__name", level="e__level", tumour="mp__disease", type="d__rel__significance"), 15, F.col("level").asc_nulls_last())


@query(CASE.format(f="ld.l_returnflag", join=DRUG, w="AND ld.l_returnflag = 'R'"))
def q27_resistance_case_as_meant(spark, d):
    path = _case(spark, d).hop("e", "TARGETS_DRUG", "d", rel_where="significance = 'R'")
    return top(path.select(drug="d__name", level="e__level", tumour="mp__disease", type="d__rel__significance"), 15, F.col("level").asc_nulls_last())


@query(f"SELECT c.c_mktsegment AS tumour, e.o_orderpriority AS level, ld.l_returnflag AS significance, count(*) AS n, count(DISTINCT d.p_name) AS drugs FROM {MP} {DRUG} WHERE e.o_orderstatus = 'F' GROUP BY 1, 2, 3 ORDER BY n DESC, tumour, level, significance")
def q28_source_contrast(spark, d):
    path = graph(spark, d).match("mp", "MolecularProfile").hop("mp", "HAS_EVIDENCE", "e", where="statement = 'F'").hop("e", "TARGETS_DRUG", "d")
    return path.df.groupBy(F.col("mp__disease").alias("tumour"), F.col("e__level").alias("level"), F.col("d__rel__significance").alias("significance")).agg(F.count("*").alias("n"), F.count_distinct("d__name").alias("drugs")).orderBy(F.desc("n"), "tumour", "level", "significance")


@query(f"""WITH s AS (SELECT DISTINCT c.c_custkey, lower(c.c_mktsegment) AS dis, d.p_name AS drug, ld.l_returnflag AS sig FROM {MP} {DRUG} WHERE {LV} AND ld.l_returnflag IN ('A', 'R'))
 SELECT c_custkey AS mp, dis AS tumour, string_agg(drug, ',' ORDER BY drug) FILTER (WHERE sig = 'A') AS sensitive, string_agg(drug, ',' ORDER BY drug) FILTER (WHERE sig = 'R') AS resistant FROM s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE sig = 'A') > 0 AND count(*) FILTER (WHERE sig = 'R') > 0 ORDER BY mp, tumour LIMIT 20""")
def q30_double_significance(spark, d):
    path = graph(spark, d).match("mp", "MolecularProfile").hop("mp", "HAS_EVIDENCE", "e", where=T.levels(T.LEVELS)).hop("e", "TARGETS_DRUG", "d", rel_where="significance in ('A', 'R')")
    rows = path.select(mp="mp__id", tumour="lower(mp__disease)", drug="d__name", sig="d__rel__significance")
    side = lambda flag: T.joined(F.when(F.col("sig") == flag, F.col("drug")))
    both = rows.groupBy("mp", "tumour").agg(side("A").alias("sensitive"), side("R").alias("resistant")).where("sensitive <> '' and resistant <> ''")
    return both.orderBy("mp", "tumour").limit(20)


@query(f"""SELECT coalesce(string_agg(DISTINCT d.p_name, ',' ORDER BY d.p_name) FILTER (WHERE ld.l_returnflag = 'A'), '') AS gene_sensitive, coalesce(string_agg(DISTINCT d.p_name, ',' ORDER BY d.p_name) FILTER (WHERE ld.l_returnflag = 'A' AND n.n_name = '{VARIANT}'), '') AS variant_sensitive,
 coalesce(string_agg(DISTINCT d.p_name, ',' ORDER BY d.p_name) FILTER (WHERE ld.l_returnflag = 'R' AND n.n_name = '{VARIANT}'), '') AS variant_resistant FROM {SPINE} {DRUG} WHERE r.r_name = '{GENE}' AND {URGENT} AND {KWS}""")
def q31_gene_and_variant_drugs(spark, d):
    df = _point(spark, d, None, T.STRONGEST).hop("e", "TARGETS_DRUG", "d").df
    pick = lambda cond: T.joined(F.when(F.expr(cond), F.col("d__name")))
    a, v = "d__rel__significance = 'A'", f"v__name = '{VARIANT}'"
    return df.agg(pick(a).alias("gene_sensitive"), pick(f"{a} and {v}").alias("variant_sensitive"), pick(f"d__rel__significance = 'R' and {v}").alias("variant_resistant"))


@query(f"SELECT DISTINCT r.r_name AS gene, n.n_name AS variant, c.c_mktsegment AS tumour FROM {SPINE} WHERE {LV}")
def q32_strong_tumours(spark, d):
    path = graph(spark, d).match("g", "Gene").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e", where=T.levels(T.LEVELS))
    return path.select(gene="g__symbol", variant="v__name", tumour="mp__disease").distinct()


@query(f"""SELECT DISTINCT a.p_name AS resisted, b.p_name AS alternative FROM (SELECT DISTINCT c.c_custkey, d.p_name FROM {SPINE} {DRUG} WHERE ld.l_returnflag = 'R' AND r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {URGENT}) a
 JOIN (SELECT DISTINCT c.c_custkey, d.p_name FROM {SPINE} {DRUG} WHERE ld.l_returnflag = 'A' AND r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {URGENT}) b ON a.c_custkey = b.c_custkey""")
def q33_progression(spark, d):
    of = lambda flag, name: _point(spark, d, names=T.STRONGEST).hop("e", "TARGETS_DRUG", "d", rel_where=f"significance = '{flag}'").select(mp="mp__id", **{name: "d__name"}).distinct()
    return of("R", "resisted").join(of("A", "alternative"), "mp").select("resisted", "alternative").distinct()


@query(f"""SELECT 'case_01' AS case_id, e.o_orderpriority AS level, c.c_mktsegment AS disease, p.s_suppkey AS pmid, e.o_orderkey AS evidence FROM {SPINE} {PUB} WHERE r.r_name = '{GENE}' AND n.n_name = '{VARIANT}' AND {KWS} AND {LV} ORDER BY level, case_id, level, disease, pmid, evidence LIMIT 10""")
def q34_case_validation(spark, d):
    path = _point(spark, d).hop("e", "CITED_IN", "p")
    return top(path.select(case_id="'case_01'", level="e__level", disease="mp__disease", pmid="p__pmid", evidence="e__id"), 10, F.col("level").asc_nulls_last())


@query("""SELECT 'Gene' AS label, count(*) AS n FROM region UNION ALL SELECT 'Variant', count(*) FROM nation UNION ALL SELECT 'MolecularProfile', count(*) FROM customer UNION ALL SELECT 'Evidence', count(*) FROM orders
 UNION ALL SELECT 'Drug', count(*) FROM part UNION ALL SELECT 'Publication', count(*) FROM supplier UNION ALL SELECT 'Device', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'Disease', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'ClinicalTrial', count(*) FROM supplier""")
def q35_load_counts(spark, d):
    out = None
    for label, nodes in graph(spark, d).nodes.items():
        one = nodes.table.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_mktsegment AS disease, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, disease LIMIT 10")
def q35_top_diseases(spark, d):
    path = graph(spark, d).match("mp", "MolecularProfile").hop("mp", "HAS_EVIDENCE", "e")
    return path.df.groupBy(F.col("mp__disease").alias("disease")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "disease").limit(10)


@query("SELECT s_suppkey AS pmid, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY n DESC, pmid LIMIT 10")
def q35_top_publications(spark, d):
    edges = graph(spark, d).edges["CITED_IN"].table
    return edges.groupBy(F.col("dst").alias("pmid")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pmid").limit(10)


NODES = """SELECT DISTINCT id, label, type, metadata FROM (SELECT id, label, type, min(metadata) AS metadata FROM (
  SELECT 'Gene:' || gene AS id, gene AS label, 'Gene' AS type, gene AS metadata FROM s WHERE gene IS NOT NULL UNION ALL SELECT 'Variant:' || variant, variant, 'Variant', variant FROM s WHERE variant IS NOT NULL
  UNION ALL SELECT 'MolecularProfile:' || mp_name, mp_name, 'MolecularProfile', disease FROM s WHERE mp_name IS NOT NULL UNION ALL SELECT 'Evidence:' || evidence_id, evidence_id::VARCHAR, 'Evidence', evidence_level FROM s WHERE evidence_id IS NOT NULL
  UNION ALL SELECT 'Drug:' || drug_name, drug_name, 'Drug', approved::VARCHAR FROM s WHERE drug_name IS NOT NULL UNION ALL SELECT 'Device:' || device, device, 'Device', device FROM s WHERE device IS NOT NULL
  UNION ALL SELECT 'Publication:' || pmid, pmid::VARCHAR, 'Publication', citation FROM s WHERE pmid IS NOT NULL) GROUP BY 1, 2, 3)"""


@query(f"WITH s AS ({SUB_POINT}) {NODES}")
def v24_subgraph_nodes(spark, d):
    return T.subgraph_nodes(q17_subgraph_point(spark, d))


LINKS = " UNION ".join(
    f"SELECT '{a}:' || {x} AS source, '{b}:' || {y} AS target, '{k}' AS type FROM s WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    for a, x, b, y, k in [("Gene", "gene", "Variant", "variant", "HAS_VARIANT"), ("Variant", "variant", "MolecularProfile", "mp_name", "IN_MOLECULAR_PROFILE"), ("MolecularProfile", "mp_name", "Evidence", "evidence_id", "HAS_EVIDENCE"), ("Evidence", "evidence_id", "Drug", "drug_name", "TARGETS_DRUG"), ("Evidence", "evidence_id", "Publication", "pmid", "CITED_IN"), ("Drug", "drug_name", "Device", "device", "HAS_COMPANION_DIAGNOSTIC")]
)


@query(f"WITH s AS ({SUB_POINT}) {LINKS}")
def v24_subgraph_links(spark, d):
    return T.subgraph_links(q17_subgraph_point(spark, d))


@query(f"""SELECT type, n FROM (WITH s AS ({SUB_POINT}), n AS ({NODES}), l AS ({LINKS}), k AS (SELECT id FROM n WHERE type IN ('Evidence', 'Drug')) SELECT type, count(*) AS n FROM l WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) GROUP BY 1)""")
def pf19_visible_links(spark, d):
    """Nodes of the visible types, and the links with both ends among them."""
    records = q17_subgraph_point(spark, d)
    shown = T.subgraph_nodes(records).where("type in ('Evidence', 'Drug')").select("id")
    links = T.subgraph_links(records).join(shown.withColumnRenamed("id", "source"), "source", "left_semi").join(shown.withColumnRenamed("id", "target"), "target", "left_semi")
    return links.groupBy("type").agg(F.count("*").alias("n"))


# -- patterns that repeat a type, or close -------------------------------------------------------------------------


@query("""SELECT a.p_name AS one, b.p_name AS other, count(*) AS n FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND NOT (y.l_linenumber = x.l_linenumber AND y.l_partkey = x.l_partkey AND y.l_returnflag = x.l_returnflag) JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey GROUP BY 1, 2""")
def s09_drugs_together(spark, d):
    """Drugs of one evidence: the type occurs twice, and a relationship is not used for both."""
    path = graph(spark, d).match("a", "Drug").hop("a", "TARGETS_DRUG", "e", back=True).hop("e", "TARGETS_DRUG", "b")
    return path.df.groupBy(F.col("a__name").alias("one"), F.col("b__name").alias("other")).agg(F.count("*").alias("n"))


@query("""SELECT a.p_name AS one, b.p_name AS other, count(*) AS n FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey GROUP BY 1, 2""")
def s09_drugs_of_two_matches(spark, d):
    """The same in two matches: the second may use the relationship of the first."""
    path = graph(spark, d).match("a", "Drug").hop("a", "TARGETS_DRUG", "e", back=True).again().hop("e", "TARGETS_DRUG", "b")
    return path.df.groupBy(F.col("a__name").alias("one"), F.col("b__name").alias("other")).agg(F.count("*").alias("n"))


@query("""SELECT r.r_name AS gene, e.o_orderpriority AS level, count(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders e ON e.o_custkey = c.c_custkey
 JOIN lineitem l ON l.l_orderkey = e.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size <= 25 WHERE (SELECT min(q.p_partkey) % 5 FROM part q WHERE q.p_brand = p.p_brand) = r.r_regionkey GROUP BY 1, 2""")
def s09_closed_way(spark, d):
    """From a gene over its evidence to drugs whose companion test detects the very same gene: the last hop closes."""
    path = graph(spark, d).match("g", "Gene").hop("g", "HAS_VARIANT", "v").hop("v", "IN_MOLECULAR_PROFILE", "mp").hop("mp", "HAS_EVIDENCE", "e")
    path = path.hop("e", "TARGETS_DRUG", "d").hop("d", "HAS_COMPANION_DIAGNOSTIC", "x").hop("x", "DIAGNOSES_GENE", "g")
    return path.df.groupBy(F.col("g__symbol").alias("gene"), F.col("e__level").alias("level")).agg(F.count("*").alias("n"))
