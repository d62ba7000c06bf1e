"""Scalar and rule functions over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as X
from lodestone.plans.registry import query
from lodestone.sources.projection import read

col, lit = F.col, F.lit


@query("SELECT p_partkey, regexp_replace(regexp_replace(upper(trim(p_name || ' sulfate (' || p_brand || ')')), '\\b(HYDROCHLORIDE|SULFATE|TARTRATE|CITRATE|MALEATE|PHOSPHATE)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') AS drug_key FROM part")
def f01_drug_key(spark, d):
    return read(spark, d, "part").select("p_partkey", X.drug_key(F.concat("p_name", lit(" sulfate ("), "p_brand", lit(")"))).alias("drug_key"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS entity_key FROM documents")
def f02_entity_key(spark, d):
    return read(spark, d, "documents").select("doc_id", X.entity_key(col("text")).alias("entity_key"))


@query("SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct, array_to_string(t[1:5], ' ') AS first FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS t FROM documents)")
def f03_tokens(spark, d):
    t = read(spark, d, "documents").select("doc_id", X.tokens(col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("first"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))::INTEGER AS n_words FROM documents")
def f04_word_count(spark, d):
    return read(spark, d, "documents").select("doc_id", X.word_count(col("text")).alias("n_words"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ';; ' || p_type || ';', ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def f10_listed(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(X.listed(F.concat("p_name", lit(";; "), "p_type", lit(";")), ";"), "|").alias("parts"))


TUMOURS = ["NSCLC lung", "Colon carcinoma", "solid tumor", "all", "CML blast", "rare of bone", "gg", "stomach"]
RULE_SQL = " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{'|'.join(ks)}'" for ws, ks in X.DISEASE_RULES)
PICK = "[" + ", ".join(f"'{t}'" for t in TUMOURS) + "]"


@query(f"""SELECT c_custkey, CASE WHEN contains(t, 'solid tumor') OR t IN ('cancer', 'solid', 'all') THEN '' {RULE_SQL}
 WHEN len(list_filter(string_split(t, ' '), lambda w: length(w) > 2)) > 0 THEN array_to_string(list_filter(string_split(t, ' '), lambda w: length(w) > 2), '|') ELSE t END AS keywords FROM (SELECT c_custkey, lower({PICK}[c_custkey % {len(TUMOURS)} + 1]) AS t FROM customer)""")
def pf12_disease_keywords(spark, d):
    tumour = F.get(F.array(*map(lit, TUMOURS)), (col("c_custkey") % len(TUMOURS)).cast("int"))
    return read(spark, d, "customer").select("c_custkey", F.array_join(X.disease_keywords(tumour), "|").alias("keywords"))


VARIANTS = ["EML4-ALK fusion", "ERBB2 Amplification", "Exon 14 skipping", "MSI-High", "T790M", "ITD", "L747S", "exon 20 ins", "V600", "TMB-H"]
KINDS = ["fusion", "cna", "atypical", "biomarker", "point_mutation", "itd"]
VPICK = "[" + ", ".join(f"'{t}'" for t in VARIANTS) + "]"
KPICK = "[" + ", ".join(f"'{t}'" for t in KINDS) + "]"


def _variants(spark, d):
    v = F.get(F.array(*map(lit, VARIANTS)), (col("o_orderkey") % len(VARIANTS)).cast("int"))
    k = F.get(F.array(*map(lit, KINDS)), (col("o_orderkey") % 7 % len(KINDS)).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", v.alias("v"), k.alias("k"))


@query(f"""SELECT o_orderkey, CASE k WHEN 'fusion' THEN 'fusion' WHEN 'cna' THEN CASE WHEN contains(lower(v), 'amplif') THEN 'amplif' ELSE 'deletion' END WHEN 'itd' THEN 'itd' WHEN 'biomarker' THEN trim(split_part(v, '-', 1))
  WHEN 'atypical' THEN CASE WHEN regexp_extract(lower(v), '(?:^|\\s)exon\\s+(\\S+)', 1) <> '' THEN 'exon ' || regexp_extract(lower(v), '(?:^|\\s)exon\\s+(\\S+)', 1) ELSE split_part(trim(v), ' ', 1) END ELSE v END AS keyword,
  CASE WHEN starts_with(upper(v), 'MSI') THEN 'MSI High' WHEN starts_with(upper(v), 'TMB') THEN 'TMB High' ELSE v END AS biomarker,
  regexp_matches(v, '^[A-Za-z]\\d{{1,4}}[A-Za-z*]+$') AND NOT regexp_matches(lower(v), '{'|'.join(X.DRIVER_WORDS)}') AS acquired, lower(v) IN ('mutation', 'itd') OR starts_with(lower(v), 'exon ') OR regexp_matches(v, '^[A-Z]\\d+$') AS generic
  FROM (SELECT o_orderkey, {VPICK}[o_orderkey % {len(VARIANTS)} + 1] AS v, {KPICK}[o_orderkey % 7 % {len(KINDS)} + 1] AS k FROM orders)""")
def pf13_variant_rules(spark, d):
    v, k = col("v"), col("k")
    return _variants(spark, d).select("o_orderkey", X.profile_keyword(k, v).alias("keyword"), X.biomarker(v).alias("biomarker"), X.acquired_resistance(v).alias("acquired"), X.generic_alteration(v, ("mutation", "itd")).alias("generic"))


REPORT = "'Seen in PMID ' || (20000000 + o_orderkey) || ' and ' || (o_orderkey % 3 + 1234567) || ', ' || year(o_orderdate) || '; ESCAT I-A'"


def _reports(spark, d):
    parts = [lit("Seen in PMID "), (lit(20000000) + col("o_orderkey")).cast("string"), lit(" and "), (col("o_orderkey") % 3 + 1234567).cast("string"), lit(", "), F.year("o_orderdate").cast("string"), lit("; ESCAT I-A")]
    return read(spark, d, "orders").select("o_orderkey", F.concat(*parts).alias("t"))


@query(f"SELECT o_orderkey, array_to_string(regexp_extract_all(t, '\\b(\\d{{7,8}})\\b', 1), ',') AS pmids, regexp_extract(t, '\\b((?:19|20)\\d{{2}})\\b', 1)::INTEGER AS year, regexp_extract(t, 'ESCAT ([IVX]+-[A-C])', 1) AS tier, regexp_replace(t, '\\b1234567\\b', '[unverified]', 'g') AS masked FROM (SELECT o_orderkey, {REPORT} AS t FROM orders)")
def f11_report_extraction(spark, d):
    known = F.array((lit(20000000) + col("o_orderkey")).cast("string"), lit("1234568"), lit("1234569"))
    return _reports(spark, d).select("o_orderkey", F.array_join(X.pmids(col("t")), ",").alias("pmids"), X.year_of(col("t")).alias("year"), F.regexp_extract("t", r"ESCAT ([IVX]+-[A-C])", 1).alias("tier"), X.masked_pmids(col("t"), known).alias("masked"))


@query(f"""SELECT o_orderkey, replace(regexp_replace(regexp_replace(t, '(PMID:?\\s?)(\\d{{7,8}})\\b(\\s{{0,4}}\\()', '\\1' || chr(1) || '\\2\\3', 'g'), 'PMID:?\\s?(\\d{{7,8}})\\b', '[PMID \\1](https://pubmed.ncbi.nlm.nih.gov/\\1/)', 'g'), chr(1), '') AS linked FROM (SELECT o_orderkey, {REPORT} AS t FROM orders)""")
def f13_linked_pmids(spark, d):
    """The checking dialect has no look-ahead: there, mentions that a bracket follows are marked first and left alone."""
    return _reports(spark, d).select("o_orderkey", X.linked_pmids(col("t")).alias("linked"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(p_name || ' and ' || p_brand || ' / ' || p_type), '\\s+and\\s+|[,/&+]'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS parts FROM part")
def f14_drug_parts(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(X.drug_parts(F.concat("p_name", lit(" and "), "p_brand", lit(" / "), "p_type"))), "|").alias("parts"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'bolt') OR contains(p_name, 'ring') THEN 'COVERED' WHEN contains(p_name, 'red') OR contains(p_name, 'bolt') THEN 'PARTIAL' ELSE 'GAP' END AS coverage FROM part""")
def f15_coverage(spark, d):
    return read(spark, d, "part").select("p_partkey", X.coverage(lit("red+bolt/ring"), F.split("p_name", " ")).alias("coverage"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9-]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN ('and', 'seen')))), ' ') AS anchors FROM (SELECT o_orderkey, " + REPORT + " AS t FROM orders)")
def f16_anchors(spark, d):
    return _reports(spark, d).select("o_orderkey", F.array_join(F.array_sort(X.anchors(col("t"), ("and", "seen"))), " ").alias("anchors"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS total FROM embeddings")
def f19_normalised(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    one = X.normalised(v)
    return read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(X.dot(v, v)), 6).alias("norm"), F.round(F.aggregate(one, lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, count(*) FILTER (WHERE year(o_orderdate) >= 1999 - 5) AS recent FROM orders WHERE year(o_orderdate) >= 1990 GROUP BY 1")
def f20_years(spark, d):
    """The year that counts as today is a parameter."""
    y = read(spark, d, "orders").select(F.year("o_orderdate").alias("year")).where("year >= 1990")
    return y.groupBy("year").agg(F.count("*").alias("n"), F.count_if(col("year") >= 1999 - 5).alias("recent"))


@query("SELECT conv_id, turn, sha256(concat_ws('|', conv_id, turn, role, text)) AS hash, md5(text)[1:12] AS prompt_key FROM conversations")
def f21_hashes(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", "conv_id", "turn", "role", "text"), 256).alias("hash"), F.substring(F.md5("text"), 1, 12).alias("prompt_key"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS most FROM events GROUP BY 1")
def f22_json(spark, d):
    wrapped = read(spark, d, "events").select("event_type", F.concat(lit("```json\n"), "props", lit("\n```")).alias("t"))
    k = F.from_json(X.fenced_json(col("t")), "k long")["k"]
    return wrapped.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def io10_plain_text(spark, d):
    return read(spark, d, "pages").select("page_id", X.plain_text(col("html")).alias("text"))


# -- rules --------------------------------------------------------------------------------------------------------
# Cases by rule from order keys: what a source says and what a case declares.
SRC_LINE = ["first_line", "Later_line ", "post_progression", "bad", "adjuvant"]
SRC_SETTING = ["resected", "metastatic", "locally_advanced", "", "recurrent", "adjuvant"]
SRC_PRIOR = ["treatment_naive", "previously_treated", "none", "specific_therapy"]
CASE_LINE = ["first-line", "second-line", "later-line", ""]
CASE_SETTING = ["resected", "metastatic", " ", "locally-advanced"]
VERDICT = ["compatible", "not_compatible", "indeterminate", "odd"]
FIELDS = {"line": (SRC_LINE, 1), "setting": (SRC_SETTING, 7), "prior": (SRC_PRIOR, 3), "case_line": (CASE_LINE, 11), "case_setting": (CASE_SETTING, 13), "verdict": (VERDICT, 17)}


def _cases(spark, d):
    picks = [F.get(F.array(*map(lit, v)), (F.floor(col("o_orderkey") / k) % len(v)).cast("int")).alias(n) for n, (v, k) in FIELDS.items()]
    more = [F.when(col("o_orderkey") % 2 == 0, "IV").alias("stage"), F.when(col("o_orderkey") % 5 > 0, "chemo").alias("treated"), F.when(col("o_orderkey") % 19 > 3, "supported").when(col("o_orderkey") % 19 > 1, "contradicted").otherwise("odd").alias("status")]
    return read(spark, d, "orders").select("o_orderkey", *picks, *more)


CASES_SQL = "SELECT o_orderkey, " + ", ".join(f"[{', '.join(repr(x) for x in v)}][(o_orderkey // {k}) % {len(v)} + 1] AS {n}" for n, (v, k) in FIELDS.items()) + ", CASE WHEN o_orderkey % 2 = 0 THEN 'IV' END AS stage, CASE WHEN o_orderkey % 5 > 0 THEN 'chemo' END AS treated, CASE WHEN o_orderkey % 19 > 3 THEN 'supported' WHEN o_orderkey % 19 > 1 THEN 'contradicted' ELSE 'odd' END AS status FROM orders"
NORMAL_SQL = f"""SELECT *, {', '.join(f"CASE WHEN lower(trim({c})) IN ({', '.join(repr(x) for x in allowed)}) THEN lower(trim({c})) ELSE 'unknown' END AS {n}" for c, n, allowed in (('line', 'l', R.LINES), ('setting', 's', R.SETTINGS), ('prior', 'p', R.PRIORS)))},
  CASE WHEN case_line = 'first-line' THEN 'first_line' WHEN case_line IN ('second-line', 'later-line') THEN 'later_line' ELSE 'unknown' END AS cl, CASE WHEN trim(case_setting) = '' THEN 'unknown' ELSE replace(case_setting, '-', '_') END AS cs FROM ({CASES_SQL})"""
VERDICT_SQL = f"""SELECT *, CASE WHEN cl = 'first_line' AND l IN ('later_line', 'post_progression') OR cl = 'later_line' AND l = 'first_line' AND p = 'treatment_naive' OR cs = 'resected' AND s IN ('metastatic', 'locally_advanced', 'recurrent') OR s = 'resected' AND cs IN ('metastatic', 'locally_advanced', 'recurrent') THEN 'not_compatible'
  WHEN lacking <> '' THEN 'indeterminate' ELSE 'compatible' END AS derived FROM (SELECT *, concat_ws('; ', CASE WHEN l = 'unknown' THEN 'source line' END, CASE WHEN s = 'unknown' THEN 'source setting' END, CASE WHEN p = 'unknown' THEN 'source prior therapy' END,
  CASE WHEN s <> 'unknown' AND cs = 'unknown' THEN 'case setting' END, CASE WHEN s IN ('metastatic', 'locally_advanced') AND stage IS NULL THEN 'case stage' END, CASE WHEN p <> 'unknown' AND treated IS NULL THEN 'case prior therapies' END) AS lacking FROM ({NORMAL_SQL}))"""
SUPPORT_SQL = "CASE status WHEN 'supported' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'supported_after_contextualization' ELSE 'supported_as_written' END WHEN 'contradicted' THEN 'contradicted' ELSE 'uncertain' END"
SECTION_SQL = f"CASE WHEN support = 'contradicted' THEN 'excluded' WHEN support = 'uncertain' THEN 'review' WHEN derived = 'not_compatible' THEN 'supported_not_compatible' WHEN derived = 'indeterminate' THEN 'supported_indeterminate' ELSE 'supported_compatible' END"


def _judged(spark, d):
    cases = _cases(spark, d)
    line, setting, prior = R.category(col("line"), R.LINES), R.category(col("setting"), R.SETTINGS), R.category(col("prior"), R.PRIORS)
    lacking = R.missing(line, setting, prior, col("case_setting"), col("stage"), col("treated"))
    derived = R.applicability(R.conflicts(line, setting, prior, col("case_line"), col("case_setting")), lacking)
    support = R.documentary_support(col("status"), col("o_orderkey") % 3 == 0)
    return cases.select("o_orderkey", line.alias("l"), setting.alias("s"), prior.alias("p"), F.array_join(lacking, "; ").alias("lacking"), derived.alias("derived"), R.validated(col("verdict"), derived).alias("validated"), support.alias("support"))


@query(f"SELECT o_orderkey, l, s, p, lacking, derived, CASE WHEN derived <> 'compatible' THEN derived WHEN verdict = 'compatible' THEN 'compatible' ELSE 'indeterminate' END AS validated FROM ({VERDICT_SQL})")
def v02_applicability(spark, d):
    return _judged(spark, d).drop("support")


@query(f"SELECT o_orderkey, support, {SECTION_SQL} AS section, support IN ('uncertain', 'contradicted') AS review_source, derived IN ('indeterminate', 'not_compatible') AS review_fit FROM (SELECT *, {SUPPORT_SQL} AS support FROM ({VERDICT_SQL}))")
def v10_dossier_sections(spark, d):
    a, b = R.review_flags(col("support"), col("derived"))
    return _judged(spark, d).select("o_orderkey", "support", R.section(col("support"), col("derived")).alias("section"), a.alias("review_source"), b.alias("review_fit"))


@query(f"SELECT section, count(*) AS n, count(*) FILTER (WHERE derived = 'compatible') AS compatible FROM (SELECT *, {SECTION_SQL} AS section FROM (SELECT *, {SUPPORT_SQL} AS support FROM ({VERDICT_SQL}))) GROUP BY 1")
def v29_run_metrics(spark, d):
    rows = _judged(spark, d).withColumn("section", R.section(col("support"), col("derived")))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.count_if(col("derived") == "compatible").alias("compatible"))


ARMS = "CASE o_orderkey % 6 WHEN 0 THEN [['a', 'b'], ['c']] WHEN 1 THEN [['a', 'b', 'c']] WHEN 2 THEN [['d']] WHEN 3 THEN [[]::VARCHAR[]] WHEN 4 THEN [['a'], ['b']] END"


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' WHEN 2 THEN 'no_match' WHEN 4 THEN 'partial' ELSE 'unknown' END AS arm_match FROM orders")
def v05_arm_match(spark, d):
    arr = lambda *xs: F.array(*map(lit, xs)).cast("array<string>")
    k = col("o_orderkey") % 6
    arms = F.when(k == 0, F.array(arr("a", "b"), arr("c"))).when(k == 1, F.array(arr("a", "b", "c"))).when(k == 2, F.array(arr("d"))).when(k == 3, F.array(arr())).when(k == 4, F.array(arr("a"), arr("b")))
    return read(spark, d, "orders").select("o_orderkey", R.arm_match(arr("a", "b"), arms).alias("arm_match"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid_pmid' WHEN o_orderstatus = 'P' THEN 'missing_statement' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'level_not_allowed' WHEN o_orderkey % 5 = 0 THEN 'missing_abstract' WHEN o_orderkey % 4 = 0 THEN 'no_anchor' ELSE 'passed' END AS gate,
 CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 5 <> 0 THEN 'claim (' || concat_ws('; ', CASE WHEN o_orderstatus <> 'P' THEN 'population: ' || o_orderstatus END, CASE WHEN o_orderkey % 5 <> 0 THEN 'setting: adjuvant' END) || ')' END AS derived FROM orders""")
def v06_gates_and_claims(spark, d):
    key = col("o_orderkey")
    statement = F.when(col("o_orderstatus") != "P", col("o_orderstatus")).otherwise("")
    abstract = F.when(key % 5 != 0, "adjuvant")
    pmid = F.when(key % 7 == 0, "12").otherwise(F.concat(lit("2"), F.lpad(key.cast("string"), 7, "0")))
    gate = R.gate(pmid, statement, statement, col("o_orderpriority"), abstract, key % 4 != 0, ("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return read(spark, d, "orders").select("o_orderkey", gate.alias("gate"), R.derived_claim(lit("claim"), statement, lit(None).cast("string"), abstract, lit("")).alias("derived"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'bolt') THEN 1.0 WHEN contains(p_name, 'red') OR contains(p_name, 'bolt') THEN 0.5 ELSE 0.0 END::DOUBLE AS match FROM part")
def v13_therapeutic_match(spark, d):
    return read(spark, d, "part").select("p_partkey", R.therapeutic_match(F.replace("p_name", lit(" "), lit(" + ")), lit("Red and bolt"), X.drug_parts).alias("match"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'undetermined' WHEN o_orderkey % 2 = 0 THEN CASE lv WHEN 'A' THEN 'I-A' WHEN 'B' THEN 'I-B' WHEN 'C' THEN 'II-A' WHEN 'D' THEN 'II-B' ELSE 'undetermined' END ELSE CASE lv WHEN 'A' THEN 'II-A' WHEN 'B' THEN 'II-B' ELSE 'undetermined' END END AS tier,
 CASE WHEN cx = 'low' AND o_orderkey % 11 = 0 THEN 'high' WHEN cx = 'low' AND (o_orderkey % 7 = 0 OR o_orderkey % 13 = 0) THEN 'moderate' ELSE cx END AS complexity FROM (SELECT *, chr(64 + o_orderpriority[1]::INTEGER) AS lv, CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'moderate' END AS cx FROM orders)""")
def v20_tiers(spark, d):
    key = col("o_orderkey")
    level = F.char(F.substring("o_orderpriority", 1, 1).cast("int") + 64)
    cx = F.when(col("o_totalprice") < 100000, "low").otherwise("moderate")
    return read(spark, d, "orders").select(
        "o_orderkey", R.tier(level, F.when(col("o_orderstatus") == "P", "Resistance"), key % 2 == 0).alias("tier"),
        R.least_complexity(cx, F.when(key % 11 == 0, "biomarker").otherwise("cna"), F.when(key % 7 == 0, "later-line").otherwise("first-line"), F.when(key % 13 == 0, "EGFR").otherwise("KIT")).alias("complexity"),
    )
