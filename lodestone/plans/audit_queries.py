"""Fit of labels and the coverage audit, each query beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import audit as A
from lodestone.operators.containment import fitting
from lodestone.plans.registry import query
from lodestone.sources.projection import read
from lodestone.sources.tables import if_small, stored

col, lit = F.col, F.lit

SYNONYMS = {"auto": ["car", "machin"], "build": ["house", "furn"], "small": ["supplier#00000001", "ring"], "economy": ["gizmo"], "nation_1": ["customer#0000000"]}


def _labels(spark, d, pairs) -> DataFrame:
    return reduce(DataFrame.union, [read(spark, d, t).select(col(c).alias("v")) for t, c in pairs]).distinct()


LEFT = (("customer", "c_mktsegment"), ("part", "p_type"), ("nation", "n_name"), ("region", "r_name"))
RIGHT = (("customer", "c_mktsegment"), ("part", "p_name"), ("nation", "n_name"), ("supplier", "s_name"), ("customer", "c_name"))
_union = lambda pairs, v: " UNION ".join(f"SELECT DISTINCT lower(trim({c})) AS {v} FROM {t}" for t, c in pairs)
_said = " UNION ALL ".join(f"SELECT '{k}' AS label, '{w}' AS word" for k, words in SYNONYMS.items() for w in words)
FITS = """(contains(y, x) OR contains(x, y) OR x = 'solid tumor' OR y = 'solid tumor' OR EXISTS (SELECT 1 FROM said WHERE label = x AND (contains(y, word) OR contains(word, y))) OR EXISTS (SELECT 1 FROM said WHERE contains(x, label) AND contains(y, word)))"""


@query(f"WITH said AS ({_said}) SELECT x, y FROM ({_union(LEFT, 'x')}), ({_union(RIGHT, 'y')}) WHERE x <> '' AND y <> '' AND {FITS}")
def j17_tumour_fit(spark, d):
    """Labels of one vocabulary that fit labels of another, by containment either way and by synonyms."""
    return fitting(_labels(spark, d, LEFT).withColumnRenamed("v", "x"), _labels(spark, d, RIGHT).withColumnRenamed("v", "y"), SYNONYMS)


# -- coverage audit -----------------------------------------------------------------------------------------------
KIND = "CASE n_nationkey % 5 WHEN 0 THEN 'point' WHEN 1 THEN 'atypical' WHEN 2 THEN 'cna' WHEN 3 THEN 'biomarker' ELSE 'fusion' END"
VARIANT = "CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'exon ' || CAST(n_nationkey AS STRING) WHEN 2 THEN 'Amplification' ELSE 'other' END"
KEY = "CASE WHEN n_nationkey % 5 = 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'nation_2' ELSE '#00000002' END WHEN n_nationkey % 5 = 4 THEN CASE WHEN n_nationkey % 2 = 0 THEN '#00000001' ELSE 'none' END END"
EXPECTED = "CASE n_nationkey % 6 WHEN 0 THEN 'red+bolt' WHEN 1 THEN 'blue anvil + nothing / green' WHEN 2 THEN 'nothing' WHEN 3 THEN 'a small ring' WHEN 4 THEN 'nothing + red / steel + none' ELSE 'blue bolt + red ring' END"
TUMOUR = "CASE WHEN n_nationkey % 4 = 0 THEN 'none of these' ELSE lower(seg) || ' cancer' END"
CASES_SQL = f"""cases AS (SELECT n_nationkey * 100 + k AS case_id, {KIND} AS kind, upper(r_name) AS gene, upper({VARIANT}) AS variant, upper({KEY}) AS key, {TUMOUR} AS tumour, {EXPECTED} AS expected FROM nation JOIN region ON r_regionkey = n_regionkey,
 (SELECT seg, row_number() OVER (ORDER BY seg) AS k FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)))"""
FUSION_WORDS = ("#0000000",)


def cases(spark, d) -> DataFrame:
    """A case for each nation and market segment, of five kinds of alteration."""
    from pyspark.sql import Window

    seg = read(spark, d, "customer").select(col("c_mktsegment").alias("seg")).distinct()
    seg = seg.withColumn("k", F.row_number().over(Window.orderBy("seg")))  # a handful of segments
    rows = read(spark, d, "nation").join(read(spark, d, "region"), col("n_regionkey") == col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.explode(F.array(*map(lit, range(1, 6)))).alias("k")).join(seg, "k")
    return rows.select(
        (col("n_nationkey") * 100 + col("k")).cast("long").alias("case_id"), F.expr(KIND).alias("kind"), col("r_name").alias("gene"), F.expr(VARIANT).alias("variant"), F.expr(KEY).alias("key"), F.expr(TUMOUR).alias("tumour"), F.expr(EXPECTED).alias("expected"),
    )


_TOKENS = "string_split(variant, ' ')"
AUDIT_SQL = f"""WITH said AS ({_said}), {CASES_SQL},
 pairs AS (SELECT case_id, n_nationkey AS v, CASE WHEN NOT variant IN ('MUTATION', 'AMPLIFICATION') AND contains(upper(n_name), coalesce(list_filter({_TOKENS}, lambda w: regexp_matches(w, '^(?:[A-Z]\\d+[A-Z]?|EX|ITD|DEL|INS|R\\d+)'))[1], {_TOKENS}[1])) THEN 2
  WHEN NOT variant IN ('MUTATION', 'AMPLIFICATION') AND coalesce(contains(upper(n_name), list_filter({_TOKENS}, lambda w: regexp_matches(w, '^\\d+$'))[1]), FALSE) THEN 1 ELSE 0 END AS level
  FROM cases JOIN region ON upper(r_name) = gene JOIN nation ON n_regionkey = r_regionkey WHERE kind NOT IN ('biomarker', 'fusion')),
 variants AS (SELECT case_id, v FROM pairs QUALIFY level = max(level) OVER (PARTITION BY case_id) UNION SELECT case_id, n_nationkey FROM cases JOIN nation ON contains(upper(n_name), key) WHERE kind = 'biomarker'),
 profiles AS (SELECT case_id, c_custkey AS mp FROM variants JOIN customer ON c_nationkey = v
  UNION SELECT case_id, c_custkey FROM cases JOIN customer ON contains(upper(c_name), key) WHERE kind = 'biomarker' AND case_id NOT IN (SELECT case_id FROM variants)
  UNION SELECT case_id, c_custkey FROM cases JOIN customer ON contains(upper(c_name), key) AND contains(upper(c_name), '#0000000') WHERE kind = 'fusion'
  UNION SELECT case_id, c_custkey FROM cases JOIN region ON upper(r_name) = gene JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE kind = 'fusion' AND NOT EXISTS (SELECT 1 FROM customer x WHERE contains(upper(x.c_name), key) AND contains(upper(x.c_name), '#0000000'))),
 rows AS (SELECT DISTINCT p.case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, o_orderpriority AS level, c_mktsegment AS disease, upper(p_name) AS drug FROM profiles p JOIN customer ON c_custkey = mp JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND l_returnflag = 'A'),
 fit AS (SELECT x, y FROM (SELECT DISTINCT lower(trim(tumour)) AS x FROM cases), (SELECT DISTINCT lower(trim(disease)) AS y FROM rows) WHERE {FITS}),
 judged AS (SELECT r.*, EXISTS (SELECT 1 FROM fit WHERE x = lower(trim(c.tumour)) AND y = lower(trim(r.disease))) AS fits FROM rows r JOIN cases c USING (case_id)),
 kept AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY case_id, source) AS on_tumour FROM judged) WHERE fits OR NOT on_tumour),
 wanted AS (SELECT case_id, alternative, len(parts) AS size, unnest(parts) AS part FROM (SELECT case_id, alternative, list_distinct(list_filter(list_transform(string_split(a, '+'), lambda x: upper(trim(x))), lambda x: x <> '')) AS parts FROM (SELECT case_id, unnest(string_split(expected, '/')) AS a, unnest(range(len(string_split(expected, '/')))) AS alternative FROM cases))),
 hits AS (SELECT DISTINCT w.case_id, alternative, size, part, source, on_tumour FROM wanted w JOIN kept k ON k.case_id = w.case_id AND (contains(k.drug, part) OR contains(part, k.drug))),
 first AS (SELECT case_id, min(alternative) AS alternative FROM (SELECT case_id, alternative FROM hits GROUP BY case_id, alternative, size HAVING count(DISTINCT part) = size) GROUP BY 1),
 sound AS (SELECT DISTINCT h.case_id FROM hits h JOIN first USING (case_id, alternative) WHERE on_tumour GROUP BY h.case_id, source, size HAVING count(DISTINCT part) = size)
 SELECT c.case_id, CASE WHEN m.matched IS NULL THEN 'GAP' WHEN f.case_id IS NULL OR s.case_id IS NULL THEN 'PARTIAL' ELSE 'COVERED' END AS status, coalesce(m.matched, '') AS matched, coalesce(k.sources, '') AS sources, coalesce(k.levels, '') AS levels, f.case_id IS NOT NULL AND s.case_id IS NULL AS downgraded
 FROM cases c LEFT JOIN (SELECT h.case_id, string_agg(DISTINCT part, ',' ORDER BY part) AS matched FROM hits h LEFT JOIN first f USING (case_id) WHERE f.case_id IS NULL OR f.alternative = h.alternative GROUP BY 1) m USING (case_id) LEFT JOIN first f USING (case_id) LEFT JOIN sound s USING (case_id)
 LEFT JOIN (SELECT case_id, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, string_agg(DISTINCT level, '/' ORDER BY level) AS levels FROM kept GROUP BY 1) k USING (case_id)"""


@query(AUDIT_SQL)
def v18_coverage_audit(spark, d):
    """Expected drugs of every case against those with evidence: routed by kind of alteration, by source, lowered where no
    source has them for the case's tumour."""
    nation, region, customer = read(spark, d, "nation"), read(spark, d, "region"), read(spark, d, "customer")
    variants = nation.join(region, col("n_regionkey") == col("r_regionkey")).select(col("r_name").alias("gene"), col("n_nationkey").alias("variant_id"), col("n_name").alias("name"))
    profiles = customer.select(col("c_nationkey").alias("variant_id"), col("c_custkey").alias("profile"), col("c_name").alias("name"))
    asked = cases(spark, d)
    # Profiles of the same cases are one set: their evidence is made distinct once for the set, then given to its cases.
    found = A.case_profiles(asked, variants, profiles, FUSION_WORDS).groupBy("profile").agg(F.array_sort(F.collect_set("case_id")).alias("case_ids"))
    found = stored(found)
    sets = stored(found.select("case_ids").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    rows = found.join(if_small(sets), "case_ids").select("profile", "set_id").join(customer.select(col("c_custkey").alias("profile"), col("c_mktsegment").alias("disease")), "profile").join(read(spark, d, "orders").where("o_orderstatus = 'F'"), col("o_custkey") == col("profile"))
    rows = rows.join(read(spark, d, "lineitem").where("l_returnflag = 'A'"), col("l_orderkey") == col("o_orderkey")).join(read(spark, d, "part"), col("p_partkey") == col("l_partkey"))
    source = F.when(col("o_orderkey") % 2 == 0, "A").otherwise("B")
    evidence = stored(rows.select("set_id", source.alias("source"), col("o_orderpriority").alias("level"), "disease", col("p_name").alias("drug")).distinct())
    evidence = evidence.join(sets, "set_id").select(F.explode("case_ids").alias("case_id"), "source", "level", "disease", "drug")
    return A.audited(asked, stored(evidence.distinct()), SYNONYMS)
