"""Loading, joining and auditing over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import analytics as A
from lodestone.operators import joins as J
from lodestone.plans.registry import query
from lodestone.sources import tables as S
from lodestone.sources.projection import evidence_graph, read

col, lit = F.col, F.lit


@query("SELECT p_partkey, try_cast(p_brand[7:] AS INTEGER) AS brand_no, try_cast(p_type AS INTEGER) AS type_no, array_to_string(string_split(p_name, ' '), '|') AS words FROM part")
def io06_converted(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.expr("substring(p_brand, 7)").alias("brand_no"), col("p_type").alias("type_no"), col("p_name").alias("words"))
    out = S.converted(rows, {"brand_no": "int", "type_no": "int"}, {"words": " "})
    return out.withColumn("words", F.array_join("words", "|"))


@query("SELECT o_custkey AS key, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY 1")
def io16_first_and_last(spark, d):
    o = read(spark, d, "orders").select(col("o_custkey").alias("key"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    first = S.kept(o, ["key"], col("at")).select("key", col("o_orderkey").alias("first_order"))
    return first.join(S.kept(o, ["key"], col("at"), latest=True).select("key", col("o_orderkey").alias("last_order")), "key")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0")
def io16_upsert(spark, d):
    c = read(spark, d, "customer")
    old = c.where("c_custkey % 3 > 0").select(col("c_custkey").alias("id"), col("c_name").alias("name"))
    new = c.select(col("c_custkey").alias("id"), F.upper("c_name").alias("name"), col("c_custkey").alias("at"))
    return S.upserted(old, new.unionByName(new.withColumn("name", F.lower("name")).withColumn("at", col("at") + 1)), ["id"], "at")


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def io17_edges(spark, d):
    edges = read(spark, d, "lineitem").select(col("l_partkey").alias("src"), col("l_suppkey").alias("dst"))
    return S.linked(edges, read(spark, d, "part").where("p_size > 20").select("p_partkey"), read(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def io14_unmatched(spark, d):
    return S.unmatched(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").where("o_orderstatus = 'P'").select(col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def io19_repeated_keys(spark, d):
    return S.repeated_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS turns, max(CASE WHEN role = 'user' THEN turn END) AS last_user FROM (SELECT conv_id, turn, role, text FROM conversations) GROUP BY 1")
def io08_json_roundtrip(spark, d):
    packed = read(spark, d, "conversations").select("conv_id", F.to_json(F.struct("turn", "role", "text")).alias("j"))
    t = packed.select("conv_id", F.from_json("j", "turn long, role string, text string").alias("t")).select("conv_id", "t.*")
    return t.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"), F.max(F.when(col("role") == "user", col("turn"))).alias("last_user"))


@query("SELECT c_custkey, coalesce(x.o, -1) AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o FROM orders GROUP BY 1) x ON x.o_custkey = c_custkey")
def j12_lookup(spark, d):
    table = read(spark, d, "orders").select(col("o_custkey").alias("c_custkey"), col("o_orderkey").alias("last_order"), col("o_orderkey").alias("at"))
    return J.lookup(read(spark, d, "customer").select("c_custkey"), table, "c_custkey", "last_order", "at").na.fill(-1, ["last_order"])


@query("SELECT p_partkey, other FROM part JOIN (SELECT upper(trim(' ' || lower(p_name) || ' ')) AS k, min(p_partkey) AS other FROM part GROUP BY 1) ON k = upper(trim(p_name))")
def j13_folded_names(spark, d):
    """Rows with the first one whose name is the same but for case and blanks."""
    p = read(spark, d, "part")
    first = p.groupBy(F.upper(F.trim(F.concat(lit(" "), F.lower("p_name"), lit(" ")))).alias("k")).agg(F.min("p_partkey").alias("other"))
    return p.select("p_partkey", F.upper(F.trim("p_name")).alias("k")).join(first, "k").select("p_partkey", "other")


KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"


@query(f"SELECT k AS name_key, max(p_partkey) AS p_partkey FROM (SELECT {KEY.format('p_name')} AS k, p_partkey FROM part UNION ALL SELECT {KEY.format('p_brand')}, p_partkey FROM part) GROUP BY 1")
def j14_name_index(spark, d):
    return J.name_index(read(spark, d, "part"), "p_partkey", ["p_name", "p_brand"], "p_partkey")


@query(f"""WITH ix AS (SELECT {KEY.format('split_part(p_name, chr(32), 1)')} AS k, max(p_partkey) AS p FROM part GROUP BY 1) SELECT o_orderkey, coalesce(a.p, b.p, c.p) AS p_partkey FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'b-l-u-e' WHEN 2 THEN 'a small one' ELSE 'none' END AS n FROM orders)
 LEFT JOIN ix a ON a.k = upper(trim(n)) LEFT JOIN ix b ON b.k = {KEY.format('n')} LEFT JOIN ix c ON c.k = CASE WHEN n = 'a small one' THEN 'SMALL' WHEN n = 'red' THEN 'RED' END""")
def j15_cascade(spark, d):
    index = J.name_index(read(spark, d, "part").withColumn("w", F.split_part("p_name", lit(" "), lit(1))), "p_partkey", ["w"], "p_partkey")
    k = col("o_orderkey") % 4
    rows = read(spark, d, "orders").select("o_orderkey", F.when(k == 0, "red").when(k == 1, "b-l-u-e").when(k == 2, "a small one").otherwise("none").alias("n"))
    return J.cascade(rows, "n", index, "p_partkey").drop("n")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'known' || p_name ELSE 'fda:' || p_name END AS ident FROM part WHERE FALSE UNION ALL SELECT p_partkey, coalesce(k.ident, 'fda:' || p_name) FROM part LEFT JOIN (SELECT DISTINCT p_name, 'known ' || p_name AS ident FROM part WHERE contains(p_name, 'red')) k USING (p_name)")
def j28_get_or_create(spark, d):
    p = read(spark, d, "part")
    known = p.where("contains(p_name, 'red')").select("p_name", F.concat(lit("known "), "p_name").alias("ident")).distinct()
    rows, _ = J.get_or_create(p.select("p_partkey", "p_name"), known, "p_name", "ident", "fda:")
    return rows.select("p_partkey", "ident")


@query("SELECT c_custkey, coalesce(x.s, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) x ON x.o_custkey = c_custkey")
def j29_overwritten(spark, d):
    news = read(spark, d, "orders").where("o_orderstatus = 'P'").select(col("o_custkey").alias("c_custkey"), col("o_orderpriority").alias("c_mktsegment"), col("o_orderkey").alias("at"))
    return J.overwritten(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), news, "c_custkey", ["c_mktsegment"], "at")


#: Relationships that read off a text column of a node what routes ask for; the catalog of the schema does not have them.
ROUTES_ONLY = ("HAS_DISEASE", "DIAGNOSES_GENE")


@query("SELECT 'HAS_VARIANT' AS relation, 'Gene' AS source, 'Variant' AS target UNION SELECT * FROM (VALUES ('IN_MOLECULAR_PROFILE', 'Variant', 'MolecularProfile'), ('HAS_EVIDENCE', 'MolecularProfile', 'Evidence'), ('TARGETS_DRUG', 'Evidence', 'Drug'), ('CITED_IN', 'Evidence', 'Publication'), ('HAS_COMPANION_DIAGNOSTIC', 'Drug', 'Device'), ('ASSOCIATED_GENE', 'ClinicalTrial', 'Gene'), ('TESTS_DRUG', 'ClinicalTrial', 'Drug'), ('INTERACTS_WITH', 'Gene', 'Drug'))")
def j27_schema_triples(spark, d):
    """(label, relationship, label) of what the entry's schema names; HAS_DISEASE and DIAGNOSES_GENE, which the graph has for
    routes only, are not in it."""
    out = None
    for name, e in evidence_graph(spark, d).edges.items():
        if name in ROUTES_ONLY:
            continue
        one = e.table.limit(1).select(lit(name).alias("relation"), lit(e.source).alias("source"), lit(e.target).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT a.c_mktsegment AS x, b.c_mktsegment AS y, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) a JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) b USING (c_nationkey) WHERE NOT contains(lower(b.c_mktsegment), lower(a.c_mktsegment)) GROUP BY 1, 2")
def j26_mismatched_pairs(spark, d):
    s = read(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    pairs = s.select("c_nationkey", col("c_mktsegment").alias("x")).join(s.select("c_nationkey", col("c_mktsegment").alias("y")), "c_nationkey").where(~F.contains(F.lower("y"), F.lower("x")))
    return pairs.groupBy("x", "y").agg(F.count("*").alias("n"))


# -- analytics ----------------------------------------------------------------------------------------------------


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("SELECT c AS column, n, nulls, v AS values, nulls / n AS null_share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS v FROM lineitem" for c in LINE_COLUMNS) + ")")
def a09_column_profile(spark, d):
    """Every column of the largest table at once: rows, nulls, different values."""
    return A.column_profile(read(spark, d, "lineitem"), LINE_COLUMNS)


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.25), 4) AS low, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS high FROM lineitem GROUP BY 1")
def a12_quantiles(spark, d):
    """Exact quartile, median and ninth decile of a group from its counted values."""
    q = A.quantiles(read(spark, d, "lineitem"), "l_extendedprice", {"low": 0.25, "middle": 0.5, "high": 0.9}, ["l_returnflag"])
    return q.select(col("l_returnflag").alias("flag"), *[F.round(c, 4).alias(c) for c in ("low", "middle", "high")])


@query("SELECT o_custkey AS customer, string_agg(level || '/' || status || '/' || year, ';' ORDER BY level, status, year) AS items, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority AS level, o_orderstatus AS status, year(o_orderdate) AS year FROM orders) GROUP BY 1")
def a05_distinct_maps(spark, d):
    """The different (level, status, year) of each customer's orders, as maps."""
    sets = A.distinct_maps(read(spark, d, "orders"), "o_custkey", {"level": col("o_orderpriority"), "status": col("o_orderstatus"), "year": F.year("o_orderdate")})
    said = F.transform("items", lambda x: F.concat_ws("/", x["level"], x["status"], x["year"].cast("string")))
    return sets.select(col("o_custkey").alias("customer"), F.array_join(said, ";").alias("items"), F.size("items").cast("long").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def a07_value_counts(spark, d):
    return A.value_counts(read(spark, d, "part"), "p_brand", "p_type")


@query("SELECT max(n) AS most, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sample_std, round(stddev_pop(n), 6) AS population_std, median(n) AS median FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def a10_degree_statistics(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    stats = n.agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("sample_std"), F.round(F.stddev_pop("n"), 6).alias("population_std"))
    return stats.join(A.quantiles(n, "n", {"median": 0.5}))  # one row each


@query("SELECT c_mktsegment, round((2 * sum(i * n) - (max(c) + 1) * sum(n)) / (max(c) * sum(n)), 9) AS gini FROM (SELECT c_mktsegment, n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS c FROM (SELECT c_mktsegment, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)) GROUP BY 1")
def a13_gini(spark, d):
    n = read(spark, d, "customer").join(read(spark, d, "orders"), col("o_custkey") == col("c_custkey")).groupBy("c_mktsegment", "c_custkey").agg(F.count("*").alias("n"))
    return A.gini(n, "n", "c_mktsegment").withColumn("gini", F.round("gini", 9))


@query("SELECT l_returnflag, round(sum(power(100.0 * n / t, 2)), 6) AS hhi FROM (SELECT l_returnflag, l_suppkey, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag) AS t FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a14_concentration(spark, d):
    return A.concentration(read(spark, d, "lineitem"), "l_returnflag", "l_suppkey").withColumn("hhi", F.round("hhi", 6))


@query("SELECT v, e, round(e / (v * (v - 1.0)), 9) AS density, round(e / v, 9) AS mean_degree FROM (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS v, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS e)")
def a15_density(spark, d):
    v = read(spark, d, "part").agg(F.count("*").alias("a")).crossJoin(read(spark, d, "supplier").agg(F.count("*").alias("b")))  # one row each
    e = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("e"))
    both = v.crossJoin(e).select((col("a") + col("b")).alias("v"), "e")
    return both.select("v", "e", F.round(col("e") / (col("v") * (col("v") - 1.0)), 9).alias("density"), F.round(col("e") / col("v"), 9).alias("mean_degree"))


@query("SELECT coalesce(f, 'All') AS l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) AS \"All\" FROM (SELECT l_returnflag AS f, l_linestatus FROM lineitem) GROUP BY ROLLUP (f)")
def a16_crosstab(spark, d):
    return A.crosstab(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("SELECT p_brand, count(*) FILTER (WHERE p_type = 'ECONOMY') AS ECONOMY, count(*) FILTER (WHERE p_type = 'SMALL') AS SMALL FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5) GROUP BY 1")
def a17_top_crosstab(spark, d):
    return A.top_crosstab(read(spark, d, "part"), "p_brand", "p_type", 5, ["ECONOMY", "SMALL"])


@query("SELECT c_mktsegment, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a20_metric_pivot(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "orders"), col("o_custkey") == col("c_custkey"))
    return rows.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("SELECT stratum, n, round(mean, 4) AS mean, rate FROM (SELECT 'all' AS stratum, count(*) AS n, avg(o_totalprice) AS mean, avg((o_orderstatus = 'F')::INTEGER) AS rate FROM orders UNION ALL SELECT 'urgent', count(*), avg(o_totalprice), avg((o_orderstatus = 'F')::INTEGER) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'large', count(*), avg(o_totalprice), avg((o_orderstatus = 'F')::INTEGER) FROM orders WHERE o_totalprice > 200000)")
def a23_strata(spark, d):
    flags = {"all": lit(True), "urgent": col("o_orderpriority") == "1-URGENT", "large": col("o_totalprice") > 200000}
    return A.strata(read(spark, d, "orders"), flags, [F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.avg((col("o_orderstatus") == "F").cast("int")).alias("rate")])


@query("SELECT l_shipmode AS g, 0.0 AS r FROM (SELECT 1 AS l_shipmode) WHERE FALSE UNION ALL SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'N') <> 0 THEN 1 - count(*) FILTER (WHERE l_returnflag = 'A') / count(*) FILTER (WHERE l_returnflag <> 'N') END FROM lineitem GROUP BY 1")
def a24_ratio(spark, d):
    flag = lambda c: c.cast("int")
    return read(spark, d, "lineitem").groupBy(col("l_suppkey").alias("g")).agg((1 - A.ratio_of_sums(flag(col("l_returnflag") == "A"), flag(col("l_returnflag") != "N"))).alias("r"))


@query("SELECT p_name, bool_or(p_size <= 25) AS approved, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS devices, min(p_type) AS level FROM part GROUP BY 1")
def a25_merged_targets(spark, d):
    return read(spark, d, "part").groupBy("p_name").agg(F.bool_or(col("p_size") <= 25).alias("approved"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("devices"), F.min("p_type").alias("level"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1 ORDER BY o_orderkey LIMIT 5")
def a26_best_per_key(spark, d):
    return A.best_per_key(read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", [col("o_orderpriority"), col("o_orderkey")], 5, col("o_orderkey"))


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def a29_distinct_claims(spark, d):
    return read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@query("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY k) AS segments FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1, 2) GROUP BY 1")
def a31_ordered_categories(spark, d):
    first = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("k"))
    return first.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c_mktsegment"))), lambda x: x["c_mktsegment"]), ",").alias("segments"))


@query("SELECT 'o_orderstatus' AS field, avg((a = 1)::INTEGER) AS stable_share FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS a FROM orders GROUP BY 1) UNION ALL SELECT 'o_orderpriority', avg((a = 1)::INTEGER) FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS a FROM orders GROUP BY 1)")
def a32_stability(spark, d):
    return A.stability(read(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 8) AS mean_delta, l_returnflag = l_linestatus AS correct FROM lineitem GROUP BY 1, 2")
def a33_confusion(spark, d):
    return A.confusion(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", col("l_discount")).withColumn("mean_delta", F.round("mean_delta", 8))


@query("SELECT event_type, n, round_even(100.0 * n / sum(n) OVER (), 2) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def a35_type_shares(spark, d):
    n = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(total).select("event_type", "n", F.bround(100.0 * col("n") / col("t"), 2).alias("share"))  # one total


@query("""SELECT 'HAS_VARIANT' AS relation, count(*) AS n, count(*) FILTER (WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS missing_source, 0::BIGINT AS missing_target FROM nation
 UNION ALL SELECT 'TARGETS_DRUG', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)) FROM lineitem""")
def v19_orphans(spark, d):
    g = evidence_graph(spark, d)
    big = read(spark, d, "part").where("p_size > 3").select(col("p_partkey").alias("id"))
    return A.orphans({"HAS_VARIANT": (g.edges["HAS_VARIANT"].table, g.nodes["Gene"].table, g.nodes["Variant"].table), "TARGETS_DRUG": (g.edges["TARGETS_DRUG"].table, g.nodes["Evidence"].table, big)})


@query("SELECT * FROM (SELECT 'both' AS part, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'only A', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'only R', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')) WHERE n > 0")
def v12_shared_sources(spark, d):
    """Shared, only-left and only-right members, in one aggregation."""
    sides = read(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.bool_or(col("l_returnflag") == "A").alias("a"), F.bool_or(col("l_returnflag") == "R").alias("r"))
    return sides.groupBy(F.when(col("a") & col("r"), "both").when(col("a"), "only A").otherwise("only R").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, array_to_string(list_sort(list_distinct(list_concat(f, o))), ',') AS every, len(list_intersect(f, o))::INTEGER AS n_both, len(list_filter(f, lambda x: NOT list_contains(o, x)))::INTEGER AS n_only FROM (SELECT c_nationkey, list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal < 0) AS f, list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal > 5000) AS o FROM customer GROUP BY 1) WHERE f IS NOT NULL AND o IS NOT NULL")
def u05_array_sets(spark, d):
    sets = read(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set(F.when(col("c_acctbal") < 0, col("c_mktsegment"))).alias("f"), F.collect_set(F.when(col("c_acctbal") > 5000, col("c_mktsegment"))).alias("o"))
    both = sets.where((F.size("f") > 0) & (F.size("o") > 0))
    return both.select("c_nationkey", F.array_join(F.array_sort(F.array_union("f", "o")), ",").alias("every"), F.size(F.array_intersect("f", "o")).alias("n_both"), F.size(F.array_except("f", "o")).alias("n_only"))


@query("SELECT o_orderpriority AS condition, round_even(avg((o_orderstatus = 'F')::INTEGER), 3) AS drug, round_even(avg(CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 3 = 0)::INTEGER END), 3) AS tier FROM orders GROUP BY 1")
def v17_ablation_summary(spark, d):
    return read(spark, d, "orders").groupBy(col("o_orderpriority").alias("condition")).agg(
        F.bround(F.avg((col("o_orderstatus") == "F").cast("int")), 3).alias("drug"), F.bround(F.avg(F.when(col("o_orderstatus") != "P", (col("o_orderkey") % 3 == 0).cast("int"))), 3).alias("tier")
    )
