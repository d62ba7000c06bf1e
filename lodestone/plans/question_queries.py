"""Questions about the graph: made from its own names, linked, routed, answered and scored, each query beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import cases as C
from lodestone.operators import linking as K
from lodestone.operators import retrieval as R
from lodestone.operators import routes as G
from lodestone.plans.registry import query
from lodestone.sources.projection import evidence_graph, read
from lodestone.sources.tables import durable, stored

col, lit = F.col, F.lit

#: Two wordings of the questions of each route; the second leaves out some of the words that a keyword router looks for.
WORDINGS = {
    "GENE_TO_DRUG": ("Quali farmaci hanno evidenza clinica per il gene %s?", "Quali farmaci per %s?"),
    "GENE_TO_DISEASE": ("In quali malattie il gene %s ha evidenza clinica?", "In quali tumori conta il gene %s?"),
    "GENE_TO_CDX": ("Quali test companion ci sono per il gene %s?", "Quali test servono per il gene %s?"),
    "GENE_TO_TRIALDRUG": ("Quali farmaci sono testati in un trial per il gene %s?", "Quali farmaci sono in studio per il gene %s?"),
    "GENE_EVIDENCE_TRIAL_BRIDGE": ("Quali farmaci hanno evidenza e sono testati in un trial per il gene %s?", "Quali farmaci provati e in trial per il gene %s?"),
    "VARIANT_TO_DRUG": ("Quali farmaci per %s con la variante %s?", "Quali farmaci per %s e %s?"),
    "DRUG_TO_GENE_CDX": ("Quale gene rileva il test companion del farmaco %s?", "Che cosa rileva il test per %s?"),
}
LABELS = ["Gene", "Variant", "Drug", "Disease", "Device"]


def questions(spark, d) -> DataFrame:
    """(qid, text, true_route, anchor) of every gene and route, every variant and every name of a drug, in both wordings."""
    region, nation = read(spark, d, "region").select("r_regionkey", "r_name"), read(spark, d, "nation")
    drugs = read(spark, d, "part").select("p_name").distinct()
    variants = nation.join(region, col("n_regionkey") == col("r_regionkey"))
    out = []
    for route, wordings in WORDINGS.items():
        for k, wording in enumerate(wordings):
            if route == "VARIANT_TO_DRUG":
                rows, names, anchor = variants, ("r_name", "n_name"), F.concat(lit("Variant:"), col("n_nationkey").cast("string"))
            elif route == "DRUG_TO_GENE_CDX":
                rows, names, anchor = drugs, ("p_name",), col("p_name")
            else:
                rows, names, anchor = region, ("r_name",), F.concat(lit("Gene:"), col("r_regionkey").cast("string"))
            out.append(rows.select(F.concat(lit(f"{route}/{k}/"), anchor).alias("qid"), F.format_string(wording, *names).alias("text"), lit(route).alias("true_route"), anchor.alias("anchor")))
    # Cut here, as filters would be pushed through the distinct and read the words of every part.
    return durable(reduce(DataFrame.union, out))


def _asked_sql() -> str:
    out = []
    for route, wordings in WORDINGS.items():
        for k, wording in enumerate(wordings):
            if route == "VARIANT_TO_DRUG":
                rows, names, anchor = "region JOIN nation ON n_regionkey = r_regionkey", ["r_name", "n_name"], "'Variant:' || n_nationkey"
            elif route == "DRUG_TO_GENE_CDX":
                rows, names, anchor = "(SELECT DISTINCT p_name FROM part)", ["p_name"], "p_name"
            else:
                rows, names, anchor = "region", ["r_name"], "'Gene:' || r_regionkey"
            parts = wording.split("%s")
            text = " || ".join(f"'{p}'" + (f" || {names[i]}" if i < len(names) else "") for i, p in enumerate(parts))
            out.append(f"SELECT '{route}/{k}/' || {anchor} AS qid, {text} AS text, '{route}' AS true_route, {anchor} AS anchor FROM {rows}")
    return "asked AS (" + " UNION ALL ".join(out) + ")"


def _any_sql(words, t: str = "t") -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


ROUTE_SQL = f"""CASE WHEN {_any_sql(C.COMPANION_WORDS)} AND contains(t, 'gene') AND {_any_sql(C.DETECT_WORDS)} THEN 'DRUG_TO_GENE_CDX' WHEN {_any_sql(C.COMPANION_WORDS)} THEN 'GENE_TO_CDX'
 WHEN {_any_sql(C.TRIAL_WORDS)} AND {_any_sql(C.EVIDENCE_WORDS)} THEN 'GENE_EVIDENCE_TRIAL_BRIDGE' WHEN {_any_sql(C.TRIAL_WORDS)} THEN 'GENE_TO_TRIALDRUG' WHEN {_any_sql(C.DISEASE_WORDS)} THEN 'GENE_TO_DISEASE'
 WHEN {_any_sql(C.VARIANT_WORDS)} THEN 'VARIANT_TO_DRUG' ELSE 'GENE_TO_DRUG' END"""
FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
NAMES_SQL = """names AS (SELECT 'Gene:' || r_regionkey AS node, 'Gene' AS label, r_name AS alias FROM region UNION ALL SELECT 'Variant:' || n_nationkey, 'Variant', n_name FROM nation UNION ALL SELECT 'Drug:' || p_partkey, 'Drug', p_name FROM part
 UNION ALL SELECT DISTINCT 'Disease:' || c_mktsegment, 'Disease', c_mktsegment FROM customer UNION ALL SELECT DISTINCT 'Device:' || p_brand, 'Device', p_brand FROM part)"""
MENTIONS_SQL = f"""keys AS (SELECT DISTINCT node, label, {FOLD.format('alias')} AS key FROM names), cut AS (SELECT qid, list_filter(string_split({FOLD.format('text')}, ' '), lambda x: x <> '') AS t FROM asked),
 grams AS (SELECT qid, n, i AS pos, array_to_string(t[i:i + n - 1], ' ') AS key FROM (SELECT qid, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3]) AS n))),
 met AS (SELECT qid, node, label, min((-n, pos)) AS o FROM grams JOIN keys USING (key) WHERE length(key) > 2 GROUP BY ALL), linked AS (SELECT qid, node, label, row_number() OVER (PARTITION BY qid ORDER BY o, node)::INTEGER AS place FROM met)"""
REFINED_SQL = f"""firsts AS (SELECT l.qid, arg_min(l.node, l.place) AS gene, any_value({FOLD.format('a.text')}) AS q FROM linked l JOIN asked a USING (qid) WHERE label = 'Gene' GROUP BY l.qid HAVING {_any_sql(C.VARIANT_WORDS, f"any_value({FOLD.format('a.text')})")}),
 said AS (SELECT f.qid, 'Variant:' || n_nationkey AS node, {FOLD.format('n_name')} AS v, CASE WHEN contains(q, {FOLD.format('r_name')}) THEN substr(q, instr(q, {FOLD.format('r_name')}) + length({FOLD.format('r_name')})) ELSE q END AS after FROM firsts f JOIN region ON f.gene = 'Gene:' || r_regionkey JOIN nation ON n_regionkey = r_regionkey),
 best AS (SELECT qid, node, (row_number() OVER (PARTITION BY qid ORDER BY length(v) DESC, node DESC) + 1)::INTEGER AS place FROM said WHERE v <> '' AND contains(after, v) QUALIFY place <= 4),
 refined AS (SELECT qid, node, label, place FROM linked WHERE qid NOT IN (SELECT qid FROM firsts) UNION ALL SELECT qid, gene, 'Gene', 1 FROM firsts UNION ALL SELECT qid, node, 'Variant', place FROM best)"""
LINKS_SQL = f"{_asked_sql()}, {NAMES_SQL}, {MENTIONS_SQL}"


def linked(spark, d, asked: DataFrame) -> DataFrame:
    return K.mentions(asked, G.names_of(evidence_graph(spark, d), LABELS))


def refined(spark, d, asked: DataFrame) -> DataFrame:
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    variants = nation.join(region.select("r_regionkey", "r_name"), col("n_regionkey") == col("r_regionkey"))
    variants = variants.select(F.concat(lit("Gene:"), col("r_regionkey").cast("string")).alias("gene"), col("r_name").alias("gene_name"), F.concat(lit("Variant:"), col("n_nationkey").cast("string")).alias("node"), col("n_name").alias("name"))
    return K.refined(asked, stored(linked(spark, d, asked)), variants, C.VARIANT_WORDS)


@query(f"WITH {LINKS_SQL} SELECT qid, node, label, place FROM linked")
def f05_mentions(spark, d):
    """Names of the graph that stand in questions, of one to three words, longer ones first."""
    return linked(spark, d, questions(spark, d)).select("qid", "node", "label", "place")


@query(f"WITH {LINKS_SQL}, {REFINED_SQL} SELECT * FROM refined")
def f06_refined(spark, d):
    """Links of questions about variants: the first gene and its variants that are named after it."""
    return refined(spark, d, questions(spark, d))


@query(f"WITH {_asked_sql()} SELECT qid, true_route, (SELECT {ROUTE_SQL} FROM (SELECT lower(text) AS t)) AS route FROM asked")
def f07_keyword_routes(spark, d):
    return questions(spark, d).select("qid", "true_route", C.keyword_route(col("text")).alias("route"))


PHRASES = "(SELECT array_to_string(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1:1 + item_id % 5], ' ') AS key FROM benchmark UNION SELECT p_name FROM part UNION SELECT array_to_string(list_filter(regexp_split_to_array(s_name, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') FROM supplier)"


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
 g AS (SELECT doc_id, i, array_to_string(t[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3, 4, 5]) AS n)))
 SELECT doc_id, key AS name, count(*) AS times, min(i)::INTEGER AS first_at FROM g JOIN {PHRASES} USING (key) GROUP BY 1, 2""")
def j16_words_in_text(spark, d):
    """Names of one to five words over all documents: starts of benchmark items, names of parts and suppliers."""
    item = F.array_join(F.slice(K.exact_words(col("text")), lit(1), (col("item_id") % 5 + 1).cast("int")), " ")
    names = read(spark, d, "benchmark").select(item.alias("alias")).union(read(spark, d, "part").select("p_name")).union(read(spark, d, "supplier").select("s_name"))
    found = K.names_in(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"], names.distinct(), 5)
    return found.groupBy("doc_id", col("key").alias("name")).agg(F.count("*").alias("times"), F.min("at").alias("first_at"))


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
 g AS (SELECT doc_id, i, n, array_to_string(t[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3, 4, 5]) AS n)))
 SELECT key AS name, count(*) AS times, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, key FROM g JOIN {PHRASES} USING (key) QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC) = 1) GROUP BY 1""")
def j16_longest_names(spark, d):
    """Of the names that begin at one place of a document the longest, counted by name."""
    item = F.array_join(F.slice(K.exact_words(col("text")), lit(1), (col("item_id") % 5 + 1).cast("int")), " ")
    names = read(spark, d, "benchmark").select(item.alias("alias")).union(read(spark, d, "part").select("p_name")).union(read(spark, d, "supplier").select("s_name"))
    found = K.names_in(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"], names.distinct(), 5, only_longest=True)
    per = found.groupBy(col("key").alias("name"), "doc_id").agg(F.count("*").alias("n"))  # summed by document first, so that no distinct is expanded
    return per.groupBy("name").agg(F.sum("n").alias("times"), F.count("*").alias("docs"))


# -- the graph's answers ------------------------------------------------------------------------------------------
EDGE_SQL = {
    "HAS_VARIANT": "(SELECT n_regionkey::VARCHAR AS src, n_nationkey::VARCHAR AS dst FROM nation)",
    "IN_MOLECULAR_PROFILE": "(SELECT c_nationkey::VARCHAR AS src, c_custkey::VARCHAR AS dst FROM customer)",
    "HAS_EVIDENCE": "(SELECT o_custkey::VARCHAR AS src, o_orderkey::VARCHAR AS dst FROM orders)",
    "TARGETS_DRUG": "(SELECT DISTINCT l_orderkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem)",
    "HAS_DISEASE": "(SELECT o_orderkey::VARCHAR AS src, c_mktsegment AS dst FROM orders JOIN customer ON c_custkey = o_custkey)",
    "HAS_COMPANION_DIAGNOSTIC": "(SELECT p_partkey::VARCHAR AS src, p_brand AS dst FROM part WHERE p_size <= 25)",
    "DIAGNOSES_GENE": "(SELECT p_brand AS src, (min(p_partkey) % 5)::VARCHAR AS dst FROM part GROUP BY 1)",
    "ASSOCIATED_GENE": "(SELECT s_suppkey::VARCHAR AS src, n_regionkey::VARCHAR AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey)",
    "TESTS_DRUG": "(SELECT DISTINCT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem)",
}
LEAF = {"TARGETS_DRUG": "Drug", "HAS_DISEASE": "Disease", "HAS_COMPANION_DIAGNOSTIC": "Device", "TESTS_DRUG": "Drug", "DIAGNOSES_GENE": "Gene"}


def reach_sql(starts: str, steps) -> str:
    """(start, name): distinct names of what the steps reach from the starts of a table."""
    joins, at = "", "split_part(s.start, ':', 2)"
    for i, (rel, way) in enumerate(steps):
        near, far = ("src", "dst") if way == ">" else ("dst", "src")
        joins += f" JOIN {EDGE_SQL[rel]} e{i} ON e{i}.{near} = {at}"
        at = f"e{i}.{far}"
    return f"(SELECT DISTINCT s.start, n.alias AS name FROM (SELECT DISTINCT start FROM {starts}) s{joins} JOIN names n ON n.node = '{LEAF[steps[-1][0]]}:' || {at})"


def _facts_sql() -> str:
    called = "(SELECT n.node, CASE WHEN v.n_nationkey IS NULL THEN n.alias ELSE r_name || ' ' || n.alias END AS alias FROM names n LEFT JOIN nation v ON n.node = 'Variant:' || v.n_nationkey LEFT JOIN region ON r_regionkey = v.n_regionkey)"
    fact = lambda text, a, b: f"replace(replace('{text.replace('%s', '@', 1)}', '%s', {b}), '@', {a})"
    out = []
    for route in C.ROUTES:
        if route == G.BRIDGE:
            gene = "(SELECT r.qid, arg_min(r.node, r.place) AS start FROM refined r JOIN routed USING (qid) WHERE route = 'GENE_EVIDENCE_TRIAL_BRIDGE' AND label = 'Gene' GROUP BY 1)"
            ends = [reach_sql(gene, C.ROUTES[k][1]) for k in ("GENE_TO_DRUG", "GENE_TO_TRIALDRUG")]
            out.append(f"SELECT g.qid, 1 AS place, a.name AS key, {fact(C.BRIDGE_FACT, 'a.name', 'c.alias')} AS text FROM {gene} g JOIN {ends[0]} a ON a.start = g.start JOIN {ends[1]} b ON b.start = g.start AND b.name = a.name JOIN names c ON c.node = g.start")
            continue
        for label, steps, fallback in G.chains(route):
            alone = f" AND r.qid NOT IN (SELECT x.qid FROM refined x WHERE x.label = '{C.ROUTES[route][0]}')" if fallback else ""
            own = f"(SELECT r.qid, r.place, r.node AS start FROM refined r JOIN routed USING (qid) WHERE route = '{route}' AND label = '{label}'{alone})"
            text = fact(C.FACTS[label, LEAF[steps[-1][0]], steps[-1][0]], "c.alias", "e.name")
            out.append(f"SELECT o.qid, o.place, {text} AS key, {text} AS text FROM {own} o JOIN {reach_sql(own, steps)} e ON e.start = o.start JOIN {called} c ON c.node = o.start")
    return f"""routed AS (SELECT qid, (SELECT {ROUTE_SQL} FROM (SELECT lower(text) AS t)) AS route FROM asked), facts AS ({' UNION ALL '.join(out)}), once AS (SELECT qid, text, min((place, key)) AS o FROM facts GROUP BY 1, 2),
 cum AS (SELECT qid, text, rank, sum(len(string_split(text, ' '))) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS upto FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o)::INTEGER AS rank FROM once))"""


GRAPH_SQL = f"{LINKS_SQL}, {REFINED_SQL}, {_facts_sql()}"


def graph_context(spark, d, budget: int = 900) -> DataFrame:
    asked = questions(spark, d)
    routed = asked.select("qid", C.keyword_route(col("text")).alias("route"))
    return G.graph_facts(evidence_graph(spark, d), routed, refined(spark, d, asked), budget)


@query(f"WITH {GRAPH_SQL} SELECT qid, rank, text, upto FROM cum WHERE rank = 1 OR upto <= 900")
def r05_graph_facts(spark, d):
    """Every question linked, routed and answered from the graph: facts once, in order, under the word budget."""
    return graph_context(spark, d).select("qid", "rank", "text", "upto")


TEMPLATES = {"gene_to_variants": (("HAS_VARIANT", ">"),), "gene_to_drugs": C.ROUTES["GENE_TO_DRUG"][1], "gene_to_diseases": C.ROUTES["GENE_TO_DISEASE"][1], "gene_to_cdx": C.ROUTES["GENE_TO_CDX"][1]}
LEAF["HAS_VARIANT"] = "Variant"


def answer_sets(spark, d, chains: dict, label: str = "Gene") -> DataFrame:
    """(start, chain, name): what each chain reaches from every node of a label, by distinct name."""
    graph = evidence_graph(spark, d)
    starts = G.names_of(graph, [label]).select(col("node").alias("start"))
    number = G.numbered(graph, [(label, steps) for steps in chains.values()])
    asked = F.array(*[F.struct(lit(k).alias("chain"), lit(number[label, steps]).alias("tail")) for k, steps in chains.items()])
    ends = G.answers(graph, starts, number).withColumn("_c", F.explode(F.filter(asked, lambda x: x["tail"] == col("tail"))))
    return ends.select("start", "_c.chain", "name")


SETS_SQL = " UNION ALL ".join(f"SELECT start, '{k}' AS chain, name FROM {reach_sql('(SELECT node AS start FROM names WHERE label = chr(71) || chr(101) || chr(110) || chr(101))', steps)}" for k, steps in TEMPLATES.items()).replace("chr(71) || chr(101) || chr(110) || chr(101)", "'Gene'")
BIN = "CASE WHEN count(*) >= 9 THEN '9+' WHEN count(*) >= 5 THEN '5-8' WHEN count(*) >= 3 THEN '3-4' ELSE '2' END"


@query(f"WITH {NAMES_SQL} SELECT (SELECT alias FROM names n WHERE n.node = s.start) AS gene, chain AS template, count(*) AS size, string_agg(name, '|' ORDER BY name) AS gold, {BIN} AS bin FROM ({SETS_SQL}) s GROUP BY start, chain HAVING count(*) >= 2")
def r12_question_sets(spark, d):
    """All genes and templates with at least two answers, with their bins."""
    genes = G.names_of(evidence_graph(spark, d), ["Gene"]).select(col("node").alias("start"), col("alias").alias("gene"))
    sets = answer_sets(spark, d, TEMPLATES).groupBy("start", col("chain").alias("template")).agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("gold"))
    width = F.when(col("size") >= 9, "9+").when(col("size") >= 5, "5-8").when(col("size") >= 3, "3-4").otherwise("2")
    return sets.where("size >= 2").join(genes, "start").select("gene", "template", "size", "gold", width.alias("bin"))


GENE_ROUTES = {k: C.ROUTES[k][1] for k in ("GENE_TO_DRUG", "GENE_TO_DISEASE", "GENE_TO_CDX", "GENE_TO_TRIALDRUG")}
ROUTE_SETS_SQL = " UNION ALL ".join(f"SELECT start, '{k}' AS chain, name FROM {reach_sql('genes', steps)}" for k, steps in GENE_ROUTES.items())


@query(f"""WITH {_asked_sql()}, {NAMES_SQL}, genes AS (SELECT node AS start FROM names WHERE label = 'Gene'), sets AS ({ROUTE_SETS_SQL}), n AS (SELECT start, chain, count(*) AS n FROM sets GROUP BY 1, 2),
 r AS (SELECT true_route, (SELECT {ROUTE_SQL} FROM (SELECT lower(text) AS t)) AS pred_route, anchor FROM asked WHERE true_route IN ('GENE_TO_DRUG', 'GENE_TO_DISEASE', 'GENE_TO_CDX', 'GENE_TO_TRIALDRUG')),
 s AS (SELECT r.*, (SELECT count(*) FROM sets a JOIN sets b USING (start, name) WHERE a.start = r.anchor AND a.chain = true_route AND b.chain = pred_route) AS hit, coalesce(t.n, 0) AS nt, coalesce(p.n, 0) AS np
 FROM r LEFT JOIN n t ON t.start = r.anchor AND t.chain = true_route LEFT JOIN n p ON p.start = r.anchor AND p.chain = pred_route)
 SELECT true_route, pred_route, count(*) AS n, true_route = pred_route AS correct, round(avg(CASE WHEN hit > 0 THEN 2.0 * hit / (nt + np) ELSE 0 END) - avg((nt > 0)::INTEGER), 6)::DOUBLE AS f1_impact FROM s GROUP BY 1, 2""")
def r16_router_ablation(spark, d):
    """Questions under the true and the predicted route: answer sets of a gene are made and scored once for each pair of
    routes, however many questions have that pair; then confusion and its cost in F1."""
    rows = questions(spark, d).where(col("true_route").isin(*GENE_ROUTES)).select("anchor", "true_route", C.keyword_route(col("text")).alias("pred_route"))
    asked = rows.groupBy("anchor", "true_route", "pred_route").agg(F.count("*").alias("n"))
    sets = durable(answer_sets(spark, d, GENE_ROUTES).select(col("start").alias("anchor"), "chain", "name"))
    sizes = sets.groupBy("anchor", "chain").agg(F.count("*").alias("size"))
    both = asked.join(sets.withColumnRenamed("chain", "true_route"), ["anchor", "true_route"]).join(sets.withColumnRenamed("chain", "pred_route"), ["anchor", "pred_route", "name"])
    hits = both.groupBy("anchor", "true_route", "pred_route").agg(F.count("*").alias("hit"))
    met = asked.join(hits, ["anchor", "true_route", "pred_route"], "left")
    met = met.join(sizes.select("anchor", col("chain").alias("true_route"), col("size").alias("nt")), ["anchor", "true_route"], "left")
    met = met.join(sizes.select("anchor", col("chain").alias("pred_route"), col("size").alias("np")), ["anchor", "pred_route"], "left").na.fill(0, ["hit", "nt", "np"])
    f1 = F.when(col("hit") > 0, 2 * col("hit") / (col("nt") + col("np"))).otherwise(0.0)
    impact = F.sum(col("n") * (f1 - (col("nt") > 0).cast("int"))) / F.sum("n")
    return met.groupBy("true_route", "pred_route").agg(F.sum("n").alias("n"), F.round(impact, 6).alias("f1_impact")).withColumn("correct", col("true_route") == col("pred_route"))
