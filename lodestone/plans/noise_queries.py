"""The noise sweep over four systems, and the false facts it adds, each query beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import cases as C
from lodestone.operators import noise as N
from lodestone.operators import retrieval as R
from lodestone.operators import routes as G
from lodestone.operators import topk
from lodestone.plans.question_queries import EDGE_SQL, FOLD, NAMES_SQL
from lodestone.plans.registry import query
from lodestone.plans.retrieval_queries import bm25_sql
from lodestone.sources.projection import evidence_graph, read
from lodestone.sources.tables import stored

col, lit = F.col, F.lit

SHARES = [0.0, 0.25, 0.5, 1.0]
#: Relationships that get false edges.
KINDS = ("TARGETS_DRUG", "HAS_DISEASE", "DIAGNOSES_GENE", "TESTS_DRUG")
BUDGET = 900


def _truth(graph, kinds=KINDS) -> DataFrame:
    """(rel, src, dst) of the kinds' edges, some more than once."""
    return reduce(DataFrame.union, [graph.edges[k].rows.select(lit(k).alias("rel"), col("src").cast("string").alias("src"), col("dst").cast("string").alias("dst")) for k in kinds])


TRUTH_SQL = "truth AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS rel, src, dst FROM {EDGE_SQL[k]}" for k in KINDS) + ")"
NOISE_SQL = f"""{TRUTH_SQL}, pool AS (SELECT rel, dst, row_number() OVER (PARTITION BY rel ORDER BY dst) - 1 AS place, count(*) OVER (PARTITION BY rel) AS size FROM (SELECT DISTINCT rel, dst FROM truth)),
 needs AS (SELECT rel, src, k_true, size, least(round_even({max(SHARES)}::DOUBLE * k_true, 0)::BIGINT, size - k_true) AS need FROM (SELECT rel, src, count(*) AS k_true FROM truth GROUP BY 1, 2) JOIN (SELECT DISTINCT rel, size FROM pool) USING (rel)),
 draws AS (SELECT rel, src, k_true, need, j, ('0x' || substr(md5(src || '|' || j), 1, 8))::BIGINT % size AS place FROM (SELECT *, unnest(range(0, 16 * need + 64)) AS j FROM needs WHERE need > 0)),
 accepted AS (SELECT rel, src, dst, any_value(k_true) AS k_true, any_value(need) AS need, min(j) AS j FROM draws JOIN pool USING (rel, place) ANTI JOIN truth USING (rel, src, dst) GROUP BY 1, 2, 3),
 noise AS (SELECT rel, src, dst, rank, k_true FROM (SELECT *, row_number() OVER (PARTITION BY rel, src ORDER BY j) - 1 AS rank FROM accepted) WHERE rank < need)"""
LEVEL_SQL = "CASE " + " ".join(f"WHEN rank < round_even({s}::DOUBLE * k_true, 0) THEN {s}::DOUBLE" for s in SHARES) + " END"


def _noise(spark, d) -> DataFrame:
    return N.false_edges(_truth(evidence_graph(spark, d)), max(SHARES))


@query(f"WITH {NOISE_SQL} SELECT rel, src, dst, rank::INTEGER AS rank, k_true, src || ' ' || lower(replace(rel, '_', ' ')) || ' ' || dst || '.' AS passage FROM noise")
def r13_noise_facts(spark, d):
    """False edges of four kinds, as many for a source as it has true ones, with their passages."""
    said = F.concat("src", lit(" "), F.lower(F.replace(col("rel"), lit("_"), lit(" "))), lit(" "), "dst", lit("."))
    return _noise(spark, d).select("rel", "src", "dst", "rank", "k_true", said.alias("passage"))


# -- the graph's answers under noise ------------------------------------------------------------------------------
SWEPT = {k: C.ROUTES[k][1] for k in ("GENE_TO_DRUG", "GENE_TO_DISEASE", "GENE_TO_TRIALDRUG")}
_LEAF = {"GENE_TO_DRUG": "Drug", "GENE_TO_DISEASE": "Disease", "GENE_TO_TRIALDRUG": "Drug"}


def _true_ends(graph, genes: DataFrame, ways: dict[str, str]) -> DataFrame:
    """(rel, start, name, level): names that routes, by their last relationship, lead to over true edges."""
    chains = {rel: ("Gene", SWEPT[route]) for rel, route in ways.items()}
    number = G.numbered(graph, chains.values())
    kind = F.coalesce(*[F.when(col("tail") == number[chain], lit(rel)) for rel, chain in chains.items()])
    found = G.answers(graph, genes.select(col("node").alias("start")), chains.values()).withColumnRenamed("start", "node")
    return found.join(genes.select("node", "start"), "node").select(kind.alias("rel"), "start", "name", lit(0.0).alias("level"))


def _noisy_ends(graph, starts: DataFrame, ways: dict[str, str], names: DataFrame) -> DataFrame:
    """`_true_ends` of starts (rel, start, node) over true and false edges, with the least share at which there is a way."""
    heads = {rel: SWEPT[route][:-1] for rel, route in ways.items()}
    true = {r: graph.edges[r].table.select(col("src").cast("string").alias("src"), col("dst").cast("string").alias("dst"), lit(0.0).alias("level")) for r in {rel for head in heads.values() for rel, _ in head}}
    fronts = {rel: N.reached_by_share(starts.where(col("rel") == rel).select("start", F.substring_index("node", ":", -1).alias("node")), head, true) for rel, head in heads.items()}
    return N.named_by_share(fronts, _truth(graph, tuple(ways)), names, SHARES)


def _graph_sweep(spark, d) -> DataFrame:
    """(system, rho, qid, recall, noisy) of questions (gene, route)."""
    graph = evidence_graph(spark, d)
    # Only the last relationship of a route has false edges, and no two routes share it.
    ways = {steps[-1][0]: route for route, steps in SWEPT.items()}
    genes = stored(G.names_of(graph, ["Gene"]).withColumn("start", F.monotonically_increasing_id()))
    names = reduce(DataFrame.union, [G.names_of(graph, [_LEAF[route]]).select(lit(rel).alias("rel"), F.substring_index("node", ":", -1).alias("dst"), col("alias").alias("name")) for rel, route in ways.items()])
    ends = stored(_true_ends(graph, genes, ways))
    # What true edges reach is there at every share: only starts that lack some name by them can gain one by false edges.
    open_starts = stored(N.lacking(genes.select("start", "node"), ends, names))
    kinds = sorted(r["rel"] for r in open_starts.select("rel").distinct().collect())  # a row for each kind
    if kinds:
        ends = stored(ends.union(_noisy_ends(graph, open_starts, {rel: ways[rel] for rel in kinds}, names)).groupBy("rel", "start", "name").agg(F.min("level").alias("level")))
    out = []
    for rel, route in ways.items():
        text = F.format_string(C.FACTS["Gene", _LEAF[route], rel], "alias", "name")
        named = ends.where(col("rel") == rel).join(genes.select("start", "node", "alias"), "start")
        out.append(named.select(F.concat(lit(f"{route}/"), "node").alias("qid"), "name", "level", text.alias("text")))
    facts = stored(reduce(DataFrame.union, out))
    shown = facts.withColumn("rho", F.explode(F.array(*map(lit, SHARES)))).where("level <= rho")
    # At every share the facts of a question in the order of their texts, under the budget.
    ranked = shown.withColumn("rank", F.row_number().over(_order("rho", "qid")))
    context = stored(R.packed(ranked, BUDGET, stop_when_full=False, by=("rho", "qid")))
    gold = facts.where("level = 0").select("qid", "name").withColumn("rho", F.explode(F.array(*map(lit, SHARES))))
    recall = R.gold_recall(context, gold, by=("rho", "qid"))
    noisy = context.groupBy("rho", "qid").agg(F.avg((col("level") > 0).cast("int")).alias("noisy"))
    return recall.join(noisy, ["rho", "qid"], "left").select(lit("graph").alias("system"), "rho", "recall", "noisy")


def _order(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy("text")


def _graph_sql() -> str:
    rels = sorted({rel for steps in SWEPT.values() for rel, _ in steps})
    edge = {}
    for r in rels:
        false = f" UNION ALL SELECT src, dst, {LEVEL_SQL} FROM noise WHERE rel = '{r}' AND {LEVEL_SQL} IS NOT NULL" if r in KINDS else ""
        edge[r] = f"(SELECT src, dst, min(level) AS level FROM (SELECT src, dst, 0::DOUBLE AS level FROM {EDGE_SQL[r]}{false}) GROUP BY 1, 2)"
    out = []
    for route, steps in SWEPT.items():
        front = "(SELECT node AS start, split_part(node, ':', 2) AS at, 0::DOUBLE AS level FROM names WHERE label = 'Gene')"
        for rel, way in steps:
            near, far = ("src", "dst") if way == ">" else ("dst", "src")
            front = f"(SELECT f.start, e.{far} AS at, min(greatest(f.level, e.level)) AS level FROM {front} f JOIN {edge[rel]} e ON e.{near} = f.at GROUP BY 1, 2)"
        text = C.FACTS["Gene", _LEAF[route], steps[-1][0]].replace("%s", "@", 1)
        out.append(f"SELECT '{route}/' || f.start AS qid, n.alias AS name, min(f.level) AS level, replace(replace('{text}', '%s', n.alias), '@', g.alias) AS text FROM {front} f JOIN names n ON n.node = '{_LEAF[route]}:' || f.at JOIN names g ON g.node = f.start GROUP BY f.start, n.alias, g.alias")
    return f"""{NAMES_SQL}, {NOISE_SQL}, facts AS ({' UNION ALL '.join(out)}), shown AS (SELECT f.*, rho FROM facts f, (SELECT unnest({SHARES}::DOUBLE[]) AS rho) WHERE level <= rho),
 gcum AS (SELECT *, sum(len(string_split(text, ' '))) OVER (PARTITION BY rho, qid ORDER BY rank) AS upto FROM (SELECT *, row_number() OVER (PARTITION BY rho, qid ORDER BY text) AS rank FROM shown)),
 gctx AS (SELECT rho, qid, {FOLD.format("string_agg(text, ' ' ORDER BY rank)")} AS c, avg((level > 0)::INTEGER) AS noisy FROM gcum WHERE rank = 1 OR upto <= {BUDGET} GROUP BY 1, 2),
 gsys AS (SELECT 'graph' AS system, x.rho, x.qid, avg(contains(x.c, {FOLD.format('g.name')})::INTEGER) AS recall, any_value(x.noisy) AS noisy FROM gctx x JOIN facts g ON g.qid = x.qid AND g.level = 0 GROUP BY 1, 2, 3)"""


# -- passages under noise -----------------------------------------------------------------------------------------
TOP = 50


def _asked(spark, d) -> DataFrame:
    """Benchmark items with a vector each."""
    vectors = read(spark, d, "embeddings").select(col("vec_id").alias("qid"), col("embedding").alias("vector"))
    return read(spark, d, "benchmark").select(col("item_id").alias("qid"), "text").join(vectors, "qid")


def _passages(spark, d) -> DataFrame:
    """(pid, text, vector, level): documents with vectors, and four false passages made from each question."""
    vectors = read(spark, d, "embeddings").select(col("vec_id").alias("pid"), col("embedding").alias("vector"))
    base = read(spark, d, "documents").select(col("doc_id").alias("pid"), "text").join(vectors, "pid").withColumn("level", lit(0.0))
    k = F.explode(F.array(*map(lit, range(4)))).alias("k")
    made = _asked(spark, d).select("qid", "text", "vector", k)
    words = F.concat(F.array_join(F.slice(F.split("text", " "), lit(1), col("k") + 4), " "), lit(" false"))
    moved = F.transform("vector", lambda x: (x.cast("double") * (0.9 - 0.1 * col("k"))).cast("float"))
    return base.union(made.select((-(col("qid") * 10 + col("k") + 1)).alias("pid"), words.alias("text"), moved.alias("vector"), N.level_of(col("k"), lit(4), SHARES).alias("level")))


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


QUESTIONS_SQL = "(SELECT item_id AS qid, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)"
PASSAGES_SQL = f"""(SELECT doc_id AS pid, text, embedding, 0::DOUBLE AS level FROM documents JOIN embeddings ON vec_id = doc_id UNION ALL SELECT -(qid * 10 + k + 1), array_to_string(string_split(text, ' ')[1:4 + k], ' ') || ' false', list_transform(embedding, lambda x: (x::DOUBLE * (0.9::DOUBLE - 0.1::DOUBLE * k))::FLOAT), CASE {' '.join(f'WHEN k < round_even({s}::DOUBLE * 4, 0) THEN {s}::DOUBLE' for s in SHARES)} END FROM {QUESTIONS_SQL}, (SELECT unnest([0, 1, 2, 3]) AS k))"""


def _passage_sql(share: float) -> str:
    """(system, rho, qid, recall, noisy) at one share, with an index of its own."""
    scaled = lambda c: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END"
    rows = f"(SELECT * FROM {PASSAGES_SQL} WHERE level <= {share})"
    return f"""SELECT * FROM (WITH p AS {rows}, {bm25_sql('(SELECT pid, text FROM p)', f'(SELECT qid, text FROM {QUESTIONS_SQL})')}, den AS (SELECT a.qid, p.pid, {_dot('p.embedding', 'a.embedding')} AS s FROM p, {QUESTIONS_SQL} a),
 both_of AS (SELECT d.qid, d.pid, d.s, coalesce(x.score, 0) AS l FROM den d LEFT JOIN lex x USING (qid, pid)),
 scored AS (SELECT 'lexical' AS system, qid, pid, score FROM lex UNION ALL SELECT 'vector', qid, pid, s FROM den UNION ALL SELECT 'hybrid', qid, pid, 0.5 * {scaled('s')} + 0.5 * {scaled('l')} FROM both_of WINDOW w AS (PARTITION BY qid)),
 top AS (SELECT *, row_number() OVER (PARTITION BY system, qid ORDER BY round(score, 6) DESC, pid) AS rank FROM scored),
 cum AS (SELECT t.*, p.text, sum(len(list_filter(regexp_split_to_array(coalesce(p.text, ''), '\\s+'), lambda w: w <> ''))) OVER (PARTITION BY system, qid ORDER BY rank) AS upto FROM top t JOIN p ON p.pid = t.pid WHERE rank <= {TOP}),
 ctx AS (SELECT system, qid, {FOLD.format("string_agg(text, ' ' ORDER BY rank)")} AS c, avg((pid < 0)::INTEGER) AS noisy FROM cum WHERE rank = 1 OR upto <= {BUDGET} GROUP BY 1, 2)
 SELECT system, {share}::DOUBLE AS rho, qid::VARCHAR AS qid, avg(coalesce(contains(c, {FOLD.format('name')}), FALSE)::INTEGER) AS recall, any_value(noisy) AS noisy FROM ctx JOIN (SELECT qid, unnest(list_distinct(string_split(text, ' '))) AS name FROM {QUESTIONS_SQL}) USING (qid) GROUP BY 1, 3)"""


def _passage_sweep(spark, d) -> DataFrame:
    asked, passages = stored(_asked(spark, d)), stored(_passages(spark, d))
    top = topk.sweep_top(passages, asked, TOP, SHARES)
    by = ("system", "share", "qid")
    context = stored(R.packed(top.join(passages.select("pid", "text"), "pid"), BUDGET, stop_when_full=False, by=by))
    gold = asked.select("qid", F.explode(F.array_distinct(F.split("text", " "))).alias("name"))
    asked_of = context.select(*by).distinct()
    recall = R.gold_recall(context, asked_of.join(gold, "qid"), by=by)
    noisy = context.groupBy(*by).agg(F.avg((col("pid") < 0).cast("int")).alias("noisy"))
    return recall.join(noisy, list(by)).select("system", col("share").alias("rho"), "recall", "noisy")


@query(f"WITH {_graph_sql()} SELECT system, rho, round(avg(recall), 6) AS recall, round(avg(noisy), 6) AS contamination, count(*) AS n FROM (SELECT * FROM gsys UNION ALL {' UNION ALL '.join(_passage_sql(s) for s in SHARES)}) GROUP BY 1, 2")
def r14_noise_sweep(spark, d):
    """Four systems side by side at every share of false facts: gold recall of the packed context, and how much of it is false.

    One walk over the graph and one scoring of the passages serve all shares.
    """
    rows = _graph_sweep(spark, d).unionByName(_passage_sweep(spark, d))
    return rows.groupBy("system", "rho").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("noisy"), 6).alias("contamination"), F.count("*").alias("n"))
