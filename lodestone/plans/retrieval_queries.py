"""Traversal, retrieval and ledgers over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import ledger as L
from lodestone.operators import retrieval as R
from lodestone.operators import traversal as V
from lodestone.plans.registry import query
from lodestone.sources.projection import read
from lodestone.sources.tables import stored

col, lit = F.col, F.lit


def _edges(spark, d):
    """region -R-> nation -N-> supplier, supplier -L-> part; ids carry their kind."""
    n, s, line = read(spark, d, "nation"), read(spark, d, "supplier"), read(spark, d, "lineitem")
    make = lambda df, a, ac, b, bc, rel, noise: df.select(F.concat(lit(a), ac).alias("src"), lit(rel).alias("rel"), F.concat(lit(b), bc).alias("dst"), noise.alias("noise")).distinct()
    out = make(n, "r", col("n_regionkey"), "n", col("n_nationkey"), "R", lit(False)).union(make(s, "n", col("s_nationkey"), "s", col("s_suppkey"), "N", col("s_acctbal") < 0))
    return out.union(make(line, "s", col("l_suppkey"), "p", col("l_partkey"), "L", lit(False)))


EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'R' AS rel, 'n' || n_nationkey AS dst, FALSE AS noise FROM nation UNION ALL SELECT 'n' || s_nationkey, 'N', 's' || s_suppkey, s_acctbal < 0 FROM supplier
 UNION ALL SELECT DISTINCT 's' || l_suppkey, 'L', 'p' || l_partkey, FALSE FROM lineitem)"""
STEPS = [("R", False), ("N", False), ("L", False), ("L", True)]


def _start(spark, d):
    return read(spark, d, "region").select(F.concat(lit("r"), "r_regionkey").alias("anchor")).withColumn("node", col("anchor"))


@query(f"WITH {EDGES} SELECT a.src AS anchor, d.src AS node, count(*) AS paths, count(*) FILTER (WHERE a.noise OR b.noise OR c.noise OR d.noise) AS noisy FROM edges a JOIN edges b ON b.src = a.dst AND b.rel = 'N' JOIN edges c ON c.src = b.dst AND c.rel = 'L' JOIN edges d ON d.dst = c.dst AND d.rel = 'L' WHERE a.rel = 'R' GROUP BY 1, 2")
def j19_follow(spark, d):
    return V.walks(_start(spark, d), _edges(spark, d), STEPS)


@query(f"WITH {EDGES} SELECT DISTINCT a.src AS anchor, c.dst AS node FROM edges a JOIN edges b ON b.src = a.dst AND b.rel = 'N' JOIN edges c ON c.src = b.dst AND c.rel = 'L' WHERE a.rel = 'R'")
def j20_reach(spark, d):
    return V.reach(_start(spark, d), _edges(spark, d), STEPS[:3])


#: Eight hops: over the nations and suppliers of a region to parts, to other suppliers of these, and once more from their nations.
SPINE = [*STEPS, ("N", True), ("N", False), ("L", False), ("L", True)]
CAP = 4000


def _simple_sql() -> str:
    levels = ["p0 AS (SELECT 'r' || r_regionkey AS anchor, 'r' || r_regionkey AS node, ['r' || r_regionkey] AS path, 1 AS nth FROM region)"]
    for i, (rel, back) in enumerate(SPINE):
        near, far = ("dst", "src") if back else ("src", "dst")
        on = f"SELECT anchor, {far} AS node, list_append(path, {far}) AS path, row_number() OVER (PARTITION BY anchor ORDER BY nth, {far}) AS nth FROM p{i} JOIN edges ON rel = '{rel}' AND {near} = node WHERE NOT list_contains(path, {far})"
        levels.append(f"p{i + 1} AS (SELECT * FROM ({on}) WHERE nth <= {CAP})")
    return f"WITH {EDGES}, {', '.join(levels)}"


@query(f"{_simple_sql()} SELECT anchor, array_to_string(path, '>') AS path FROM p{len(SPINE)}")
def j21_simple_paths(spark, d):
    """Paths of eight hops over all edges; as the entry has it, the first 4,000 of an anchor and level go on."""
    return V.simple_walks(_start(spark, d), _edges(spark, d), SPINE, CAP).select("anchor", F.array_join("path", ">").alias("path"))


@query(f"""WITH {EDGES}, sup AS (SELECT a.src AS r, a.dst AS n, b.dst AS s FROM edges a JOIN edges b ON b.src = a.dst AND b.rel = 'N' WHERE a.rel = 'R'), sp AS (SELECT src AS s, dst AS p FROM edges WHERE rel = 'L'), cnt AS (SELECT p, count(*) AS c FROM sp GROUP BY 1),
 fwd AS (SELECT DISTINCT a.r, a.n, a.s, x.p, y.s AS s2 FROM sup a JOIN sp x ON x.s = a.s JOIN sp y ON y.p = x.p AND y.s <> a.s), ends AS (SELECT DISTINCT f.s, f.s2, b.n AS n2 FROM fwd f JOIN sup b ON b.s = f.s2 WHERE f.n <> b.n),
 third AS (SELECT e.s, e.s2, z.p FROM ends e JOIN sup c ON c.n = e.n2 AND c.s <> e.s2 JOIN sp z ON z.s = c.s JOIN cnt ON cnt.p = z.p LEFT JOIN sp h1 ON h1.s = e.s AND h1.p = z.p LEFT JOIN sp h2 ON h2.s = e.s2 AND h2.p = z.p WHERE cnt.c - 1 - (h1.s IS NOT NULL)::INTEGER - (h2.s IS NOT NULL)::INTEGER >= 1),
 span AS (SELECT s, s2, min(p) AS low, max(p) AS high FROM third GROUP BY 1, 2),
 head AS (SELECT r, min([n, s, p, s2]) AS h FROM fwd f JOIN span g USING (s, s2) WHERE g.low <> f.p OR g.high <> f.p GROUP BY 1),
 tail AS (SELECT h.r, min([b.n, c.s, z.p, w.s]) AS t FROM head h JOIN sup b ON b.s = h.h[4] AND b.n <> h.h[1] JOIN sup c ON c.n = b.n AND c.s <> h.h[4] JOIN sp z ON z.s = c.s AND z.p <> h.h[3] JOIN sp w ON w.p = z.p AND w.s <> c.s AND w.s <> h.h[2] AND w.s <> h.h[4] GROUP BY 1)
 SELECT 'r' || r_regionkey AS anchor, array_to_string(list_concat([r], h, t), '>') AS path FROM region LEFT JOIN (SELECT * FROM head JOIN tail USING (r)) ON r = 'r' || r_regionkey""")
def j22_first_path(spark, d):
    """An anchor's first simple path of eight hops in the order of the nodes, null if it has none at all; nothing is capped."""
    return V.least_path(_start(spark, d), _edges(spark, d), SPINE).select("anchor", F.array_join("path", ">").alias("path"))


@query("SELECT DISTINCT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 9000)")
def j23_bridge(spark, d):
    line = read(spark, d, "lineitem")
    one = line.where("l_returnflag = 'A'").select(col("l_partkey").alias("p_partkey"))
    two = line.join(read(spark, d, "supplier").where("s_acctbal > 9000"), col("s_suppkey") == col("l_suppkey")).select(col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").join(one, "p_partkey", "left_semi").join(two, "p_partkey", "left_semi").select("p_name").distinct()


@query("SELECT a, hop, sum(n) OVER (PARTITION BY a ORDER BY hop)::BIGINT AS seen FROM (SELECT a, hop, count(*) AS n FROM (SELECT user_id % 20 AS a, event_type AS node, min(event_id % 7) AS hop FROM events GROUP BY 1, 2) GROUP BY 1, 2)")
def w12_witnesses(spark, d):
    visits = read(spark, d, "events").select((col("user_id") % 20).alias("a"), col("event_type").alias("node"), (col("event_id") % 7).alias("hop"))
    return V.witnesses(visits, "a", "hop", "node")


# -- retrieval ----------------------------------------------------------------------------------------------------
def bm25_sql(passages: str = "(SELECT doc_id AS pid, text FROM documents)", questions: str = "(SELECT item_id AS qid, text FROM benchmark)") -> str:
    return f"""tok AS (SELECT pid, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1) AS t FROM {passages}), size AS (SELECT count(*) AS n, avg(len(t)) AS m FROM tok),
 post AS (SELECT pid, l, token, count(*) AS tf FROM (SELECT pid, len(t) AS l, unnest(t) AS token FROM tok) GROUP BY 1, 2, 3), df AS (SELECT token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, size GROUP BY 1), fl AS (SELECT {R.EPSILON} * avg(idf) AS f FROM df),
 q AS (SELECT qid, token, count(*) AS times FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1)) AS token FROM {questions}) GROUP BY 1, 2),
 lex AS (SELECT qid, pid, sum(times * CASE WHEN idf < 0 THEN f ELSE idf END * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * l / m))) AS score FROM q JOIN df USING (token) JOIN post USING (token), size, fl GROUP BY 1, 2)"""


BM25 = bm25_sql()
TOP = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, pid) AS rank FROM {}"


def _passages(spark, d):
    return read(spark, d, "documents").select(col("doc_id").alias("pid"), "text")


def _questions(spark, d):
    return read(spark, d, "benchmark").select(col("item_id").alias("qid"), "text")


@query(f"WITH {BM25} SELECT qid, pid, rank::INTEGER AS rank, round(score, 4) AS score FROM ({TOP.format('lex')}) WHERE rank <= 10")
def r01_bm25(spark, d):
    return R.lexical_top(_passages(spark, d), _questions(spark, d), 10).select("qid", "pid", "rank", F.round("score", 4).alias("score"))


DENSE = "den AS (SELECT q.vec_id AS qid, p.vec_id AS pid, list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: p.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) AS score FROM embeddings p, embeddings q WHERE q.vec_id % 100 = 0)"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(col("vec_id").alias("pid"), col("embedding").alias("vector"))


@query(f"WITH {DENSE} SELECT qid, pid, rank::INTEGER AS rank, round(score, 5) AS score FROM ({TOP.format('den')}) WHERE rank <= 10")
def r02_dense(spark, d):
    v = _vectors(spark, d)
    return R.dense_top(v, v.where("pid % 100 = 0").withColumnRenamed("pid", "qid"), 10).select("qid", "pid", "rank", F.round("score", 5).alias("score"))


BOTH = "(SELECT vec_id AS pid, embedding, text FROM embeddings JOIN documents ON doc_id = vec_id)"
ASKED = f"(SELECT pid AS qid, embedding, text FROM {BOTH} WHERE pid % 100 = 0)"
HYBRID = f"""{bm25_sql(BOTH, ASKED)}, den AS (SELECT a.qid, p.pid, list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: p.embedding[i]::DOUBLE * a.embedding[i]::DOUBLE)) AS s FROM {BOTH} p, {ASKED} a),
 b AS (SELECT d.qid, d.pid, d.s, coalesce(x.score, 0) AS l FROM den d LEFT JOIN lex x USING (qid, pid)),
 hyb AS (SELECT qid, pid, 0.5 * CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0 END + 0.5 * CASE WHEN max(l) OVER w > min(l) OVER w THEN (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) ELSE 0 END AS score FROM b WINDOW w AS (PARTITION BY qid))"""


@query(f"WITH {HYBRID} SELECT qid, pid, rank::INTEGER AS rank, round(score::DOUBLE, 5) AS score FROM ({TOP.format('hyb')}) WHERE rank <= 10")
def r03_hybrid(spark, d):
    """Inner products of vectors and BM25 of the texts, each scaled, over the same passages."""
    both = stored(_vectors(spark, d).join(_passages(spark, d), "pid"))
    asked = both.where("pid % 100 = 0").withColumnRenamed("pid", "qid")
    return R.hybrid_top(both, asked, 10).select("qid", "pid", "rank", F.round("score", 5).alias("score"))


def pack_sql(bm25: str = BM25, passages: str = "(SELECT doc_id AS pid, text FROM documents)") -> str:
    return f"""{bm25}, top AS ({TOP.format('lex')}), ctx AS (SELECT t.qid, t.pid, t.rank, d.text, len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '\\s+'), lambda w: w <> '')) AS words FROM top t JOIN {passages} d ON d.pid = t.pid WHERE t.rank <= 10),
 cum AS (SELECT *, sum(words) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS upto FROM ctx)"""


PACK = pack_sql()
FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
BLOB = f"c AS (SELECT qid, {FOLD.format(chr(39).join(['string_agg(text, ', ' ', ' ORDER BY rank)']))} AS c FROM cum WHERE rank = 1 OR upto <= 900 GROUP BY 1)"
GOLD = "(SELECT item_id AS qid, unnest(list_distinct(string_split(text, ' '))) AS name FROM benchmark)"


def _context(spark, d, questions=None, passages=None):
    passages = _passages(spark, d) if passages is None else passages
    top = R.lexical_top(passages, _questions(spark, d) if questions is None else questions, 10)
    return top.join(passages, "pid")


def _gold(spark, d):
    return _questions(spark, d).select("qid", F.explode(F.array_distinct(F.split("text", " "))).alias("name"))


@query(f"WITH {PACK} SELECT qid, pid, rank::INTEGER AS rank, upto FROM cum WHERE rank = 1 OR (upto <= 900 AND upto - words < 900)")
def w02_packed(spark, d):
    return R.packed(_context(spark, d), 900).select("qid", "pid", "rank", "upto")


@query(f"WITH {PACK}, g AS (SELECT unnest([100, 300, 900, 2400]) AS budget) SELECT budget::INTEGER AS budget, count(*) AS taken, round(avg(upto - words), 6) AS mean_before FROM cum, g WHERE rank = 1 OR (upto <= budget AND upto - words < budget) GROUP BY 1")
def r15_budget_sweep(spark, d):
    grid = F.explode(F.array(*map(lit, (100, 300, 900, 2400))))  # a fixed grid of budgets
    taken = R.packed(_context(spark, d).withColumn("budget", grid), col("budget"), by=("qid", "budget"))
    return taken.groupBy("budget").agg(F.count("*").alias("taken"), F.round(F.avg(col("upto") - col("words")), 6).alias("mean_before"))


RECALL = f"SELECT g.qid, avg(coalesce(contains(c.c, {FOLD.format('g.name')}), FALSE)::INTEGER) AS recall FROM {{gold}} g LEFT JOIN c ON c.qid = g.qid GROUP BY 1"


@query(f"WITH {PACK}, {BLOB} {RECALL.format(gold=GOLD)}")
def r08_gold_recall(spark, d):
    return R.gold_recall(R.packed(_context(spark, d), 900, stop_when_full=False), _gold(spark, d))


@query("SELECT qid, CASE WHEN np > 0 THEN hit / np ELSE 0 END AS precision, CASE WHEN ng > 0 THEN hit / ng ELSE 0 END AS recall, CASE WHEN hit > 0 THEN 2.0 * hit / (np + ng) ELSE 0 END::DOUBLE AS f1 FROM (SELECT coalesce(p.qid, g.qid) AS qid, count(p.name) AS np, count(g.name) AS ng, count(*) FILTER (WHERE p.name IS NOT NULL AND g.name IS NOT NULL) AS hit FROM (SELECT DISTINCT l_suppkey AS qid, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A') p FULL JOIN (SELECT DISTINCT l_suppkey AS qid, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R') g ON p.qid = g.qid AND p.name = g.name GROUP BY 1)")
def r11_set_scores(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), col("p_partkey") == col("l_partkey")).select(col("l_suppkey").alias("qid"), col("p_name").alias("name"), "l_returnflag")
    return R.set_scores(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"))


@query("""SELECT s, min(cut) AS x FROM (SELECT s, x, first_value(CASE WHEN py IS NULL OR y = py THEN x ELSE px + (0.5 - py) * (x - px) / (y - py) END) OVER (PARTITION BY s ORDER BY x) AS cut FROM (SELECT *, lag(x) OVER (PARTITION BY s ORDER BY x) AS px, lag(y) OVER (PARTITION BY s ORDER BY x) AS py FROM (SELECT p_brand AS s, p_size::DOUBLE AS x, avg((p_type = 'SMALL' OR p_partkey % 2 = 0)::INTEGER) AS y FROM part GROUP BY 1, 2)) WHERE y >= 0.5) GROUP BY 1""")
def w06_crossing(spark, d):
    hit = ((col("p_type") == "SMALL") | (col("p_partkey") % 2 == 0)).cast("int")
    points = read(spark, d, "part").groupBy(col("p_brand").alias("s"), col("p_size").cast("double").alias("x")).agg(F.avg(hit).alias("y"))
    return R.crossing(points, "s", "x", "y", 0.5)


@query("SELECT edge_id, src, rho FROM (SELECT p_partkey AS edge_id, p_brand AS src, rho, row_number() OVER (PARTITION BY p_brand, rho ORDER BY sha256(p_partkey::VARCHAR), p_partkey) AS k, round_even(rho * (p_size % 1 + 20), 0) AS most FROM part, (SELECT unnest([0.0::DOUBLE, 0.25, 1.0]) AS rho)) WHERE k <= most")
def w07_active_noise(spark, d):
    noise = read(spark, d, "part").select(col("p_partkey").alias("edge_id"), col("p_brand").alias("src"), lit(20).alias("k_true"), F.explode(F.array(*map(lit, (0.0, 0.25, 1.0)))).alias("rho"))
    return R.active_noise(noise, ["src", "rho"], col("rho")).select("edge_id", "src", "rho")


# -- experiments --------------------------------------------------------------------------------------------------
PARAPHRASES = "(SELECT item_id AS qid, text FROM benchmark UNION ALL SELECT item_id + 1000000, array_to_string(list_reverse(string_split(text, ' ')[1:6]), ' ') FROM benchmark)"
GOLD_TWICE = f"(SELECT qid, name FROM {GOLD} UNION ALL SELECT qid + 1000000, name FROM {GOLD})"


@query(f"WITH {pack_sql(bm25_sql(questions=PARAPHRASES))}, {BLOB} SELECT CASE WHEN qid < 1000000 THEN 'original' ELSE 'paraphrase' END AS condition, round(avg(recall), 6) AS recall, count(*) AS n FROM ({RECALL.format(gold=GOLD_TWICE)}) GROUP BY 1")
def r18_paraphrases(spark, d):
    """Gold recall of retrieved, packed contexts for two wordings of the questions, told apart by a condition column."""
    own = _questions(spark, d)
    other = own.select((col("qid") + 1_000_000).alias("qid"), F.array_join(F.reverse(F.slice(F.split("text", " "), 1, 6)), " ").alias("text"))
    gold = _gold(spark, d)
    twice = gold.union(gold.select(col("qid") + 1_000_000, "name"))
    recall = R.gold_recall(R.packed(_context(spark, d, own.union(other)), 900, stop_when_full=False), twice)
    condition = F.when(col("qid") < 1_000_000, "original").otherwise("paraphrase")
    return recall.groupBy(condition.alias("condition")).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n"))


TRAPS = "(SELECT item_id AS qid, text FROM benchmark UNION ALL SELECT item_id + 1000000, 'zqxv' || item_id || ' wvzq' FROM benchmark)"


@query(f"WITH {pack_sql(bm25_sql(questions=TRAPS))} SELECT t.qid, CASE WHEN c.qid IS NULL THEN 'not in the knowledge base' ELSE c.answer END AS answer, c.qid IS NULL AS abstained FROM {TRAPS} t LEFT JOIN (SELECT qid, 'passage ' || arg_min(pid, rank) AS answer FROM cum GROUP BY 1) c ON c.qid = t.qid")
def r17_abstention(spark, d):
    """Questions of which nothing is found get the fixed refusal; refusals are told by their words."""
    own = _questions(spark, d)
    asked = own.union(own.select(col("qid") + 1_000_000, F.concat(lit("zqxv"), col("qid").cast("string"), lit(" wvzq"))))
    found = _context(spark, d, asked).groupBy("qid").agg(F.min_by("pid", "rank").alias("pid"))
    rows = asked.select("qid").join(found, "qid", "left")
    answer = R.abstaining(col("pid").cast("string"), F.concat(lit("passage "), col("pid").cast("string")))
    return rows.select("qid", answer.alias("answer")).withColumn("abstained", F.lower("answer").rlike(r"not (in|found|available)|no (evidence|information)"))


VERBS = (" has nation ", " with supplier ", " that delivers ", " as does ", " of nation ", " with supplier ", " that delivers ", " as does ")
DEPTHS = range(1, len(SPINE) + 1)
DEEP_WORDS = 900


def _deep_sql() -> str:
    texts = []
    for k in DEPTHS:
        parts = "".join(f" || '{VERBS[i]}' || path[{i + 2}]" for i in range(k))
        texts.append(f"SELECT anchor AS qid, {k} AS depth, path, nth, 'The region ' || path[1]{parts} || '.' AS text FROM p{k}")
    return f"""{_simple_sql()}, said AS ({' UNION ALL '.join(texts)}), once AS (SELECT qid, depth, text, min(nth) AS nth FROM said GROUP BY 1, 2, 3),
 cum AS (SELECT *, sum(words) OVER (PARTITION BY qid, depth ORDER BY rank)::BIGINT AS upto FROM (SELECT qid, depth, text, len(string_split(text, ' ')) AS words, row_number() OVER (PARTITION BY qid, depth ORDER BY nth)::INTEGER AS rank FROM once))"""


def _deep(spark, d):
    """(qid, depth, path, nth, text): one walk, of which every level is read."""
    out = None
    for k, level in enumerate(V.walk_levels(_start(spark, d), _edges(spark, d), SPINE, CAP), 1):
        parts = [x for i in range(k) for x in (lit(VERBS[i]), col("path")[i + 1])]
        one = level.select(col("anchor").alias("qid"), lit(k).alias("depth"), "path", col("_nth").alias("nth"), F.concat(lit("The region "), col("path")[0], *parts, lit(".")).alias("text"))
        out = one if out is None else out.union(one)
    return out


@query(f"{_deep_sql()} SELECT qid, depth, rank, text, upto FROM cum WHERE rank = 1 OR upto <= {DEEP_WORDS}")
def r06_deep_context(spark, d):
    """Paths of one to eight hops in order, as sentences, each once, packed under a word budget for each depth."""
    return R.deep_context(_deep(spark, d), DEEP_WORDS).select("qid", "depth", "rank", "text", "upto")


@query(f"""{_deep_sql()}, c AS (SELECT qid, depth, {FOLD.format("string_agg(text, ' ' ORDER BY rank)")} AS c FROM cum WHERE rank = 1 OR upto <= {DEEP_WORDS} GROUP BY 1, 2),
 gold AS (SELECT qid, path FROM said QUALIFY row_number() OVER (PARTITION BY qid ORDER BY depth DESC, sha256(array_to_string(path, '>'))) = 1), asked AS (SELECT qid, path, unnest(range(1, len(path))) AS depth FROM gold),
 scored AS (SELECT a.depth, contains(c.c, {FOLD.format('a.path[a.depth + 1]')})::INTEGER AS terminal, list_avg(list_transform(a.path[2:a.depth], lambda b: contains(c.c, {FOLD.format('b')})::INTEGER)) AS chain FROM asked a JOIN c ON c.qid = a.qid AND c.depth = a.depth)
 SELECT depth::INTEGER AS depth, round(avg(terminal), 6) AS terminal, round(avg(chain), 6) AS chain, count(*) AS n FROM scored GROUP BY 1""")
def r09_chain_recall(spark, d):
    """For each depth: whether the last entity of an anchor's gold path stands in its packed context, and the share of the
    entities on the way that do. The gold path is one of the deepest, drawn by hash."""
    deep = _deep(spark, d)
    order = Window.partitionBy("qid").orderBy(F.desc("depth"), F.sha2(F.array_join("path", ">"), 256))
    gold = deep.select("qid", "path", "depth").withColumn("_k", F.row_number().over(order)).where("_k = 1")
    asked = gold.select("qid", "path", F.explode(F.sequence(lit(1), F.size("path") - 1)).alias("depth"))
    terminal = asked.select("qid", "depth", F.get("path", col("depth")).alias("name"))
    bridges = asked.where("depth > 1").select("qid", "depth", F.explode(F.slice("path", lit(2), col("depth") - 1)).alias("name"))
    found = R.chain_recall(R.deep_context(deep, DEEP_WORDS), terminal, bridges, by=("qid", "depth"))
    return found.groupBy("depth").agg(F.round(F.avg("terminal"), 6).alias("terminal"), F.round(F.avg("chain"), 6).alias("chain"), F.count("*").alias("n"))


# -- ledgers ------------------------------------------------------------------------------------------------------
FIELDS = ["conv_id", "turn", "role", "text"]


CHAIN = "sha256(concat_ws('|', o.conv_id, o.turn, o.role, o.text, {}))"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), c AS (SELECT conv_id, turn, k, {CHAIN.format("'GENESIS'")} AS event_hash, 'GENESIS' AS previous_hash FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.k, {CHAIN.format('c.event_hash')}, c.event_hash FROM c JOIN o ON o.conv_id = c.conv_id AND o.k = c.k + 1) SELECT conv_id, turn, event_hash, previous_hash FROM c""")
def w08_chained(spark, d):
    """Hashes depend on the ones before them."""
    return L.chained(read(spark, d, "conversations"), "conv_id", "turn", FIELDS)


@query("SELECT conv_id, count(*) AS n, NOT bool_or(conv_id % 3 = 0 AND turn % 4 = 1) AS valid FROM conversations GROUP BY 1")
def w09_verified(spark, d):
    """Chains of which some are tampered with after they were written: those must not hold."""
    turns = read(spark, d, "conversations").join(w08_chained(spark, d), ["conv_id", "turn"])
    altered = F.when((col("conv_id") % 3 == 0) & (col("turn") % 4 == 1), F.concat(F.coalesce("text", lit("")), lit("!"))).otherwise(col("text"))
    return L.verified(turns.withColumn("text", altered), "conv_id", "turn", FIELDS)


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS sequence FROM events")
def w08_sequenced(spark, d):
    return L.sequenced(read(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "sequence")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s01_windowed_batch(spark, d):
    from lodestone.streaming.ledger import windowed

    return windowed(read(spark, d, "events")).withColumn("total", F.round("total", 4))
