"""Names in texts: a dictionary as a trie of tokens, matched from every place of a text by one join for each token.

The trie is a table (tokens so far, whether a name ends here). Places of a text whose token begins some name meet the
first level; places that go on meet the next one, so that a level is an equi-join on the tokens so far, and few places are
left after the first. A trie of few rows is sent to all tasks. Of a larger one a first token that makes up more than `HOT`
of all places is dealt over salts, with its one trie row repeated for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import entity_key
from lodestone.sources import tables
from lodestone.sources.tables import durable

#: Share of all places from which a first token is salted (so there are at most its inverse of them), and salts.
HOT, SALTS = 0.005, 32


def folded_words(text: Column) -> Column:
    """The normalised words of a text."""
    return F.filter(F.split(entity_key(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def exact_words(text: Column) -> Column:
    """Runs of letters and digits, as they are written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def name_trie(names: DataFrame, words: Callable[[Column], Column], longest: int) -> DataFrame:
    """(depth, key, ends) of names (alias, ...) of at most `longest` words; key: the words so far, joined by blanks."""
    cut = names.select(words(F.col("alias")).alias("w")).where((F.size("w") > 0) & (F.size("w") <= longest)).distinct()
    steps = cut.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("depth"))
    return steps.groupBy("depth", F.array_join(F.slice("w", F.lit(1), F.col("depth")), " ").alias("key")).agg(F.bool_or(F.size("w") == F.col("depth")).alias("ends"))


def names_in(texts: DataFrame, ids: list[str], names: DataFrame, longest: int = 5, words: Callable[[Column], Column] = exact_words, only_longest: bool = False) -> DataFrame:
    """(ids, at, n, key) of every name (alias, ...) that stands at the at-th word of a text (ids, text), n words long.

    only_longest: of the names that begin at one place the longest. Names and texts are compared by `words`.
    """
    trie = durable(name_trie(names, words, longest))
    few = trie.limit(tables.SMALL + 1).count() <= tables.SMALL

    def level(d: int) -> DataFrame:
        own = trie.where(F.col("depth") == d).select(F.col("key").alias("_key"), F.col("ends").alias("_ends"))
        return F.broadcast(own) if few else own

    cut = texts.select(*ids, words(F.col("text")).alias("_t"))
    size = F.size("_t")
    places = cut.where(size > 0).select(*ids, F.posexplode(F.transform(F.sequence(F.lit(1), size), lambda i: F.slice("_t", i, longest))).alias("at", "_w"))
    places = places.select(*ids, (F.col("at") + 1).alias("at"), "_w", F.get("_w", F.lit(0)).alias("_key"))
    begun = level(1)
    if few:
        now = durable(places.join(begun, "_key"))
    else:
        # One row for each token, summed where the texts are; those that are hot are at most 1 / HOT.
        counts = durable(cut.select(F.explode("_t").alias("_key")).groupBy("_key").count().join(begun.select("_key"), "_key", "left_semi"))
        total = counts.agg(F.sum("count")).first()[0] or 0
        hot = [r["_key"] for r in counts.where(F.col("count") > HOT * total).collect()]
        salts = F.when(F.col("_key").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        salt = F.when(F.col("_key").isin(hot), F.pmod(F.xxhash64("at", *ids), F.lit(SALTS)).cast("int")).otherwise(0)
        now = durable(places.withColumn("_salt", salt).join(begun.withColumn("_salt", F.explode(salts)), ["_key", "_salt"]).drop("_salt"))
    found = None
    for d in range(1, longest + 1):
        if d > 1:
            on = now.where(F.size("_w") >= d).drop("_key", "_ends").withColumn("_key", F.array_join(F.slice("_w", 1, d), " "))
            now = on.join(level(d), "_key")
        ended = now.where("_ends").select(*ids, "at", F.lit(d).alias("n"), F.col("_key").alias("key"))
        found = ended if found is None else found.union(ended)
    if not only_longest:
        return found
    return found.groupBy(*ids, "at").agg(F.max(F.struct("n", "key")).alias("_x")).select(*ids, "at", "_x.n", "_x.key")


def mentions(questions: DataFrame, names: DataFrame, longest: int = 3) -> DataFrame:
    """(qid, node, label, place): nodes whose alias (alias, node, label) stands in a question (qid, text), each once: longer
    names first, then by place and node."""
    hits = names_in(questions, ["qid"], names, longest, folded_words).where(F.length("key") > 2)
    known = names.select(F.array_join(folded_words(F.col("alias")), " ").alias("key"), "node", "label")
    first = hits.join(known, "key").groupBy("qid", "node", "label").agg(F.min(F.struct(-F.col("n"), F.col("at"))).alias("_o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("_o", "node"))).drop("_o")


def refined(questions: DataFrame, links: DataFrame, variants: DataFrame, triggers: tuple[str, ...], most: int = 3) -> DataFrame:
    """Links (qid, node, label, place) of questions that speak of variants, refined: the first gene, and of its variants
    (gene, gene_name, node, name) those whose names stand after it, the `most` longest; other links stay."""
    text = entity_key(F.col("text"))
    asked = questions.select("qid", text.alias("_q")).where(F.exists(F.array(*map(F.lit, triggers)), lambda w: F.contains("_q", w)))
    gene = links.where("label = 'Gene'").groupBy("qid").agg(F.min_by("node", "place").alias("gene")).join(asked, "qid")
    said = gene.join(variants, "gene").withColumn("_g", entity_key(F.col("gene_name"))).withColumn("_v", entity_key(F.col("name")))
    after = F.when(F.contains("_q", F.col("_g")), F.expr("substring(_q, instr(_q, _g) + length(_g))")).otherwise(F.col("_q"))
    said = said.where((F.col("_v") != "") & F.contains(after, F.col("_v")))
    order = Window.partitionBy("qid").orderBy(F.length("_v").desc(), F.col("node").desc())
    best = said.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("qid", "node", F.lit("Variant").alias("label"), (F.col("_k") + 1).alias("place"))
    own = gene.select("qid", F.col("gene").alias("node"), F.lit("Gene").alias("label"), F.lit(1).alias("place"))
    return links.join(gene.select("qid"), "qid", "left_anti").select("qid", "node", "label", "place").union(own).union(best)
