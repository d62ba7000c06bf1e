"""Around retrieval (`topk`): scaled scores, word-budget packing, recall and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rules import scores
from lodestone.functions.text import entity_key, tokens, word_count
from lodestone.operators.topk import B, EPSILON, K1, best, dense_top, hybrid_top, lexical_top  # noqa: F401

def scaled(scored: DataFrame, column: str = "score") -> DataFrame:
    """The column scaled to 0..1 within each question; 0 where all are equal. Bounds are summed up, a row for each question."""
    bounds = scored.groupBy("qid").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    at = F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return scored.join(bounds, "qid").withColumn(column, at).select(*scored.columns)


def packed(ranked: DataFrame, budget: Column | int, words: Column | None = None, stop_when_full: bool = True, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Ranked texts taken in order until the word budget is met; the first is always taken."""
    order = Window.partitionBy(*by).orderBy("rank")
    limit = F.lit(budget) if isinstance(budget, int) else budget
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = ranked.withColumn("words", word_count(F.col("text")) if words is None else words).withColumn("upto", upto)
    fits = F.col("upto") <= limit
    if stop_when_full:
        fits = fits & (F.col("upto") - F.col("words") < limit)
    return rows.where((F.col("rank") == 1) | fits)


def gold_recall(context: DataFrame, gold: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(by, recall): share of gold names (a row each) that stand in the joined, normalised context; names meet their context as one array."""
    blob = context.groupBy(*by).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])).alias("_c"))
    names = gold.groupBy(*by).agg(F.collect_list(entity_key(F.col("name"))).alias("_names"), F.count("*").alias("_n"))
    found = F.size(F.filter("_names", lambda x: F.contains(F.col("_c"), x)))
    return names.join(blob.select(*by, entity_key(F.col("_c")).alias("_c")), list(by), "left").select(*by, (F.when(F.col("_c").isNull(), 0).otherwise(found) / F.col("_n")).alias("recall"))


def deep_context(paths: DataFrame, budget: int) -> DataFrame:
    """(qid, depth, rank, text, words, upto) of paths (qid, depth, path, nth, text): each sentence once, by its first path, under
    a word budget for each depth."""
    once = paths.groupBy("qid", "depth", "text").agg(F.min("nth").alias("nth"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "depth").orderBy("nth")))
    return packed(ranked.drop("nth"), budget, stop_when_full=False, by=("qid", "depth"))


def chain_recall(context: DataFrame, terminal: DataFrame, bridges: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(by, terminal, chain): whether the last entity stands in the context, and the share of bridges that do (null: none)."""
    found = gold_recall(context, terminal, by).withColumnRenamed("recall", "terminal")
    return found.join(gold_recall(context, bridges, by).withColumnRenamed("recall", "chain"), list(by), "left")


def set_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, precision, recall, f1) of predicted (qid, name) against gold (qid, name), as sets of normalised names."""
    p = predicted.select("qid", entity_key(F.col("name")).alias("name")).distinct().withColumn("_p", F.lit(1))
    g = gold.select("qid", entity_key(F.col("name")).alias("name")).distinct().withColumn("_g", F.lit(1))
    n = p.join(g, ["qid", "name"], "full").groupBy("qid").agg(F.count("_p").alias("np"), F.count("_g").alias("ng"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("hit"))
    precision, recall, f1 = scores(F.col("hit"), F.col("np"), F.col("ng"))
    return n.select("qid", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def crossing(points: DataFrame, system: str, x: str, y: str, threshold: float) -> DataFrame:
    """(system, x): where y first reaches the threshold, between measured points on a straight line."""
    order = Window.partitionBy(system).orderBy(x)
    steps = points.withColumn("_px", F.lag(x).over(order)).withColumn("_py", F.lag(y).over(order)).where(F.col(y) >= threshold)
    at = F.when(F.col("_py").isNull() | (F.col(y) == F.col("_py")), F.col(x)).otherwise(F.col("_px") + (threshold - F.col("_py")) * (F.col(x) - F.col("_px")) / (F.col(y) - F.col("_py")))
    return steps.groupBy(system).agg(F.min_by(at, F.col(x)).alias(x))


def active_noise(noise: DataFrame, group: list[str], share: Column, key: str = "edge_id") -> DataFrame:
    """Noise edges that are active at a share of the true ones: the first bround(share * k_true) of each group in hash order."""
    order = Window.partitionBy(*group).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return noise.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= F.bround(share * F.col("k_true"))).drop("_nth")


def abstaining(context: Column, answer: Column, refusal: str = "not in the knowledge base") -> Column:
    """The fixed refusal where the context is empty."""
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", refusal).otherwise(answer)


