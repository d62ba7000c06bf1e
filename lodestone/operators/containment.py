"""Which texts hold which others, without comparing all pairs.

A text that holds another holds all of its q-grams. Every needle therefore names only its rarest one, and meets the texts
that have it; what meets is verified. Shorter needles name themselves. So a common gram is joined on only if a needle
has no rarer one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import durable, if_small

Q = 3


def _grams(text: Column, q: Column | int) -> Column:
    """The different runs of q characters; none of a shorter text."""
    n = F.lit(q) if isinstance(q, int) else q
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): each needle (needle) that is not empty with the texts (text) that hold it; both as distinct values."""
    small = durable(needles.where("needle <> ''").select("needle").distinct())
    large = texts.where("text is not null").select("text").distinct()
    grams = large.select("text", F.explode(F.flatten(F.array(*[_grams(F.col("text"), q) for q in range(1, Q + 1)]))).alias("gram"))
    named = small.select("needle", F.explode(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(Q)))).alias("gram"))
    wanted = if_small(durable(named.select("gram").distinct()))
    counted = grams.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text has rules its needle out.
    met = named.join(counted, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_x"))
    rarest = if_small(durable(met.where("_x.n > 0").select("needle", "_x.gram")))
    return rarest.join(grams, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")


def fitting(left: DataFrame, right: DataFrame, synonyms: Mapping[str, Sequence[str]], generic: str = "solid tumor") -> DataFrame:
    """(x, y): labels (x) that fit labels (y), compared trimmed and in lower case.

    One holds the other; or a synonym of x's own label and y hold one another; or x holds a label one of whose synonyms y
    holds; or either is the generic label. Empty and null labels fit none.
    """
    spark = left.sparkSession
    clean = lambda df, c: df.select(F.lower(F.trim(c)).alias(c)).where(f"{c} <> ''").distinct()
    xs, ys = durable(clean(left, "x")), durable(clean(right, "y"))
    as_text = ys.withColumnRenamed("y", "text")
    said = spark.createDataFrame([(k, w) for k, words in synonyms.items() for w in words], "label string, word string")
    one = contained(xs.withColumnRenamed("x", "needle"), as_text).toDF("x", "y")
    two = contained(ys.withColumnRenamed("y", "needle"), xs.withColumnRenamed("x", "text")).select(F.col("text").alias("x"), F.col("needle").alias("y"))
    own = xs.join(said, F.col("x") == F.col("label")).select("x", "word")
    held = contained(said.select(F.col("label").alias("needle")), xs.withColumnRenamed("x", "text")).select(F.col("text").alias("x"), F.col("needle").alias("label")).join(said, "label").select("x", "word")
    holds_word = contained(said.select(F.col("word").alias("needle")), as_text).toDF("word", "y")
    in_word = contained(ys.withColumnRenamed("y", "needle"), said.select(F.col("word").alias("text"))).select(F.col("text").alias("word"), F.col("needle").alias("y"))
    by_word = own.union(held).distinct().join(holds_word, "word").select("x", "y").union(own.join(in_word, "word").select("x", "y"))
    # The generic label is one row on either side.
    any_y = xs.where(F.col("x") == generic).join(ys)
    any_x = xs.join(ys.where(F.col("y") == generic))
    return one.union(two).union(by_word).union(any_y).union(any_x).distinct()
