"""Lookup joins: last entry wins, two key columns, cascades of matches, get-or-create."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import drug_key, tokens
from lodestone.sources.tables import kept


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """rows with the value of their key; of repeated keys in the table the last counts."""
    return rows.join(kept(table, [key], F.col(position), latest=True).select(key, value), key, "left")


def name_index(drugs: DataFrame, key: str, names: list[str], position: str) -> DataFrame:
    """(name_key, key): normalised names of several columns; a later row and a later column overwrite."""
    columns = [F.struct(F.lit(n).alias("rank"), drug_key(F.col(c)).alias("name_key")) for n, c in enumerate(names)]
    long = drugs.select(key, F.col(position).alias("_row"), F.explode(F.array(*columns)).alias("x")).select(key, "_row", "x.*").where("name_key <> ''")
    return long.groupBy("name_key").agg(F.max_by(key, F.struct("_row", "rank")).alias(key))


def cascade(rows: DataFrame, name: str, index: DataFrame, key: str) -> DataFrame:
    """The key of a name: exactly in upper case, else by normalised name, else by its first token that is a name."""
    upper = index.select(F.col("name_key").alias("_u"), F.col(key).alias("_by_upper"))
    folded = index.select(F.col("name_key").alias("_n"), F.col(key).alias("_by_name"))
    out = rows.join(upper, F.upper(F.trim(name)) == F.col("_u"), "left").join(folded, drug_key(F.col(name)) == F.col("_n"), "left")
    words = rows.select(name).distinct().select(name, F.posexplode(tokens(F.col(name))).alias("_pos", "_word"))
    hits = words.join(index, F.upper("_word") == F.col("name_key")).groupBy(name).agg(F.min_by(key, "_pos").alias("_by_word"))
    return out.join(hits, name, "left").withColumn(key, F.coalesce("_by_upper", "_by_name", "_by_word")).select(*rows.columns, key)


def get_or_create(rows: DataFrame, known: DataFrame, key: str, ident: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ident, new known rows): unknown keys get prefix + key, the same for every row that has the key."""
    out = rows.join(known.select(key, ident), key, "left").withColumn("_new", F.col(ident).isNull()).withColumn(ident, F.coalesce(ident, F.concat(F.lit(prefix), F.col(key))))
    return out.drop("_new"), out.where("_new").select(key, ident).distinct()


def overwritten(rows: DataFrame, news: DataFrame, key: str, columns: list[str], position: str) -> DataFrame:
    """rows with the last news of their key written over the named columns where there is any."""
    last = kept(news, [key], F.col(position), latest=True).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(last, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def normalised_arms(arms: DataFrame, known: DataFrame, ident: str) -> DataFrame:
    """(ident, arm, arm_name, interventions) of raw arms (ident, arm, arm_name, interventions array<string>).

    Interventions are trimmed and in lower case, only those of the vocabulary (name) stay, each once and in order. An
    arm without a name or without a list goes; one of which nothing is known stays, empty.
    """
    named = arms.where((F.trim("arm_name") != "") & F.col("interventions").isNotNull()).select(ident, "arm", F.trim("arm_name").alias("arm_name"), "interventions")
    said = named.select(ident, "arm", F.explode(F.array_distinct(F.transform("interventions", lambda x: F.lower(F.trim(x))))).alias("name"))
    kept = said.join(known.select(F.lower(F.trim("name")).alias("name")).distinct(), "name", "left_semi").groupBy(ident, "arm").agg(F.array_sort(F.collect_list("name")).alias("_kept"))
    return named.join(kept, [ident, "arm"], "left").select(ident, "arm", "arm_name", F.coalesce("_kept", F.array().cast("array<string>")).alias("interventions"))
