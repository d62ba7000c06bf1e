"""Sources and sinks: delimited, JSON and XML readers, upserts, constraint checks and side outputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", encoding: str = "UTF-8", strict: bool = False) -> DataFrame:
    """A delimited file with a header under a given schema. Extra trailing fields are dropped and do not shift columns;
    rows that do not parse are kept with nulls, or left out if strict."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, encoding=encoding, mode="DROPMALFORMED" if strict else "PERMISSIVE", enforceSchema=True)


def all_text(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Every column read as text, to be converted where it can be."""
    return delimited(spark, path, ", ".join(f"`{c}` string" for c in columns), sep)


def converted(df: DataFrame, types: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """Columns converted to their types (null where a text does not parse); lists: column -> separator of a text list."""
    empty = F.array().cast("array<string>")
    out = {c: F.expr(f"try_cast(`{c}` as {t})") for c, t in types.items()}
    out |= {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", empty).otherwise(F.split(c, sep)) for c, sep in (lists or {}).items()}
    return df.withColumns(out)


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share; a local session may go without the setting, as
    they share its disk."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage at files in the shared folder, which outlive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As durable, but as a compressed table of columns: for intermediates that are large."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, of a few short columns, up to which a table is sent to all tasks.
SMALL = 100_000


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, which is stored, to be broadcast if it has at most so many rows; a larger one is joined by shuffling."""
    most = SMALL if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


PAGE = "pageToken string, nextPageToken string"


def landed_pages(spark: SparkSession, path: str, items: str, item_type: str) -> DataFrame:
    """Pages of a paged source as they were landed, one JSON object a line: (pageToken, nextPageToken, items).

    A page that was asked for again counts once. The first page has no token of its own, the last names no next one.
    """
    pages = spark.read.schema(f"{PAGE}, `{items}` array<{item_type}>").json(path)
    return pages.dropDuplicates(["pageToken"])


def page_items(pages: DataFrame, items: str) -> DataFrame:
    return pages.select(F.explode(items).alias("_item")).select("_item.*")


def missing_pages(pages: DataFrame) -> DataFrame:
    """(pageToken): pages that landed ones name as next, but that did not land; empty if a download is whole."""
    named = pages.where("nextPageToken is not null").select(F.col("nextPageToken").alias("pageToken"))
    return named.join(pages.select("pageToken"), "pageToken", "left_anti").distinct()


def store_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Wipe and reload: each table replaces whatever its folder held. None may be read from the folder that it replaces."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", encoding="UTF-8")


def kept(df: DataFrame, keys: Sequence[str], position: Column, latest: bool = False) -> DataFrame:
    """One row for each key: the first by position, or the last."""
    order = position.desc_nulls_last() if latest else position.asc_nulls_last()
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_nth = 1").drop("_nth")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], position: str, latest: bool = False) -> DataFrame:
    """Nodes merged by key: what is there stays (or, with latest, is overwritten), and of new rows the first (last) counts."""
    fresh = kept(new, keys, F.col(position), latest)
    if latest:
        return old.join(fresh, list(keys), "left_anti").unionByName(fresh.drop(position), allowMissingColumns=True)
    return old.unionByName(fresh.join(old, list(keys), "left_anti").drop(position), allowMissingColumns=True)


def linked(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose two ends exist, each pair once."""
    return edges.join(sources.select(F.col(sources.columns[0]).alias(src)), src, "left_semi").join(targets.select(F.col(targets.columns[0]).alias(dst)), dst, "left_semi").dropDuplicates([src, dst])


def unmatched(rows: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """The side output of a lookup: rows whose key is not known."""
    return rows.join(known, list(on), "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a uniqueness constraint, with their counts; empty if it holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
