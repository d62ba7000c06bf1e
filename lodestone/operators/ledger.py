"""Append-only run ledgers: sequence numbers, hash chains, their checks, and the public view."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"


def event_hash(fields: list[str], previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", *fields, previous), 256)


def body_of(fields: list[str]) -> Column:
    """What is hashed of an event beside the hash before it; null if all its fields are."""
    return F.when(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull(), F.concat_ws("|", *fields))


def sequenced(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def chained(events: DataFrame, run: str, order: str, fields: list[str]) -> DataFrame:
    """(run, order, event_hash, previous_hash): a run's events folded in order, each hash over its fields and the one before.

    A hash needs the one before it, so a run is read in order by one task; only the last hash is carried from row to row.
    """
    rows = events.select(run, F.col(order).cast("long").alias(order), body_of(fields).alias("body"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, GENESIS
        for b in batches:
            hashes, before = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (key,) != now:
                    now, last = (key,), GENESIS
                before.append(last)
                last = hashlib.sha256((last if text is None else f"{text}|{last}").encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.string()), pa.array(before, pa.string())], [run, order, "event_hash", "previous_hash"])

    kind = rows.schema[run].dataType.simpleString()
    return rows.repartition(run).sortWithinPartitions(run, order, "body").mapInArrow(fold, f"`{run}` {kind}, `{order}` long, event_hash string, previous_hash string")


def verified(events: DataFrame, run: str, order: str, fields: list[str]) -> DataFrame:
    """(run, n, valid): every previous hash is the hash before it, the first is GENESIS, every hash is that of its fields."""
    before = F.lag("event_hash", 1, GENESIS).over(Window.partitionBy(run).orderBy(order))
    checked = events.withColumn("_fine", (F.col("previous_hash") == before) & (F.col("event_hash") == event_hash(fields, F.col("previous_hash"))))
    return checked.groupBy(run).agg(F.count("*").alias("n"), F.bool_and("_fine").alias("valid"))


def public_view(events: DataFrame, run: str, payload: str) -> DataFrame:
    """Events of runs whose id is a UUID, without their payload."""
    return events.where(F.col(run).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).drop(payload)
