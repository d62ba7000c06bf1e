"""A streaming ledger: events as they come, counted in windows, late ones up to a watermark; and hash chains that go on from
trigger to trigger and over restarts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.ledger import GENESIS, body_of


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def windowed(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) for each window, once it can get no more events."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "30 minutes") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def append_to(events: DataFrame, path: str, checkpoint: str):
    """Start writing events to a parquet ledger; a restart goes on where it stopped."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Chain(StatefulProcessor):
    """The last sequence number, order and hash of each run; events that are not later than the last one were recorded before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long, at long, event_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sequence, at, before = self.last.get() if self.last.exists() else (0, None, GENESIS)
        events = pd.concat(list(rows)).sort_values(["at", "body"], kind="stable")  # what one trigger brings of a run
        out = []
        for n, body in zip(events["at"].tolist(), events["body"].tolist(), strict=True):
            if at is not None and n <= at:
                continue
            now = hashlib.sha256((before if body is None else f"{body}|{before}").encode()).hexdigest()
            sequence += 1
            out.append((key[0], n, sequence, now, before))
            at, before = n, now
        if out:
            self.last.update((sequence, at, before))
        yield pd.DataFrame(out, columns=["run", "at", "sequence", "event_hash", "previous_hash"])

    def close(self) -> None:
        pass


def chained_stream(events: DataFrame, run: str, order: str, fields: list[str]) -> DataFrame:
    """(run, at, sequence, event_hash, previous_hash): each event appended to its run's chain, as the batch `chained` has it.

    order, a number, tells a run's events apart; an event that comes again is not recorded twice. Events of one trigger
    are put in order; one that comes in a later trigger than its successor cannot be appended any more and is left out.
    State: three values for each run, in the state store of the query's checkpoint.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.col(run).cast("string").alias("run"), F.col(order).cast("long").alias("at"), body_of(fields).alias("body"))
    kinds = T.StructType().add("run", "string").add("at", "long").add("sequence", "long").add("event_hash", "string").add("previous_hash", "string")
    return rows.groupBy("run").transformWithStateInPandas(Chain(), kinds, "Append", "None")
