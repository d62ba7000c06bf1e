"""What the training-data operators share: table reading, durable intermediates, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Least number of files of a small intermediate, and rows for which it gets one more.
LEAST_FILES, FILE_ROWS = 8, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of the context: the cluster's `spark.checkpoint.dir`, or one set here where it is unset.

    Only a local session, where driver and workers share a disk, may go without the setting.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage at files in the shared checkpoint folder, which outlive a lost executor."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As durable, but as a compressed table of columns: for wide intermediates of which later steps read a part."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    for block in _RELEASED:
        block.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables written by `stored` inside each open `released` block.
_RELEASED: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes inside are deleted at the end: for steps whose result is written down by then."""
    written: list[str] = []
    _RELEASED.append(written)
    try:
        yield
    finally:
        _RELEASED.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in written:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many narrow rows, in as many partitions as these need: each partition becomes a file."""
    return df.coalesce(LEAST_FILES + rows // FILE_ROWS)


def commonest(counted: DataFrame, most: int, n_col: str = "n") -> DataFrame:
    """Rows whose counts are so great that at most `most` rows are; equal counts stay or go together.

    A histogram of eighths of powers of two (a few hundred rows at most) finds the least count to keep.
    """
    step = F.floor(F.log2(F.col(n_col)) * 8)
    kept, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        kept += r["count"]
        if kept > most:
            break
        least = r["step"]
    return counted.where(step >= least) if least is not None else counted.limit(0)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among a few nodes, as (node, smallest node of its component), each node but the smallest once."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each stretch of links; it links the same nodes with fewer rows."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = forest(t["a"].to_numpy(), t["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= 500_000:
            yield flush()
            held = []
    if held:
        yield flush()


def components(links: DataFrame, nodes: int | None = None) -> DataFrame:
    """Connected components of links (a long, b long) as (node, component), component the smallest node reached.

    Alternating large-star and small-star steps: every step is one partial aggregation and one equi-join,
    so that a node with very many neighbours is pre-aggregated and its join side can be split.
    Only nodes that have a link to another node are returned. Steps shrink as they go on, and are written to as many
    files as their rows need; nodes, if known, is how many there are at most.
    """
    first = links.where("a <> b").mapInArrow(_forests, "a long, b long").distinct()
    stars = durable(first if nodes is None else few(first, nodes))
    held = seen = None
    while True:
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        step = small.where("a <> b").distinct()
        stars = durable(step if held is None else few(step, held))
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, held = mark, mark[0]
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
