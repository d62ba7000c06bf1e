"""Sharding: contiguous shards of near equal bytes, from prefix sums over per-partition totals.

The rows are put in one global order (digest of the text, then doc_id), so that equal texts lie side by side. One rule holds for every row and every group of equal texts, whatever its size: the
shard is the one that the middle of the row's bytes falls into, so that a group is parted only where an equal cut falls.
Each range partition sums its own bytes; the driver adds up one total per partition; a row's shard follows from the
bytes before it. No row meets the driver and no task sees more than one range partition.

Null text: no bytes and crc32 0, ordered as the empty text. Null doc_id: an ordinary row, first in its group.
Very long texts: a row is never parted, so a shard is off its equal share by one text at most. Repeated rows: each gets
its own place. Fewer rows than shards: some shards are empty. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable

ROW_OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): slot counts from 0 within a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The row number spreads equal texts without ids over partitions, too.
    ranged = durable(rows.repartitionByRange("digest", id_col, "row").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()
    before, total, count = [], 0, 0
    for p in parts:  # one entry for each partition, however many rows there are
        before.append((p["part"], total, count))
        total, count = total + p["bytes"], count + p["n"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, bytes_before long, rows_before long"))
    order = Window.partitionBy("part").orderBy("digest", F.col(id_col).asc_nulls_first(), "row")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(order))
        .join(offsets, "part")
        .withColumn("index", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"int(((2 * (bytes_before + upto) - size) * {shards}) div (2L * {max(total, 1)}))")))
    )
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
