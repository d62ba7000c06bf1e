"""Prefix trie of conversations, built level by level and rolled up level by level.

Each turn is named by the SHA-256 of its role and text. Per depth, the live conversations are grouped by (parent node,
next turn); a group is a node, named by its depth and its least conv_id. A conversation that is alone in its node is no
longer live: the rest of it is a chain of nodes, which is written down at once. So there are as many levels as turns that
any two conversations share from their start. Then, from the deepest level up, children are summed by parent.

Turns are numbered without gathering a conversation: rows are range-partitioned by (conversation, turn, role, text), each
partition counts its own, and the few conversations that cross partitions (two for each at most) get what is before them
added. The ids that end at a node are hashed in order as a stream: sorted runs are joined to strings of some thousand
ids where they lie, and one task hashes a node's strings one after another.

Null role or text: empty. Null turn: before all others. Equal turn numbers: by role, then text; repeated rows are turns
each. Null conv_id: no conversation, takes no part. Very long texts are hashed whole. An empty table: no nodes, not even
the root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, stored

#: Ids joined to one string.
RUN = 2_000
NO_ENDS = hashlib.sha256().hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each run of equal conv from 1, in this partition."""
    last, count = None, 0
    part = TaskContext.get().partitionId()
    for b in batches:
        conv = b.column("conv").to_numpy()
        if not len(conv):
            continue
        edge = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
        nth = np.arange(len(conv)) - np.repeat(edge, np.diff([*edge, len(conv)])) + 1
        if conv[0] == last:
            nth[: edge[1] if len(edge) > 1 else len(conv)] += count
        last, count = conv[-1], int(nth[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth, pa.int64()), pa.array(np.full(len(conv), part), pa.int64())], ["conv", "key", "bytes", "nth", "part"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, nth, key, bytes) of every turn, numbered from 1."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    key = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))
    numbered = stored(sorted_rows.mapInArrow(_positions, "conv long, key binary, bytes long, nth long, part long"))
    ends = numbered.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high")).collect()  # a row for each partition
    seen: dict[int, int] = {}
    for r in ends:
        for c in {r["low"], r["high"]}:
            seen[c] = seen.get(c, 0) + 1
    crossing = [c for c, n in seen.items() if n > 1]
    if not crossing:
        return numbered.select("conv", "nth", "key", "bytes")
    spark = conversations.sparkSession
    few = spark.createDataFrame([(c,) for c in crossing], "conv long")
    before: list[tuple] = []
    upto: dict[int, int] = {}
    for r in numbered.join(F.broadcast(few), "conv", "left_semi").groupBy("conv", "part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["conv"], r["part"], upto.get(r["conv"], 0)))
        upto[r["conv"]] = upto.get(r["conv"], 0) + r["n"]
    offsets = spark.createDataFrame(before, "conv long, part long, before long")
    met = numbered.join(F.broadcast(offsets), ["conv", "part"], "left")
    return met.select("conv", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth"), "key", "bytes")


def borrowed_starts(conversations: DataFrame, apart: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the start of another: ((conv, depth, key, bytes) of the turns, (conv, length)).

    Conversation c gets the first h turns of conversation c - c % apart, then its own after its first h, where h is the
    unsigned crc32 of its decimal id modulo most + 1.
    """
    turns = stored(ordered_turns(conversations))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1))
    base = F.col("conv") - F.col("conv") % apart
    sizes = turns.groupBy("conv").agg(F.max("nth").alias("n"))
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    own = F.col("conv") % apart == 0
    given = F.least("h", F.coalesce("n_base", F.lit(0)))
    others = sizes.where(~own).select("conv", "n", h.alias("h"), base.alias("base")).join(of_base, "base", "left")
    convs = sizes.where(own).select("conv", F.col("n").alias("length")).union(others.select("conv", (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where(own & (F.col("nth") <= most)).select(F.col("conv").alias("base"), "nth", "key", "bytes")
    taken = sizes.where(~own).select("conv", h.alias("h"), base.alias("base")).join(heads, "base").where("nth <= h").select("conv", "nth", "key", "bytes")
    kept = turns.where(~own & (F.col("nth") > h)).select("conv", "nth", "key", "bytes", h.alias("h"), base.alias("base")).join(of_base, "base", "left")
    kept = kept.select("conv", (F.col("nth") - F.col("h") + given).alias("depth"), "key", "bytes")
    return turns.where(own).union(taken).union(kept).toDF("conv", "depth", "key", "bytes"), convs


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node's sorted ids as strings."""
    for b in batches:
        depth, node, conv = (b.column(k).to_numpy() for k in ("depth", "node", "conv"))
        if not len(conv):
            continue
        cut = np.flatnonzero((np.diff(depth) != 0) | (np.diff(node) != 0)) + 1
        cut = np.unique(np.concatenate([[0], cut, np.arange(0, len(conv), RUN)]))
        text = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(cut, [*cut[1:], len(conv)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[cut]), pa.array(node[cut]), pa.array(conv[cut]), pa.array(text)], ["depth", "node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each run of equal (depth, node), whose strings come in order."""
    now, digest = None, hashlib.sha256()
    out: list[tuple] = []
    for b in batches:
        for depth, node, ids in zip(b.column("depth").to_pylist(), b.column("node").to_pylist(), b.column("ids"), strict=True):
            if (depth, node) != now:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, node), hashlib.sha256(ids.as_py().encode())
            else:
                digest.update(b"," + ids.as_py().encode())
        if len(out) >= 10_000:
            yield _digests(out)
            out = []
    if now:
        yield _digests([*out, (*now, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "ends"])


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, node, ends) from (depth, node, conv): SHA-256 of the ids in ascending order, joined by commas."""
    order = ["depth", "node", "conv"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "depth long, node long, first long, ids string")
    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_hashed, "depth long, node long, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv, depth, key, bytes), depth from 1, of the conversations (conv, length)."""
    spark = turns.sparkSession
    turns, convs = stored(turns), stored(convs)
    top = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))
    number = lambda n: F.lit(n).cast("long")
    levels = [spark.createDataFrame([(top["least"], None, top["n"], 0)], "conv long, parent long, n long, bytes long")]
    live, rest, n_rest = convs.withColumn("node", number(top["least"])), turns, top["n"]
    ended = [live.where("length = 0").select(number(0).alias("depth"), "node", "conv")]
    while True:
        depth = len(levels)
        live = live.where(F.col("length") >= depth)
        now = live.join(rest.where(F.col("depth") == depth).select("conv", "key", "bytes"), "conv")
        grouped = stored(now.groupBy("node", "key").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("bytes").alias("bytes")))
        levels.append(grouped.select("conv", F.col("node").alias("parent"), "n", "bytes"))
        shared = grouped.where("n > 1").select("node", "key", F.col("conv").alias("child"))
        met = stored(now.select("conv", "length", "node", "key").join(shared, ["node", "key"]).select("conv", "length", F.col("child").alias("node")))
        ended.append(met.where(F.col("length") == depth).select(number(depth).alias("depth"), "node", "conv"))
        live = met.where(F.col("length") > depth)
        n_live = live.count()
        if not n_live:
            break
        if 2 * n_live <= n_rest:
            rest, n_rest = stored(rest.where(F.col("depth") > depth).join(live.select("conv"), "conv", "left_semi")), n_live
    # Children are summed by parent, from the deepest level up; a conversation alone in its node is a leaf to its parent.
    below, rolled = None, []
    for depth in range(len(levels) - 1, -1, -1):
        own = levels[depth] if depth == 0 else levels[depth].where("n > 1")
        if below is None:
            met = own.withColumns({"n_children": number(0), "leaves": number(None), "saved": number(None)})
        else:
            met = own.join(below.withColumnRenamed("parent", "conv"), "conv", "left")
        saved = (F.col("n") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))
        now = stored(met.select("conv", number(depth).alias("depth"), "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), saved.alias("saved")))
        rolled.append(now)
        alone = levels[depth].where("n = 1").select("parent", number(1).alias("leaves"), number(0).alias("saved"))
        below = now.select("parent", "leaves", "saved").union(alone).groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    nodes, singles = rolled[0], None
    for more in rolled[1:]:
        nodes = nodes.union(more)
    for depth, level in enumerate(levels[1:], 1):
        own = level.where("n = 1").select("conv", "parent", number(depth).alias("start"))
        singles = own if singles is None else singles.union(own)
    met_ends = ended[0]
    for more in ended[1:]:
        met_ends = met_ends.union(more)
    shared_nodes = nodes.join(_ends(met_ends).withColumnRenamed("node", "conv"), ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n", "n_children", "leaves", "saved", F.coalesce("ends", F.lit(NO_ENDS))
    )
    chains = turns.join(singles.join(convs, "conv"), "conv").where("depth >= start")
    last = F.col("depth") == F.col("length")
    chains = chains.select(
        "conv", "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv")), number(1),
        F.when(last, 0).otherwise(1).cast("long"), number(1), number(0), F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(NO_ENDS),
    )
    return shared_nodes.union(chains).toDF(*NODE)


def conversation_trie(conversations: DataFrame, apart: int = 5, most: int = 8) -> DataFrame:
    """The trie of all conversations, each rebuilt with the start of another."""
    return prefix_trie(*borrowed_starts(conversations, apart, most))
