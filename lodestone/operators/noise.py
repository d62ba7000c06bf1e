"""Noise for robustness tests: false edges by kind, in a nested order of activation, and reach at all shares in one walk.

A false edge of a source is drawn by hash from the pool of its kind; what is true or was drawn before is drawn again. So
no source meets the whole pool. A source gets as many false edges as its share of its true ones; at a smaller share
the first of these are active, so that the noise of a share holds that of all smaller ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import active_noise  # noqa: F401
from lodestone.sources.tables import SMALL, durable, if_small, stored

#: Draws of the first round beside those needed, and how many times as many a round makes as the one before.
SPARE, GROW = 3, 4
#: Sources with more true edges, counted with their copies, do not draw in one place; they are looked for among those that share a bucket.
MANY, BUCKETS = 100_000, 1 << 16


def false_edges(truth: DataFrame, most: float) -> DataFrame:
    """(rel, src, dst, rank, k_true): false edges of each (rel, src) of truth (rel, src, dst as texts), most * k_true of them (half
    to even), or as many as there are; rank from 0, in the order in which they are drawn.

    Draw j of a source is the target at place md5(src|j) modulo the size of the pool of its kind, whose targets are
    numbered in their order. The places of a source's true targets are brought together, and its draws are made there, so
    that only what is accepted leaves the task. Sources with very many targets draw row by row.
    """
    truth = truth.where("src is not null").select("rel", "src", "dst")
    numbered, sizes = _pool(truth)
    truth, heavy = _apart(truth)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches):
            first, k_true, _, (source, place, rank) = _draws(b, sizes, most)
            at = pa.array(first[source])
            yield pa.RecordBatch.from_arrays([b.column("rel").take(at), b.column("src").take(at), pa.array(k_true[source]), pa.array(rank), pa.array(place)], ["rel", "src", "k_true", "rank", "place"])

    drawn = _by_source(_by_pool(truth, numbered, sizes, "dst").select("rel", "src", "place")).mapInArrow(task, "rel string, src string, k_true long, rank int, place long")
    out = _by_pool(drawn, numbered, sizes, "place").select("rel", "src", "dst", "rank", "k_true")
    return out if heavy is None else _drawn_in_rows(heavy, numbered, most).union(out)


def _pool(truth: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The numbered targets (rel, dst, place) of each kind, and how many these are."""
    numbered = stored(_numbered(truth.select("rel", "dst").distinct()))
    return numbered, {r["rel"]: r["size"] for r in numbered.groupBy("rel").agg(F.count("*").alias("size")).collect()}  # a row for each kind


def _apart(truth: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges of sources that draw as one row, and those of the others, if there are any."""
    bucket = F.pmod(F.xxhash64("rel", "src"), F.lit(BUCKETS))
    crowded = stored(truth.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("bucket"))
    if crowded.isEmpty():
        return truth, None
    heavy = truth.select("rel", "src", bucket.alias("bucket")).join(F.broadcast(crowded), "bucket").groupBy("rel", "src").agg(F.count("*").alias("n"))
    heavy = if_small(stored(heavy.where(F.col("n") > MANY).select("rel", "src")))
    return truth.join(heavy, ["rel", "src"], "left_anti"), truth.join(heavy, ["rel", "src"], "left_semi")


def _by_source(rows: DataFrame) -> DataFrame:
    return rows.repartition("rel", "src").sortWithinPartitions("src", "rel")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rel, src), cut so that all of a source are in one batch."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        last = [pc.equal(b.column(c), b.column(c)[-1]) for c in ("rel", "src")]
        n = int(np.argmax(pc.and_(*last).to_numpy(zero_copy_only=False)))
        if n:
            yield b.slice(0, n)
        rest = b.slice(n)
    if rest is not None:
        yield rest


def _draws(b: pa.RecordBatch, sizes: dict[str, int], most: float, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """For the sources of a batch (rel, src, place) the row of each's first, how many true targets each has, (source, place) of
    these, and (source, place, rank) of what they draw. asked: rows whose sources draw; others draw nothing."""
    rel, src = b.column("rel").dictionary_encode(), b.column("src").dictionary_encode()
    kind = rel.indices.to_numpy()
    code = kind.astype(np.int64) * len(src.dictionary) + src.indices.to_numpy()
    new = np.r_[True, code[1:] != code[:-1]]
    first, source = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.array([sizes.get(r, 0) for r in rel.dictionary.to_pylist()], np.int64)[kind[first]]
    wide = int(size.max()) + 1
    given = b.column("place").is_valid().to_numpy(zero_copy_only=False)
    own = np.unique(source[given] * wide + b.column("place").drop_null().to_numpy())
    k_true = np.bincount(own // wide, minlength=len(first))
    need = np.minimum(np.rint(most * k_true).astype(np.int64), size - k_true)
    if asked is not None:
        need[np.setdiff1d(np.arange(len(first)), source[asked])] = 0
    begin, digits, seen, low = [x.encode() + b"|" for x in b.column("src").take(pa.array(first)).to_pylist()], [], own, np.zeros_like(need)
    left, high, have, out = np.flatnonzero(need > 0), need + need // 16 + 1, np.zeros_like(need), []
    while len(left):
        digits += [b"%d" % j for j in range(len(digits), high[left].max())]
        made = b"".join([md5(begin[i] + d).digest() for i, j, k in zip(left.tolist(), low[left].tolist(), high[left].tolist(), strict=True) for d in digits[j:k]])
        by = np.repeat(left, (high - low)[left])
        key = by * wide + np.frombuffer(made, ">u4")[::4].astype(np.int64) % size[by]
        # What is taken away and what comes again goes, in the order of the draws.
        at = np.unique(np.concatenate([seen, key]), return_index=True)[1]
        fresh = key[np.sort(at[at >= len(seen)]) - len(seen)]
        by = fresh // wide
        rank = np.arange(len(fresh)) - np.searchsorted(by, by) + have[by]
        out.append((by, fresh % wide, rank))
        have += np.bincount(by, minlength=len(first))
        left = left[have[left] < need[left]]
        seen, low, high = np.concatenate([seen, fresh]), high, 2 * high
    drawn = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    fit = drawn[2] < need[drawn[0]]
    return first, k_true, (own // wide, own % wide), (drawn[0][fit], drawn[1][fit], drawn[2][fit].astype(np.int32))


def _by_pool(rows: DataFrame, numbered: DataFrame, sizes: dict[str, int], key: str) -> DataFrame:
    """rows (rel, key) with what the pool of their kind (rel, dst, place) has for the key; small pools are sent to all tasks."""
    few = F.col("rel").isin([r for r, n in sizes.items() if n <= SMALL])
    return rows.where(few).join(F.broadcast(numbered.where(few)), ["rel", key]).unionByName(rows.where(~few).join(numbered.where(~few).hint("shuffle_hash"), ["rel", key]))


def _drawn_in_rows(truth: DataFrame, numbered: DataFrame, most: float) -> DataFrame:
    """`false_edges` of sources that have too many targets for one row: every draw is a row."""
    truth = stored(truth.distinct())
    sizes = numbered.groupBy("rel").agg(F.count("*").alias("size"))
    needs = truth.groupBy("rel", "src").agg(F.count("*").alias("k_true")).join(F.broadcast(sizes), "rel")
    needs = stored(needs.withColumn("need", F.least(F.bround(most * F.col("k_true")).cast("long"), F.col("size") - F.col("k_true"))).where("need > 0"))
    low, out = F.lit(0).cast("long"), None
    high, left = F.col("need") + F.floor(F.col("need") / 8) + SPARE, needs
    drawn = None
    while True:
        draws = left.select("rel", "src", "size", F.explode(F.sequence(low, high - 1)).alias("j"))
        at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "src", F.col("j").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("size"))
        fresh = draws.select("rel", "src", "j", at.alias("place")).join(numbered, ["rel", "place"]).join(truth, ["rel", "src", "dst"], "left_anti").select("rel", "src", "dst", "j")
        drawn = fresh if drawn is None else drawn.join(left.select("rel", "src"), ["rel", "src"], "left_semi").union(fresh)
        drawn = stored(drawn.groupBy("rel", "src", "dst").agg(F.min("j").alias("j")))
        have = drawn.groupBy("rel", "src").agg(F.count("*").alias("have"))
        state = stored(left.join(have, ["rel", "src"], "left").withColumn("done", F.coalesce("have", F.lit(0)) >= F.col("need")))
        ranked = drawn.join(state.where("done").select("rel", "src", "k_true", "need"), ["rel", "src"])
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("rel", "src").orderBy("j")) - 1).where("rank < need").select("rel", "src", "dst", "rank", "k_true")
        out = ranked if out is None else out.union(ranked)
        left = state.where("not done").drop("have", "done")
        if left.isEmpty():
            return out
        low, high = high, high * GROW


def _numbered(pool: DataFrame) -> DataFrame:
    """(rel, dst, place): targets of a kind numbered from 0 in their order, from counts of ranges of them."""
    part = F.spark_partition_id()
    ranged = durable(pool.repartitionByRange("rel", "dst").withColumn("part", part))
    own = F.row_number().over(Window.partitionBy("rel", "part").orderBy("dst"))
    totals = ranged.groupBy("rel", "part").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("rel").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # over one row for each partition
    return ranged.withColumn("own", own).join(before.select("rel", "part", "before"), ["rel", "part"]).select("rel", "dst", (F.col("before") + F.col("own") - 1).alias("place"))


def level_of(rank: Column, k_true: Column, shares: Sequence[float]) -> Column:
    """The least share at which the edge of that rank is active; null if it never is."""
    return F.coalesce(*[F.when(rank < F.bround(s * k_true), F.lit(float(s))) for s in sorted(shares)], F.lit(None).cast("double"))


def reached_by_share(starts: DataFrame, steps: Sequence[tuple[str, str]], edges: dict[str, DataFrame]) -> DataFrame:
    """(start, node, level): what starts (start, node) reach along the steps (relationship, > or <) over edges (src, dst, level).

    level is the least share at which there is a way: the least, over all ways, of the greatest level on it. One walk
    with one row for each start and node serves all shares; 0 says that a way of true edges leads there.
    """
    front = starts.select("start", "node", F.lit(0.0).alias("level")).distinct()
    for rel, way in steps:
        near, far = ("src", "dst") if way == ">" else ("dst", "src")
        step = edges[rel].select(F.col(near).alias("node"), F.col(far).alias("_next"), F.col("level").alias("_level"))
        front = front.join(step, "node").groupBy("start", F.col("_next").alias("node")).agg(F.min(F.greatest("level", "_level")).alias("level"))
    return front


def lacking(starts: DataFrame, reached: DataFrame, names: DataFrame) -> DataFrame:
    """(rel, the columns of starts): for each relationship the starts (start) that do not reach (rel, start, name) all of its names."""
    whole = names.select("rel", "name").distinct().groupBy("rel").agg(F.count("*").alias("n"))  # a row for each kind
    full = reached.select("rel", "start", "name").distinct().groupBy("rel", "start").agg(F.count("*").alias("n")).join(F.broadcast(whole), ["rel", "n"])
    return starts.join(F.broadcast(whole.select("rel"))).join(full, ["rel", "start"], "left_anti").select("rel", *starts.columns)


def named_by_share(fronts: dict[str, DataFrame], truth: DataFrame, names: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(rel, start, name, level), start a short key such as a number: names (rel, dst, name) of the targets that fronts (start, node, level) of relationships reach
    over their true edges, truth (rel, src, dst), and their false ones, with the least share at which they do.

    Starts come to where the sources draw, and targets are told apart by their places until there is one row for each
    start and target: no edge is written down or meets the front by itself.
    """
    truth = truth.where("src is not null").select("rel", "src", "dst")
    numbered, sizes = _pool(truth)
    light, heavy = _apart(truth)
    before = dict(zip(sizes, np.cumsum([0, *sizes.values()])[:-1].tolist(), strict=True))
    # The places of all kinds are told apart by one number.
    target = F.coalesce(*[F.when(F.col("rel") == r, F.col("place") + n) for r, n in before.items()], F.lit(None).cast("long")).alias("target")
    front = reduce(DataFrame.union, [f.where("node is not null").select(F.lit(rel).alias("rel"), F.col("node").alias("src"), "start", F.col("level").cast("double").alias("_level")) for rel, f in fronts.items()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches):
            asked = np.flatnonzero(b.column("start").is_valid().to_numpy(zero_copy_only=False))
            first, k_true, own, (by, place, rank) = _draws(b, sizes, max(shares), asked)
            level = np.full(len(by), np.nan)
            for s in sorted(shares, reverse=True):
                level[rank < np.rint(s * k_true[by])] = s
            active = ~np.isnan(level)
            by, place, level = np.r_[own[0], by[active]], np.r_[own[1], place[active]], np.r_[np.zeros(len(own[0])), level[active]]
            place += np.array([before.get(r, 0) for r in b.column("rel").take(pa.array(first)).to_pylist()], np.int64)[by]
            order = np.argsort(by, kind="stable")
            # Each start of a source with each of its ends.
            edge = np.searchsorted(by[order], np.arange(len(first) + 1))
            source = np.searchsorted(first, asked, "right") - 1
            many = edge[source + 1] - edge[source]
            end = order[np.repeat(edge[source] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            start = np.repeat(asked, many)
            its = b.column("_level").fill_null(0.0).to_numpy()[start]
            yield pa.RecordBatch.from_arrays([b.column("start").take(pa.array(start)), pa.array(place[end]), pa.array(np.maximum(its, level[end]))], ["start", "target", "level"])

    kind = front.schema["start"].dataType
    placed = _by_pool(light, numbered, sizes, "dst").select("rel", "src", "place", F.lit(None).cast(kind).alias("start"), F.lit(None).cast("double").alias("_level"))
    rows = placed.union(front.select("rel", "src", F.lit(None).cast("long").alias("place"), "start", "_level"))
    met = _by_source(rows).mapInArrow(task, f"start {kind.simpleString()}, target long, level double")
    if heavy is not None:
        false = _drawn_in_rows(heavy, numbered, max(shares)).select("rel", "src", "dst", level_of(F.col("rank"), F.col("k_true"), shares).alias("level")).where("level is not null")
        ends = false.union(heavy.withColumn("level", F.lit(0.0))).join(numbered, ["rel", "dst"])
        met = met.union(front.join(ends, ["rel", "src"]).select("start", target, F.greatest("_level", "level").alias("level")))
    met = met.groupBy("start", "target").agg(F.min("level").alias("level"))
    named = numbered.join(names, ["rel", "dst"]).select("rel", target, "name")
    return met.join(named, "target").groupBy("rel", "start", "name").agg(F.min("level").alias("level"))
