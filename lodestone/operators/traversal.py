"""Walks over typed edges: with path multiplicity, by frontier, and simple paths up to a depth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import SMALL, durable


def follow(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]]) -> DataFrame:
    """Every path from start (anchor, node) along steps (relation, backwards); edges: (src, rel, dst, noise).

    Paths keep their multiplicity; noise says whether any edge of the path is noise.
    """
    paths = start.select("anchor", "node", F.array("node").alias("path"), F.lit(False).alias("noise"))
    for rel, back in steps:
        near, far = ("dst", "src") if back else ("src", "dst")
        step = edges.where(F.col("rel") == rel).select(F.col(near).alias("node"), F.col(far).alias("_next"), F.col("noise").alias("_noise"))
        paths = paths.join(step, "node").select("anchor", F.col("_next").alias("node"), F.concat("path", F.array("_next")).alias("path"), (F.col("noise") | F.col("_noise")).alias("noise"))
    return paths


def walks(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]]) -> DataFrame:
    """(anchor, node, paths, noisy): how many paths lead along the steps, and how many of them have a noise edge.

    Counts are summed after every hop, so that rows stay as many as nodes however many paths there are.
    """
    front = start.groupBy("anchor", "node").agg(F.count("*").alias("paths")).withColumn("noisy", F.lit(0).cast("long"))
    for rel, back in steps:
        near, far = ("dst", "src") if back else ("src", "dst")
        step = edges.where(F.col("rel") == rel).select(F.col(near).alias("node"), F.col(far).alias("_next"), F.col("noise").alias("_noise"))
        noisy = F.when(F.col("_noise"), F.col("paths")).otherwise(F.col("noisy"))
        front = front.join(step, "node").groupBy("anchor", F.col("_next").alias("node")).agg(F.sum("paths").alias("paths"), F.sum(noisy).alias("noisy"))
    return front


def reach(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]]) -> DataFrame:
    """(anchor, node): what is reached, each node once after every hop."""
    front = start.select("anchor", "node").distinct()
    for rel, back in steps:
        near, far = ("dst", "src") if back else ("src", "dst")
        step = edges.where(F.col("rel") == rel).select(F.col(near).alias("node"), F.col(far).alias("_next")).distinct()
        front = front.join(step, "node").select("anchor", F.col("_next").alias("node")).distinct()
    return front


def simple_paths(start: DataFrame, edges: DataFrame, depth: int, most: int = 4000) -> DataFrame:
    """(anchor, node, path) of paths with `depth` edges, either direction, no node twice; per anchor and level the first
    `most` paths in the order of their nodes go on."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).union(edges.select(F.col("dst"), F.col("src"))).distinct()
    paths = start.select("anchor", "node", F.array("node").alias("path"))
    order = Window.partitionBy("anchor").orderBy("path")
    for _ in range(depth):
        on = paths.join(both, "node").where(~F.array_contains("path", F.col("_next"))).select("anchor", F.col("_next").alias("node"), F.concat("path", F.array("_next")).alias("path"))
        paths = on.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")
    return paths


#: Of the paths that may go on, the share that is extended first, and how many times as many a further try takes.
FIRST, GROW = 8, 8


def walk_levels(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]], most: int | None = 4000) -> list[DataFrame]:
    """For each number of steps (anchor, node, path, _nth): paths from start (anchor, node) along the steps (relation, backwards), no node twice.

    Paths are ordered by their nodes, and per anchor and level the first `most` go on (all, if None). A path's order is its
    parent's number and then its last node, so that no arrays are compared.
    Each level is stored once, for the next level and for whoever reads it.
    """
    paths = start.select("anchor", "node", F.array("node").alias("path")).distinct()
    paths = durable(paths.withColumn("_nth", F.row_number().over(Window.partitionBy("anchor").orderBy("node"))))
    levels = []
    for rel, back in steps:
        near, far = ("dst", "src") if back else ("src", "dst")
        step = edges.where(F.col("rel") == rel).select(F.col(near).alias("node"), F.col(far).alias("_next"))
        paths = _extended(paths, step, most)
        levels.append(paths)
    return levels


def _extended(paths: DataFrame, step: DataFrame, most: int | None) -> DataFrame:
    """The next level, of its first `most` paths an anchor.

    The extensions of earlier paths come before those of later ones, so that the first paths of an anchor are enough as soon
    as they have `most` extensions. Few paths are sent to the edges; the edges are not counted, and no others made distinct.
    """
    order = Window.partitionBy("anchor").orderBy("_parent", "node")
    take = None if most is None else max(1, most // FIRST)
    while True:
        some = paths if take is None else paths.where(F.col("_nth") <= take)
        sent = F.broadcast if some.limit(SMALL + 1).count() <= SMALL else lambda df: df
        own = step.join(sent(some.select("node").distinct()), "node", "left_semi").distinct()
        on = own.join(sent(some), "node").where(~F.array_contains("path", F.col("_next")))
        on = on.select("anchor", F.col("_next").alias("node"), F.concat("path", F.array("_next")).alias("path"), F.col("_nth").alias("_parent"))
        if most is None:
            return durable(on.withColumnRenamed("_parent", "_nth"))
        got = durable(on.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_parent"))
        full = got.where(F.col("_nth") == most).select("anchor")
        if paths.where(F.col("_nth") > take).join(full, "anchor", "left_anti").isEmpty():
            return got
        take *= GROW


def simple_walks(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]], most: int | None = 4000) -> DataFrame:
    """(anchor, node, path) of the last of `walk_levels`."""
    return walk_levels(start, edges, steps, most)[-1].drop("_nth")


def half_paths(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]], most: int) -> tuple[DataFrame, DataFrame]:
    """((anchor, node, path), (anchor)): at most `most` simple paths of an anchor and level, and the anchors of which some were left out."""
    paths, cut = start.select("anchor", "node", F.array("node").alias("path")), None
    order = Window.partitionBy("anchor").orderBy(F.xxhash64("path"), "path")
    for rel, back in steps:
        near, far = ("dst", "src") if back else ("src", "dst")
        step = edges.where(F.col("rel") == rel).select(F.col(near).alias("node"), F.col(far).alias("_next")).distinct()
        # A path goes on to at most `most` nodes, so that a hub does not meet more than can be kept.
        few = step.withColumn("_nth", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("_next"), "_next"))).where(F.col("_nth") <= most + len(steps) + 1)
        on = paths.join(few, "node").where(~F.array_contains("path", F.col("_next"))).select("anchor", F.col("_next").alias("node"), F.concat("path", F.array("_next")).alias("path"))
        ranked = durable(on.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most + 1))
        over = ranked.where(F.col("_nth") > most).select("anchor")
        cut = over if cut is None else cut.union(over)
        paths = ranked.where(F.col("_nth") <= most).drop("_nth")
    return paths, cut.distinct()


def some_path(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]], most: int = 64, grow: int = 16) -> DataFrame:
    """(anchor, path): for each anchor that has a simple path along all the steps one such path, else null. Exact.

    Half paths from the anchors and from the nodes that these end at meet in the middle and must share no other node. The
    first round makes few of them; the anchors that it leaves undecided go on with `grow` times as many, until no half path
    of an anchor is left out any more.
    """
    half = len(steps) // 2
    left = durable(start.select("anchor", "node").distinct())
    out = None
    while True:
        first, cut = half_paths(left, edges, steps[:half], most)
        middles = durable(first.select(F.col("node").alias("anchor"), "node").distinct())
        second, cut_middles = half_paths(middles, edges, steps[half:], most)
        met = first.join(second.select(F.col("anchor").alias("node"), F.slice("path", 2, len(steps)).alias("_rest")), "node").where(~F.arrays_overlap("path", "_rest"))
        found = durable(met.groupBy("anchor").agg(F.min(F.concat("path", "_rest")).alias("path")))
        open_still = cut.union(first.join(cut_middles.select(F.col("anchor").alias("node")), "node", "left_semi").select("anchor")).distinct()
        rest = left.join(found.select("anchor"), "anchor", "left_anti")
        undecided = durable(rest.join(open_still, "anchor", "left_semi"))
        settled = found.union(rest.join(open_still, "anchor", "left_anti").select("anchor", F.lit(None).cast("array<string>").alias("path")))
        out = settled if out is None else out.union(settled)
        if undecided.isEmpty():
            return out
        left, most = undecided, most * grow


def least_path(start: DataFrame, edges: DataFrame, steps: Sequence[tuple[str, bool]], most: int = 1_000, grow: int = 16) -> DataFrame:
    """(anchor, path): for each anchor the least simple path along all the steps, compared node by node; null if there is none. Exact.

    A walk that keeps the first `most` paths of a level leaves out only paths that come after these. So the first path of its
    last level is the least of all. An anchor that has none there, but filled a level, goes on with `grow` times as many.
    """
    left, out = durable(start.select("anchor", "node").distinct()), None
    while True:
        levels = walk_levels(left, edges, steps, most)
        found = levels[-1].where("_nth = 1").select("anchor", "path")
        filled = reduce(DataFrame.union, [x.where(F.col("_nth") == most).select("anchor") for x in levels]).distinct()
        rest = left.join(found.select("anchor"), "anchor", "left_anti")
        undecided = durable(rest.join(filled, "anchor", "left_semi"))
        none = rest.join(filled, "anchor", "left_anti").select("anchor", F.lit(None).cast("array<string>").alias("path")).distinct()
        settled = found.union(none)
        out = settled if out is None else out.union(settled)
        if undecided.isEmpty():
            return out
        left, most = undecided, most * grow


def first_path(paths: DataFrame) -> DataFrame:
    """One path for each anchor: the least."""
    return paths.groupBy("anchor").agg(F.min("path").alias("path"))


def witnesses(visits: DataFrame, anchor: str, hop: str, node: str) -> DataFrame:
    """(anchor, hop, seen): distinct nodes met up to each hop."""
    first = visits.groupBy(anchor, node).agg(F.min(hop).alias(hop)).groupBy(anchor, hop).agg(F.count("*").alias("new"))
    return first.withColumn("seen", F.sum("new").over(Window.partitionBy(anchor).orderBy(hop))).drop("new")
