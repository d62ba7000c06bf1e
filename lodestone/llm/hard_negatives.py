"""Hard-negative mining: blocked dense products of anchors with all rows, exact in integers.

Anchors are cut into blocks of bounded bytes. Each block is broadcast, and every task multiplies it with its rows, some
thousand at a time, as float64 matrices, which is exact as long as no sum of absolute products can reach 2^53; a stretch
of rows that could is multiplied in Python's integers. The first pass keeps, for each anchor, the best rows of the same
label; the second keeps, for each anchor and positive, the best rows of other labels whose scores lie in the positive's
window. A task hands on one short list for each anchor, and lists are merged by anchor, so no pair of rows leaves its
task unless it may be in the result. Passes over the rows grow with the number of blocks, as the pairs do.

Components become floor(256 * x), x as double. Order: higher score first, ties by smaller id. The positives of an anchor
are its first `positives` other rows of the same label; the negatives of a positive are the first `negatives` rows of
another label with 80 * positive_score <= 100 * negative_score <= 100 * positive_score.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Vectors of unlike
lengths are compared on the components that both have. Repeated rows: rows of one id, label and score count once, and
another row is one of another id. Equal anchors are one anchor; unlike rows of one id are anchors each, told apart by
`anchor_row`. Scores beyond a long are ordered by their exact value and reported as the nearest long. An empty table, no
anchors, no positives: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable

#: Bytes of a block of anchors; products held at once; from this sum of absolute products on, float64 is not exact.
BLOCK, PRODUCTS, EXACT = 16 << 20, 4 << 20, 2.0**53
_LONG = 2**63 - 1
_TURNED = str.maketrans("0123456789", "9876543210")
#: Ascending order of (size, digits, id) is the order of results, however large a score is.
_ENTRY = "array<struct<size: int, digits: string, id: bigint>>"


def whole(column: pa.ListArray) -> np.ndarray:
    """floor(256 * x) of every vector, filled up with zeros; Python's integers where a double would overflow."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        v = np.floor(256.0 * flat)
    if not np.isfinite(v).all():
        v = np.array([int(a) * 256 if abs(a) > 2**60 else int(np.floor(256.0 * a)) for a in flat], object)
    if len(sizes) and (sizes == sizes[0]).all():
        return v.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max(initial=0)), v.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact scores of all rows of a with all rows of b, on the components that both have."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if a.dtype != object and b.dtype != object and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * wide < EXACT:
        return a @ b.T
    left, right = ([[int(x) for x in row] for row in m] for m in (a, b))
    return np.array([sum(x * y for x, y in zip(r, s, strict=True)) for r in left for s in right], object).reshape(len(a), len(b))


def first_of(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `most` entries of each slot, in order, each (score, id) once."""
    up = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
    at = np.lexsort((ids, -up, slot))
    slot, score, ids, up = slot[at], score[at], ids[at], up[at]
    new = np.ones(len(slot), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (up[1:] != up[:-1]) | (ids[1:] != ids[:-1])
    slot, score, ids = slot[new], score[new], ids[new]
    keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < most
    return slot[keep], score[keep], ids[keep]


class Best:
    """For each slot the first `most` (score, id) met so far."""

    def __init__(self, slots: int, most: int):
        self.most, self.slots = most, slots
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.floor, self.last = np.full(slots, -np.inf), np.zeros(slots, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fit = (score > self.floor[slot]) | ((score == self.floor[slot]) & (ids < self.last[slot]))
        if not fit.any():
            return
        if score.dtype == object and self.held[1].dtype != object:
            self.held = (self.held[0], np.array([int(x) for x in self.held[1]], object), self.held[2])
        elif score.dtype != object and self.held[1].dtype == object:
            score = np.array([int(x) for x in score], object)
        new = first_of(slot[fit], score[fit], ids[fit], self.most)
        self.held = first_of(*(np.concatenate(x) for x in zip(self.held, new, strict=True)), self.most)
        slots, score, ids = self.held
        full = np.flatnonzero(np.arange(len(slots)) - np.searchsorted(slots, slots) == self.most - 1)
        self.floor = np.full(self.slots, -np.inf, score.dtype)
        self.floor[slots[full]], self.last[slots[full]] = score[full], ids[full]

    def rows(self) -> Iterator[tuple[int, list[dict]]]:
        slots, scores, ids = self.held
        for s in np.unique(slots):
            own = slice(*np.searchsorted(slots, [s, s + 1]))
            yield int(s), [_entry(int(v), int(i)) for v, i in zip(scores[own], ids[own], strict=True)]


def _entry(score: int, name: int) -> dict:
    digits = str(abs(score))
    return {"size": -len(digits), "digits": digits.translate(_TURNED), "id": name} if score >= 0 else {"size": len(digits), "digits": digits, "id": name}


def _score(entry: dict) -> int:
    return int(entry["digits"].translate(_TURNED)) if entry["size"] < 0 else -int(entry["digits"])


class Block:
    """Anchors that are multiplied together."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.names, self.ids, self.labels = (t[k].to_numpy() for k in ("anchor_row", "id", "label"))
        self.x = whole(t["v"].chunk(0))


def _stretches(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, scores) of so many rows that their products with the anchors are held at once."""
    rows = max(1, min(8192, PRODUCTS // len(block.ids)))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), products(block.x, whole(part.column("v")))


def _lists(best: list[Best], names: np.ndarray) -> pa.RecordBatch:
    out = [(int(names[s]), k, found) for k, held in enumerate(best) for s, found in held.rows()]
    entry = pa.list_(pa.struct([("size", pa.int32()), ("digits", pa.string()), ("id", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), entry))], ["anchor_row", "nth", "best"])


def _positives(rows: DataFrame, shared, most: int) -> DataFrame:
    """The best rows of an anchor's label, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = Best(len(block.ids), most)
        for ids, labels, scores in _stretches(batches, block):
            at, row = np.nonzero((block.labels[:, None] == labels) & (block.ids[:, None] != ids) & (scores >= best.floor[:, None]))
            best.add(at, scores[at, row], ids[row])
        yield _lists([best], block.names)

    return rows.mapInArrow(run, f"anchor_row long, nth int, best {_ENTRY}")


def _negatives(rows: DataFrame, shared, most: int) -> DataFrame:
    """The best rows of other labels inside the window of an anchor's positive, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tops = shared.value  # of each rank (slots that have such a positive, their scores)
        best = [Best(len(block.ids), most) for _ in tops]
        for ids, labels, scores in _stretches(batches, block):
            other = block.labels[:, None] != labels
            for (slots, most_score), held in zip(tops, best, strict=True):
                least = np.array([max(-(-80 * t // 100), f) for t, f in zip(most_score, held.floor[slots].tolist(), strict=True)], object)
                upper = np.array(most_score, object)
                if scores.dtype != object and max(map(abs, most_score), default=0) < EXACT:
                    least, upper = least.astype(np.float64), upper.astype(np.float64)
                own = scores[slots]
                at, row = np.nonzero(other[slots] & (own <= upper[:, None]) & (own >= least[:, None]))
                held.add(slots[at], own[at, row], ids[row])
        yield _lists(best, block.names)

    return rows.mapInArrow(run, f"anchor_row long, nth int, best {_ENTRY}")


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The tasks' lists of an anchor as one: a list holds `most` entries, and there are as many lists as tasks."""
    return found.groupBy("anchor_row", "nth").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, most).alias("best"))


def _usable(vectors: DataFrame, label: Column, id_col: str, vec_col: str, wanted: Column) -> DataFrame:
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(wanted, F.lit(False)).alias("wanted"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)


def _blocks(mine: DataFrame, most: int) -> Iterator[Block]:
    """Blocks of at most `most` anchors, by ranges of their row numbers; one at a time is at the driver."""
    start = F.col("anchor_row") - F.pmod(F.col("anchor_row").bitwiseAND(2**33 - 1), F.lit(most))
    runs = mine.groupBy(start.alias("start")).count().orderBy("start").collect()  # full ones, and the rest of each partition
    groups: list[list[int]] = []  # first row number, first of the next group, rows
    for r in runs:
        if groups and groups[-1][2] + r["count"] <= most:
            groups[-1][2] += r["count"]
        else:
            groups += [[r["start"], _LONG, r["count"]]]
            if len(groups) > 1:
                groups[-2][1] = r["start"]
    for low, high, _ in groups:
        yield Block(mine.where((F.col("anchor_row") >= low) & (F.col("anchor_row") < high)).toArrow())


def _long(entry: str) -> Column:
    size, digits = F.col(f"{entry}.size"), F.col(f"{entry}.digits")
    plain = F.when(size < 0, F.translate(digits, "0123456789", "9876543210")).otherwise(F.concat(F.lit("-"), digits))
    return F.coalesce(plain.try_cast("long"), F.when(size < 0, F.lit(_LONG)).otherwise(F.lit(-_LONG - 1)))


def mine_negatives(vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row) of the rows that `anchors`
    names; label: the label of a row."""
    context = vectors.sparkSession.sparkContext
    usable = _usable(vectors, label, id_col, vec_col, anchors)
    mine = durable(usable.where("wanted").select("id", "label", "v").distinct().withColumn("anchor_row", F.monotonically_increasing_id()))
    wide = mine.agg(F.max(F.size("v"))).first()[0] or 1
    # As many stretches as tasks run at once: each task hands on one short list for an anchor, however many rows it reads.
    rows = usable.select("id", "label", "v").coalesce(max(1, context.defaultParallelism))
    out = None
    for block in _blocks(mine, max(1, BLOCK // (8 * wide))):
        shared = context.broadcast(block)
        best = durable(_merged(_positives(rows, shared, positives), positives))
        place = {int(n): k for k, n in enumerate(block.names)}
        tops: list[dict] = [{} for _ in range(positives)]
        for r in best.select("anchor_row", "best").collect():  # at most `positives` for each anchor of the block
            for k, e in enumerate(r["best"]):
                tops[k][place[r["anchor_row"]]] = _score(e)
        second = context.broadcast((block, [(np.array(list(t), np.int64), list(t.values())) for t in tops]))
        known = best.select("anchor_row", F.posexplode("best").alias("nth", "p"))
        found = _merged(_negatives(rows, second, negatives), negatives).select("anchor_row", "nth", F.posexplode("best").alias("at", "n"))
        met = known.join(found, ["anchor_row", "nth"])
        met = durable(met.select("anchor_row", F.col("p.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), _long("p").alias("positive_score"), _long("n").alias("negative_score")))
        out = met if out is None else out.union(met)
        shared.unpersist()
        second.unpersist()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_row"]
    if out is None:
        return vectors.sparkSession.createDataFrame([], ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in names))
    return mine.select(F.col("id").alias("anchor_id"), "anchor_row").join(out, "anchor_row").select(*names)
