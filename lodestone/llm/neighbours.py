"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Nearness is the largest inner product. The graph starts from random-direction buckets (several tables of buckets of
bounded size, compared inside), then NN-descent joins every node's neighbours with each other, through the node, round
by round. A query starts at its own node's neighbours and, round by round, expands the best nodes of its beam that are
not expanded yet: frontier nodes are joined with the nodes' neighbour lists and only what enters the beam comes back.
Graph and search use copies of unit length in half precision, each with its norm in double precision, so that very long
and very short vectors keep their order; the last beam is scored in double precision on the original vectors. The
similarities that a node keeps of others leave out its own norm, which does not change their order.

Equal vectors are one node (keyed by a 64-bit hash of the vector) that holds its `top` + 1 smallest ids, which is all
that a result can show of them. Null, zero or empty vectors, vectors with null or non-finite components and vectors of
another length than most take no part, as candidates or queries. Null ids take no part. Repeated rows (same id, same
vector) are one row. Ties go to the smaller id. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable

#: Neighbours kept for a node; tables, bits of a code and rows of the buckets to start from; members of one local join, rounds of it.
NEIGHBOURS, TABLES, BITS, BUCKET, JOINED, ROUNDS = 40, 8, 36, 500, 10, 2
#: Groups in which the nodes that name a node as neighbour are thinned before they meet it.
SALTS = 32
#: Nodes a query keeps in its beam, nodes it expands in a round, rounds, neighbours (own and reverse) of a searched node.
BEAM, EXPAND, HOPS, DEGREE = 200, 80, 5, 60
#: Queries that meet one node's neighbours in one row.
TOGETHER = 500
#: Visited nodes that a worker unpacks at once.
VISITED = 200
_FLUSH = 400_000


def _batches_of(batches: Iterator[pa.RecordBatch], key: str, most: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole runs of a sorted key, of about `most` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            t = pa.Table.from_batches(held)
            keys = t[key].to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind) if parts else np.zeros(0, kind)


def _packed(vec: np.ndarray) -> bytes:
    """A vector's norm, then its copy of unit length."""
    most = np.abs(vec).max()
    scaled = vec / most
    length = np.sqrt(scaled @ scaled)
    with np.errstate(over="ignore"):
        norm = min(most * length, np.finfo(np.float64).max)
    return np.array([norm], "<f8").tobytes() + (scaled / length).astype("<f2").tobytes()


def _unpacked(halves: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Norms and copies of unit length of `count` packed vectors."""
    rows = np.frombuffer(halves, np.uint8).reshape(count, -1)
    return rows[:, :8].copy().view("<f8")[:, 0], rows[:, 8:].copy().view("<f2").astype(np.float32)


def _lists(keys: np.ndarray, values: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each run of equal keys, with its values packed."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    cols = [pa.array(keys[edge[:-1]], pa.int64())]
    cols += [pa.array([v[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for v in values.values()]
    return pa.RecordBatch.from_arrays(cols, names)


def _best(key: np.ndarray, other: np.ndarray, sim: np.ndarray, flag: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Per key the `most` nearest others, each once; of repeats the one with the greatest flag stays."""
    at = np.lexsort((-flag, other, key))
    key, other, sim, flag = key[at], other[at], sim[at], flag[at]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])]) & (key != other) if len(key) else np.zeros(0, bool)
    key, other, sim, flag = key[new], other[new], sim[new], flag[new]
    at = np.lexsort((other, -sim, key))
    key, other, sim, flag = key[at], other[at], sim[at], flag[at]
    rank = np.arange(len(key)) - np.searchsorted(key, key)
    keep = rank < most
    return key[keep], other[keep], sim[keep], flag[keep]


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, top: int, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """(node, half, vec, ids) of each different vector, with its smallest ids; (node, asking) of ids that are queries."""
    v = F.col("v")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), wanted.alias("ask")).where(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (length[0]["n"] if length else 0)).withColumn("node", F.xxhash64(F.transform("v", lambda x: x + 0.0)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nodes, asks = (b.column(k).to_numpy(zero_copy_only=False) for k in ("id", "node", "ask"))
            at = np.lexsort((ids, nodes))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(nodes[at])) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
            runs = [at[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
            vec = [b.column("v")[int(r[0])].values.to_numpy() for r in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[r[0]] for r in runs], pa.int64()), pa.array([_packed(x.astype(np.float64)) for x in vec], pa.binary()), pa.array([x.astype("<f8").tobytes() for x in vec], pa.binary()),
                 pa.array([np.unique(ids[r])[: top + 1] for r in runs], pa.list_(pa.int64())), pa.array([np.unique(ids[r][asks[r].astype(bool)]) for r in runs], pa.list_(pa.int64()))],
                ["node", "half", "vec", "ids", "asked"],
            )

    packed = rows.select("node", "id", F.coalesce("ask", F.lit(False)).alias("ask"), "v").mapInArrow(pack, "node long, half binary, vec binary, ids array<long>, asked array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1)
    asked = packed.select("node", F.explode("asked").alias("asking"))
    nodes = durable(packed.groupBy("node").agg(F.first("half").alias("half"), F.first("vec").alias("vec"), ids.alias("ids")))
    return nodes, durable(asked.distinct())


def _codes(x: np.ndarray) -> list[np.ndarray]:
    """For each table a code of BITS bits, six for each of its levels: which of 32 random directions, drawn once for all
    vectors, a vector lies along most, and on which side."""
    out, at = [], np.arange(len(x))
    for t in range(TABLES):
        code = np.zeros(len(x), np.int64)
        for p in np.split(x @ np.random.default_rng(t).standard_normal((x.shape[1], 32 * (BITS // 6)), np.float32), BITS // 6, 1):
            best = np.abs(p).argmax(1)
            code = code << 6 | best * 2 + (p[at, best] > 0)
        out.append(code)
    return out


def _start(nodes: DataFrame, count: int) -> DataFrame:
    """(node, others, sims, fresh): the best of a few tables of random-direction buckets.

    A bucket is the nodes of a table whose codes begin alike: all begin with as many bits as would make buckets of BUCKET
    nodes (a quarter of all in small tables) if they were even, and only those of buckets that are too large are read on. What shares a whole code is
    dealt by hash. So work for a node does not grow with the table.
    """
    first = min(BITS, max(0, int(np.ceil(np.log2(max(1, count) / max(50, min(BUCKET, count // 4)))))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, x = _unpacked(b"".join(b.column("half").to_pylist()), b.num_rows)
                for t, c in enumerate(_codes(x)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t), pa.int32()), pa.array(c, pa.int64()), b.column("node"), b.column("half")], ["t", "code", "node", "half"])

    coded = nodes.select("node", "half").mapInArrow(code, "t int, code long, node long, half binary")
    head = F.shiftright("code", BITS - first)
    sizes = coded.groupBy("t", head.alias("head")).count().where(F.col("count") > 2 * BUCKET)
    more = F.least(F.lit(BITS - first), F.ceil(F.log2(F.col("count") / BUCKET))).cast("int")
    bits = coded.withColumn("head", head).join(sizes.select("t", "head", more.alias("more")), ["t", "head"], "left")
    tail = F.expr(f"shiftright(code, {BITS - first} - coalesce(more, 0))")
    named = bits.select("node", "half", F.xxhash64("t", F.coalesce("more", F.lit(0)), tail).alias("bucket"))
    large = named.groupBy("bucket").agg(F.ceil(F.count("*") / (3 * BUCKET)).cast("int").alias("parts")).where("parts > 1")
    dealt = named.join(large, "bucket", "left").withColumn("bucket", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches_of(batches, "bucket"):
            bucket, node = t["bucket"].to_numpy(), t["node"].to_numpy()
            norm, x = _unpacked(b"".join(t["half"].to_pylist()), len(node))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                s = (x[a:b] @ x[a:b].T) * norm[a:b]
                np.fill_diagonal(s, -np.inf)
                k = min(NEIGHBOURS // 2, b - a - 1)
                near = np.argpartition(-s, k - 1, 1)[:, :k]
                yield _lists(np.repeat(node[a:b], k), {"o": node[a:b][near].ravel(), "s": np.take_along_axis(s, near, 1).ravel().astype("<f8")}, ["node", "others", "sims"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "node long, others binary, sims binary")


def _merge(found: DataFrame, graph: DataFrame) -> DataFrame:
    """The graph (node, half, others, sims, fresh) with what was found; entries that it did not have are fresh."""
    rows = found.select("node", F.lit(None).cast("binary").alias("half"), "others", "sims", F.lit(False).alias("known")).union(graph.select("node", "half", "others", "sims", F.lit(True).alias("known")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches_of(batches, "node", 10_000):
            n = [len(x) // 8 for x in t["others"].to_pylist()]
            node = t["node"].to_numpy()
            key, known = np.repeat(node, n), np.repeat(t["known"].to_numpy(), n).astype(np.int8)
            key, other, sim, known = _best(key, _flat(t["others"], "<i8"), _flat(t["sims"], "<f8"), known, NEIGHBOURS)
            own = [(k, h) for k, h in zip(node.tolist(), t["half"].to_pylist(), strict=True) if h is not None]
            keys = np.array([k for k, _ in own], np.int64)
            low, high = np.searchsorted(key, keys), np.searchsorted(key, keys, "right")
            pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(low, high, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([h for _, h in own], pa.binary()), pack(other), pack(sim), pack(1 - known)], ["node", "half", "others", "sims", "fresh"])

    return durable(rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, half binary, others binary, sims binary, fresh binary"))


def _capped(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], cap: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """At most cap members for a middle node and stretch of rows, fresh ones first, the rest in hash order."""
    for mid, member, fresh in pairs:
        mixed = (member.view(np.uint64) ^ (mid.view(np.uint64) >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
        at = np.lexsort((mixed, -fresh, mid))
        mid, member, fresh = mid[at], member[at], fresh[at]
        keep = np.arange(len(mid)) - np.searchsorted(mid, mid) < cap
        yield pa.RecordBatch.from_arrays([pa.array(mid[keep]), pa.array(member[keep]), pa.array(fresh[keep].astype(bool))], names)


def _edges(graph: DataFrame, forward: int, reverse: int) -> DataFrame:
    """(mid, member, fresh): of each node some of its neighbours and some of the nodes that it is a neighbour of.

    A node that very many name (one with a long vector) keeps `reverse` of a stretch of rows, then `reverse` of each of
    SALTS groups of these, so that what meets it has a bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) // 8 for x in b.column("others").to_pylist()]
            node, other, fresh = np.repeat(b.column("node").to_numpy(), n), _flat(b.column("others"), "<i8"), _flat(b.column("fresh"), "<i1")
            for back, one in ((False, (node, other, fresh, forward)), (True, (other, node, fresh, reverse))):
                for out in _capped(iter([one[:3]]), one[3], ["mid", "member", "fresh"]):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, back))], ["mid", "member", "fresh", "back"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches_of(batches, "slot"):
            slot, member, fresh = t["slot"].to_numpy(), t["member"].to_numpy(), t["fresh"].to_numpy().astype(np.int8)
            mid = dict(zip(slot.tolist(), t["mid"].to_pylist(), strict=True))
            for out in _capped(iter([(slot, member, fresh)]), reverse, ["slot", "member", "fresh"]):
                yield pa.RecordBatch.from_arrays([pa.array([mid[k] for k in out.column(0).to_pylist()], pa.int64()), out.column(1), out.column(2)], ["mid", "member", "fresh"])

    known = graph.select("node", "others", "fresh").mapInArrow(run, "mid long, member long, fresh boolean, back boolean")
    slotted = known.where("back").withColumn("slot", F.xxhash64("mid", F.pmod(F.xxhash64("member"), F.lit(SALTS)))).select("slot", "mid", "member", "fresh")
    thinned = slotted.repartition("slot").sortWithinPartitions("slot").mapInArrow(thin, "mid long, member long, fresh boolean")
    return known.where("not back").select("mid", "member", "fresh").union(thinned)


def _descend(graph: DataFrame) -> DataFrame:
    """One round of NN-descent: members of a node's neighbourhood are compared with each other."""
    near = graph.select(F.col("node").alias("member"), "half", "sims")
    joined = _edges(graph, JOINED, JOINED).join(near, "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            key, other, sim = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, other, sim, _ = _best(key, other, sim, np.zeros(len(key), np.int8), NEIGHBOURS)
            return _lists(key, {"o": other, "s": sim}, ["node", "others", "sims"])

        total = 0
        for t in _batches_of(batches, "mid", 10_000):
            mid, member, fresh = t["mid"].to_numpy(), t["member"].to_numpy(), t["fresh"].to_numpy().astype(bool)
            norm, x = _unpacked(b"".join(t["half"].to_pylist()), len(mid))
            bound = np.array([np.frombuffer(s, "<f8")[-1] if len(s) >= 8 * NEIGHBOURS else -np.inf for s in t["sims"].to_pylist()])
            edge = np.concatenate([[0], np.flatnonzero(np.diff(mid)) + 1, [len(mid)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                own = a + np.argsort(~fresh[a:b], kind="stable")[: 4 * JOINED]
                if len(own) < 2 or not fresh[own].any():
                    continue
                s = (x[own] @ x[own].T) * norm[own]
                i, j = np.nonzero((s > bound[own][:, None]) & (fresh[own][:, None] | fresh[own][None, :]) & (member[own][:, None] != member[own][None, :]))
                held.append((member[own[i]], member[own[j]], s[i, j].astype("<f8")))
                total += len(i)
            if total >= _FLUSH:
                yield flush()
                total = 0
        if held:
            yield flush()

    dealt = joined.select("mid", "member", "fresh", "half", "sims").repartition("mid").sortWithinPartitions("mid")
    return _merge(dealt.mapInArrow(run, "node long, others binary, sims binary"), graph)


def neighbour_graph(nodes: DataFrame, count: int) -> DataFrame:
    """(node, half, others, sims, fresh): packed neighbours of each node, nearest first."""
    nothing = F.lit(b"")
    graph = _merge(_start(nodes, count), nodes.select("node", "half", nothing.alias("others"), nothing.alias("sims")))
    for _ in range(ROUNDS):
        graph = _descend(graph)
    return graph


def _searched(graph: DataFrame) -> DataFrame:
    """(node, near, halves): ids and half-precision vectors of the nodes that a search may go on to from a node."""
    pairs = _edges(graph, NEIGHBOURS, DEGREE // 2).select("mid", "member").join(graph.select(F.col("node").alias("member"), "half"), "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches_of(batches, "mid", 20_000):
            mid, member, halves = t["mid"].to_numpy(), t["member"].to_numpy(), t["half"].to_pylist()
            at = np.lexsort((member, mid))
            new = np.concatenate([[True], (mid[at][1:] != mid[at][:-1]) | (member[at][1:] != member[at][:-1])])
            at = at[new]
            mid, member = mid[at], member[at]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(mid)) + 1, [len(mid)]])
            near, blocks = [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                own = np.arange(a, b)
                if b - a > 2 * DEGREE:  # a hub: its reverse neighbours are thinned by hash
                    own = own[np.argsort((member[a:b].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[: 2 * DEGREE]]
                near.append(member[own].astype("<i8").tobytes())
                blocks.append(b"".join(halves[at[k]] for k in own))
            yield pa.RecordBatch.from_arrays([pa.array(mid[edge[:-1]]), pa.array(near, pa.binary()), pa.array(blocks, pa.binary())], ["node", "near", "halves"])

    return pairs.select("mid", "member", "half").repartition("mid").sortWithinPartitions("mid").mapInArrow(run, "node long, near binary, halves binary")


def _beams(rows: DataFrame) -> DataFrame:
    """(q, half, ids, sims, done) with the BEAM best of all rows of a query; half comes from the row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches_of(batches, "q", 2_000):
            n = [len(x) // 8 for x in t["ids"].to_pylist()]
            q = t["q"].to_numpy()
            half = {k: v for k, v in zip(q.tolist(), t["half"].to_pylist(), strict=True) if v is not None}
            key, other, sim, done = np.repeat(q, n), _flat(t["ids"], "<i8"), _flat(t["sims"], "<f8"), _flat(t["done"], "<i1")
            own = key == other  # the query's own node stays in its beam
            a = _best(key, other, sim, done, BEAM)
            key, other, sim, done = (np.concatenate([x[own], y]) for x, y in zip((key, other, sim, done), a, strict=True))
            at = np.lexsort((-done, other, key))
            key, other, sim, done = key[at], other[at], sim[at], done[at]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])])
            key, other, sim, done = key[new], other[new], sim[new], done[new]
            at = np.lexsort((other, -sim, key))
            key, other, sim, done = key[at], other[at], sim[at], done[at]
            out = _lists(key, {"i": other, "s": sim, "d": done}, ["q", "ids", "sims", "done"])
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array([half[k] for k in out.column(0).to_pylist()], pa.binary()), *out.columns[1:]], ["q", "half", "ids", "sims", "done"])

    return durable(rows.repartition("q").sortWithinPartitions("q").mapInArrow(run, "q long, half binary, ids binary, sims binary, done binary"))


def _unpack(beams: DataFrame, choose: Callable, kinds: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield choose(b)

    return beams.mapInArrow(run, kinds)


def _next(b: pa.RecordBatch) -> pa.RecordBatch:
    """The EXPAND best nodes of each beam that are not expanded yet."""
    rows = []
    for q, half, ids, sims, done in zip(*(b.column(k).to_pylist() for k in ("q", "half", "ids", "sims", "done")), strict=True):
        at = np.flatnonzero(np.frombuffer(done, "<i1") == 0)[:EXPAND]
        s = np.frombuffer(sims, "<f8")
        bound = float(s[-1]) if len(s) > BEAM else -np.inf
        rows += [(n, q, half, bound) for n in np.frombuffer(ids, "<i8")[at].tolist()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.float64()))], ["node", "q", "half", "bound"])


def _expanded(b: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for done in b.column("done").to_pylist():
        d = np.frombuffer(done, "<i1").copy()
        d[np.flatnonzero(d == 0)[:EXPAND]] = 1
        out.append(d.tobytes())
    return pa.RecordBatch.from_arrays([*(b.column(k) for k in ("q", "half", "ids", "sims")), pa.array(out, pa.binary())], ["q", "half", "ids", "sims", "done"])


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each query finds at the nodes it expands: (q, half, ids, sims, done)."""
    held, total = [], 0

    def flush() -> pa.RecordBatch:
        q, node, sim = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        q, node, sim, flag = _best(q, node, sim, np.zeros(len(q), np.int8), BEAM)
        out = _lists(q, {"i": node, "s": sim, "d": flag}, ["q", "ids", "sims", "done"])
        return pa.RecordBatch.from_arrays([out.column(0), pa.nulls(out.num_rows, pa.binary()), *out.columns[1:]], ["q", "half", "ids", "sims", "done"])

    for b in (b.slice(at, VISITED) for b in batches for at in range(0, b.num_rows, VISITED)):
        for near, halves, asks in zip(*(b.column(k).to_pylist() for k in ("near", "halves", "asks")), strict=True):
            ids = np.frombuffer(near, "<i8")
            norm, x = _unpacked(halves, len(ids))
            _, qs = _unpacked(b"".join(a["half"] for a in asks), len(asks))
            s = (qs @ x.T) * norm
            i, j = np.nonzero(s > np.array([a["bound"] for a in asks])[:, None])
            held.append((np.array([a["q"] for a in asks], np.int64)[i], ids[j], s[i, j].astype("<f8")))
            total += len(i)
        if total >= _FLUSH:
            yield flush()
            total = 0
    if held:
        yield flush()


def nearest(vectors: DataFrame, wanted: Column, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): of each wanted row the `top` nearest other rows found, nearest first."""
    nodes, asked = _nodes(vectors, id_col, vec_col, top, wanted)
    graph = neighbour_graph(nodes, nodes.count())
    own = asked.select("node").distinct()
    salts = max(1, own.count() // TOGETHER)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searched = _searched(graph).repartition(parts, "node").persist()

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sims, done = [], [], []
            for node, half, others, near in zip(*(b.column(k).to_pylist() for k in ("node", "half", "others", "sims")), strict=True):
                norm, _ = _unpacked(half, 1)
                ids.append(np.array([node], "<i8").tobytes() + others)
                sims.append(norm.astype("<f8").tobytes() + near)
                done.append(b"\x01" + b"\x00" * (len(others) // 8))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("half"), *(pa.array(v, pa.binary()) for v in (ids, sims, done))], ["q", "half", "ids", "sims", "done"])

    kinds = "q long, half binary, ids binary, sims binary, done binary"
    beams = _beams(own.join(graph.select("node", "half", "others", "sims"), "node").mapInArrow(begin, kinds))
    for _ in range(HOPS):
        # Dealt by node once: the queries at a node are gathered and meet its neighbours where they are.
        frontier = _unpack(beams, _next, "node long, q long, half binary, bound double").repartition(parts, "node")
        asks = frontier.groupBy("node", F.pmod(F.xxhash64("q"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("q", "half", "bound")).alias("asks"))
        met = asks.join(searched, "node").select("near", "halves", "asks").mapInArrow(_visit, kinds)
        beams = _beams(met.union(_unpack(beams, _expanded, kinds)))
    searched.unpersist()

    def last(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(q, n) for q, ids in zip(b.column("q").to_pylist(), b.column("ids").to_pylist(), strict=True) for n in {*np.frombuffer(ids, "<i8")[: 2 * top + 20].tolist(), q}]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["q", "node"])

    pairs = _unpack(beams, last, "q long, node long").join(nodes.select("node", "vec", "ids"), "node").select("q", "node", "vec", "ids")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The top + 1 nearest ids of each query node: its own vector is the row with its own node."""
        for t in _batches_of(batches, "q", 5_000):
            q, node = t["q"].to_numpy(), t["node"].to_numpy()
            x = _flat(t["vec"], "<f8").reshape(len(q), -1)
            ids = t["ids"].to_pylist()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1, [len(q)]])
            out = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                score = x[a:b] @ x[a + int(np.flatnonzero(node[a:b] == q[a])[0])]
                near = sorted((-s, i) for s, own in zip(score.tolist(), ids[a:b], strict=True) for i in own)[: top + 1]
                out.append([{"id": i, "score": -s} for s, i in near])
            kind = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(q[edge[:-1]]), pa.array(out, kind)], ["node", "near"])

    ranked = pairs.repartition("q").sortWithinPartitions("q").mapInArrow(rank, "node long, near array<struct<id:long,score:double>>")
    # A query is not among its own neighbours, but its node's other ids are.
    mine = asked.join(ranked, "node").select("asking", F.slice(F.filter("near", lambda x: x["id"] != F.col("asking")), 1, top).alias("near"))
    out = mine.select("asking", F.posexplode("near").alias("pos", "x"))
    return out.select(F.col("asking").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
