"""N-gram Jaccard self-join: sets of word n-grams in prefix trees, traversed with shared partial overlaps.

Two texts link when the Jaccard similarity of their n-gram sets reaches a threshold (an exact ratio). The join runs in
five steps, none of which makes pairs of rows:

1. Every text becomes a set of 64-bit n-gram hashes; texts with equal sets (128-bit fingerprints) form a class.
2. Of a set that links, at least l = n / SPARE of the first n - ceil(t n) + l + 1 n-grams in hash order are also among
   the first ones of each set that it links with (one more than l, as lengths and so l may differ by rounding). Those prefixes are dealt by n-gram, and a set stays only if so many of
   its n-grams meet another set of fitting length. Most sets have too few n-grams in common with anything and go here.
3. The sets that stay are put in a global order with common n-grams last (at most `MOST_COMMON` of them are sent to the
   tasks: the order only has to be the same everywhere, so what is left out costs time, never links). Linked sets share
   an n-gram among the first n - ceil(t n) + 1 of it; sets with a common one and fitting lengths are chained, and the
   chains' connected components are candidate clusters: every link lies inside one. Clusters too large for one block
   are chained anew by runs of n-grams that stand next to each other in the order: with x and y n-grams and an overlap o
   two sets share at least (2k - 1) o - (k - 1) (x + y + 1) runs of k, so that sets which have only single n-grams in
   common by chance, as long texts do, come apart without losing a link.
4. Each cluster's sets are dealt, in blocks of bounded size if need be, as pairs of blocks. A task puts one block in a
   compressed prefix tree and traverses it with all sets of the other block at once; the overlap with a path is
   worked out once for all sets below it, and a subtree is left when what remains of lengths cannot reach the threshold.
5. Links are counted per class where they are found, and only a spanning forest of them is kept; connected components
   of the forests give the component ids.

Words are runs of non-space characters of the text in lower case (A-Z). Fewer words than n: the whole sequence is one
n-gram. Null, empty or blank texts have an empty set: no links, their own doc_id as component. Very long texts: whole, in
blocks of bytes. Null doc_id: a row like any other that links and bridges, but names no component (null if it links with
no row that has an id). An id with several texts: each is a row. Repeated rows and equal texts link with each other.
Empty tables: no rows. Other columns are ignored, whatever their names. Links count rows, the row itself not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import commonest, components, durable, few, forest

#: N-grams sent to the tasks to come last in the order (16 bytes each), and how often a stretch of sets must have one.
MOST_COMMON, OFTEN = 250_000, 2
#: A set stays if one in SPARE of its n-grams, of a prefix longer by as many, meets another set.
SPARE = 12
#: N-grams in one block of a cluster, and entries that a task gathers before it hands them on.
BLOCK, FLUSH = 100_000, 500_000
BUCKETS = 4096

_BASE = np.uint64(6364136223846793005)
_BACK = np.uint64(pow(6364136223846793005, -1, 2**64))
_LETTER = np.random.default_rng(20_240_229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            line = np.full(2 * n, base, np.uint64)
            line[0] = 1
            _POWERS[k] = np.cumprod(line)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text: a rolling polynomial of its bytes, mixed."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    up, down = _powers(len(line) + 1)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(_LETTER[line] * up[: len(line)], out=sums[1:])
    ends = np.flatnonzero(line == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    return np.unique(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = int(s.sum(dtype=np.uint64)), int(mixed(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
    return tuple(x - 2**64 if x >= 2**63 else x for x in (a, b))


def _prefix(n: int, num: int, den: int, more: int = 1) -> int:
    return min(n, n + n * -num // den + more)


class _Order:
    """The global order: n-grams that are not common by hash, then the common ones by count and hash."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        at = np.argsort(grams)
        self.grams, self.counts = grams[at], counts[at]

    def first(self, s: np.ndarray, k: int) -> np.ndarray:
        if not len(self.grams):
            return s[:k]
        at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
        common = self.grams[at] == s
        rare = s[~common]
        if len(rare) >= k:
            return rare[:k]
        rest = s[common]
        return np.concatenate([rare, rest[np.lexsort((rest, self.counts[at[common]]))][: k - len(rare)]])


def _describe(n: int):
    """Rows (text, id and others) without the text, with (size, f1, f2) of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(len(s), *_fingerprint(s)) for s in (ngram_set(text.as_py(), n) for text in batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([t[k] for t in told], pa.int64()) for k in range(3))], [*batch.schema.names[1:], "size", "f1", "f2"])

    return run


def _chain(gram: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int):
    """Entries by n-gram and length, and which of them follow one with the same n-gram and a length that fits."""
    at = np.lexsort((low, gram))
    gram, node, low, high = gram[at], node[at], low[at], high[at]
    first = np.concatenate([[True], gram[1:] != gram[:-1]])
    # The greatest length so far of the same n-gram: lengths are added to a step that grows with each n-gram.
    step = np.cumsum(first).astype(np.int64) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(step + high) - step
    tied = np.concatenate([[False], ~first[1:] & (reach[:-1] * den >= low[1:] * num)])
    return gram, node, low, np.maximum(reach, high), tied


class _Gathered:
    """Prefix entries of a stretch of different sets, handed on as blocks by bucket of the n-gram.

    Entries of one n-gram in a stretch are chained first, and only the ends of chains are handed on: however common an
    n-gram is, a stretch sends few entries of it.
    """

    NAMES = ("bucket", "grams", "nodes", "low", "more", "lone")
    KINDS = "bucket int, grams binary, nodes binary, low binary, more binary, lone binary"

    def __init__(self, num: int, den: int, buckets: int):
        self.num, self.den, self.buckets = num, den, buckets
        self.clear()

    def clear(self):
        self.grams, self.nodes, self.sizes, self.seen, self.total = [], [], [], set(), 0

    def add(self, node: int, size: int, grams: np.ndarray):
        if node not in self.seen:
            self.seen.add(node)
            self.grams.append(grams)
            self.nodes.append(node)
            self.sizes.append(size)
            self.total += len(grams)

    def flush(self, counting: bool) -> Iterator[pa.RecordBatch]:
        """Rows of bucket -1 hold what the stretch knows by itself: counts of entries that met one, or ties of nodes."""
        if not self.grams:
            return
        each = [len(g) for g in self.grams]
        size, node = np.repeat(np.array(self.sizes, np.int64), each), np.repeat(np.array(self.nodes, np.int64), each)
        gram, node, low, reach, tied = _chain(np.concatenate(self.grams), node, size, size, self.num, self.den)
        heads = np.flatnonzero(~tied)
        last = np.concatenate([heads[1:], [len(gram)]]) - 1
        lone = heads == last
        if counting:
            met = np.ones(len(gram), bool)
            met[heads[lone]] = False
            own, counts = np.unique(node[met], return_counts=True)
        else:
            own, counts = forest(node[heads][np.cumsum(~tied) - 1][tied], node[tied])
        gram, node, low, reach = gram[heads], node[heads], low[heads], reach[last]
        bucket = (gram >> np.uint64(40)) % np.uint64(self.buckets)
        parts = np.split(at := np.argsort(bucket, kind="stable"), np.flatnonzero(np.diff(bucket[at])) + 1)
        pack = lambda x, kind: pa.array([x[p].astype(kind).tobytes() for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pack(gram, "<u8"), pack(node, "<i8"), pack(low, "<u4"), pack(reach - low, "<u4"), pack(lone, "<i1")], self.NAMES)
        if len(own):
            one = lambda x: pa.array([x.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), one(own), one(counts), *[pa.array([b""], pa.binary())] * 3], self.NAMES)
        self.clear()


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(F.when(F.col("bucket") < 0, F.xxhash64("grams")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[tuple]:
    """Chained entries of each bucket: (node, tied, lone); of a row of bucket -1: (first array, second array, None)."""

    def joined(rows: list[dict]):
        read = lambda key, kind: np.concatenate([np.frombuffer(x[key], kind) for x in rows])
        low = read("low", "<u4").astype(np.int64)
        index = np.arange(len(low))
        _, index, _, _, tied = _chain(read("grams", "<u8"), index, low, low + read("more", "<u4"), num, den)
        return read("nodes", "<i8")[index], tied, read("lone", "<i1")[index].astype(bool)

    held, bucket = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                yield np.frombuffer(row["grams"], "<i8"), np.frombuffer(row["nodes"], "<i8"), None
                continue
            if held and row["bucket"] != bucket:
                yield joined(held)
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield joined(held)


def _meetings(texts: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """(node, met): how many n-grams of a set's longer prefix meet those of a set of fitting length."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered(num, den, buckets)
        for batch in batches:
            for text in batch.column(0):
                if len(s := ngram_set(text.as_py(), n)):
                    held.add(_fingerprint(s)[0], len(s), s[: _prefix(len(s), num, den, max(1, len(s) // SPARE) + 1)].copy())
                if held.total >= FLUSH:
                    yield from held.flush(counting=True)
        yield from held.flush(counting=True)

    def added(nodes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate(nodes), return_inverse=True)
        return own, np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the buckets of a partition know of each node, packed by ranges of nodes."""
        nodes, counts, held = [], [], 0
        for node, tied, lone in _buckets(batches, num, den):
            if lone is None:
                nodes.append(node)
                counts.append(tied)
            else:
                nodes.append(node[lone & (tied | np.concatenate([tied[1:], [False]]))])
                counts.append(np.ones(len(nodes[-1]), np.int64))
            held += len(nodes[-1])
            if held >= FLUSH:
                yield from packed(*added(nodes, counts))
                nodes, counts, held = [], [], 0
        if nodes:
            yield from packed(*added(nodes, counts))

    def packed(own: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (own.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets // 4)
        runs = np.split(at := np.argsort(part, kind="stable"), np.flatnonzero(np.diff(part[at])) + 1) if len(own) else []
        pack = lambda x: pa.array([x[r].astype("<i8").tobytes() for r in runs], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([int(part[r[0]]) for r in runs], pa.int32()), pack(own), pack(met)], ["part", "nodes", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each range of nodes; a range is small, as there are several for each shuffle partition."""
        held, part = [], None

        def flush() -> pa.RecordBatch:
            own, met = added([np.frombuffer(r["nodes"], "<i8") for r in held], [np.frombuffer(r["counts"], "<i8") for r in held])
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(met)], ["node", "met"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != part:
                    yield flush()
                    held = []
                part = row["part"]
                held.append(row)
        if held:
            yield flush()

    blocks = texts.select("text").mapInArrow(gather, _Gathered.KINDS)
    parts = _dealt(blocks).mapInArrow(count, "part int, nodes binary, counts binary")
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(total, "node long, met long")


def _first_grams(num: int, den: int, order) -> Callable[[np.ndarray, int], np.ndarray]:
    return lambda s, _: order.value.first(s, _prefix(len(s), num, den))


def _first_runs(num: int, den: int, order) -> Callable[[np.ndarray, int], np.ndarray]:
    """Signatures of sets of one cluster: runs of k n-grams in the order, as many of the first ones as a link needs.

    k is the greatest for which linked sets of a length must share runs. Sets too short for that (and those that such
    sets may link with) give single n-grams.
    """
    k = next(k for k in count(1) if (2 * k + 1) * num <= k * (num + den))
    gain = (2 * k - 1) * num - (k - 1) * (num + den)

    def shared(x: int) -> int:
        return -(-(x - x * -num // den) * gain // (num + den)) - (k - 1)

    least = next(x for x in count(1) if shared(x) >= 1)

    def signatures(s: np.ndarray, cluster: int) -> np.ndarray:
        x, line, out = len(s), order.value.first(s, len(s)), []
        if x >= least:
            m = x - k + 1
            runs = line[:m]
            for i in range(1, k):
                runs = mixed(runs * _BASE + line[i : m + i])
            out.append(runs[: m - shared(x) + 1])
        if x * num < least * den:
            out.append(line[: _prefix(x, num, den)])
        return mixed(np.concatenate(out) ^ mixed(np.array([cluster], np.int64).view(np.uint64)))

    return signatures


def _clusters(sets: DataFrame, num: int, den: int, signatures: Callable[[np.ndarray, int], np.ndarray], buckets: int, nodes: int) -> DataFrame:
    """(node, component) of sets (key, grams, cluster) that have a signature in common; nodes are keys."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered(num, den, buckets)
        for batch in batches:
            for key, grams, cluster in zip(*batch.columns, strict=True):
                s = np.frombuffer(grams.as_buffer(), "<u8")
                held.add(key.as_py(), len(s), signatures(s, cluster.as_py()).copy())
                if held.total >= FLUSH:
                    yield from held.flush(counting=False)
        yield from held.flush(counting=False)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, tied, lone in _buckets(batches, num, den):
            if lone is None:
                a, b = node, tied
            else:
                a, b = forest(node[np.flatnonzero(~tied)][np.cumsum(~tied) - 1][tied], node[tied])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return components(_dealt(sets.select("key", "grams", "cluster").mapInArrow(gather, _Gathered.KINDS)).mapInArrow(tie, "a long, b long"), nodes)


def trie_links(tree: list[np.ndarray], asked: list[np.ndarray], tree_sizes: np.ndarray, asked_sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of the tree, which of the asked sets reach the threshold with it.

    Sets are sorted ranks of n-grams; sizes count n-grams that are left out of them, because no other set has them, too.
    An overlap o of sets of x and y n-grams links them when o (num + den) >= num (x + y).
    """
    lines = sorted(range(len(tree)), key=lambda i: tree[i].tolist())
    postings_at = np.argsort(np.concatenate([*asked, np.zeros(0, np.int64)]), kind="stable")
    owner = np.repeat(np.arange(len(asked)), [len(a) for a in asked])[postings_at]
    grams = np.concatenate([*asked, np.zeros(0, np.int64)])[postings_at]
    top = int(max([t[-1] for t in tree if len(t)] + [grams[-1] if len(grams) else 0])) + 2
    edge = np.searchsorted(grams, np.arange(top + 1))

    def overlap(part: np.ndarray) -> np.ndarray:
        """Of each asked set with a stretch of a path."""
        got = [owner[edge[g] : edge[g + 1]] for g in part]
        return np.bincount(np.concatenate(got), minlength=len(asked)) if got else np.zeros(len(asked), np.int64)

    # Lengths of the common starts of neighbouring lines say where the tree branches.
    common = np.zeros(len(lines) + 1, np.int64)
    for k in range(1, len(lines)):
        a, b = tree[lines[k - 1]], tree[lines[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        common[k] = differ[0] if len(differ) else m
    lengths = np.array([len(tree[i]) for i in lines], np.int64)
    sizes = tree_sizes[lines]
    room = np.array([len(a) for a in asked], np.int64)

    stack = [(0, len(lines), 0, np.zeros(len(asked), np.int64))]
    while stack:
        low, high, depth, before = stack.pop()
        if high <= low:
            continue
        inner = common[low + 1 : high]
        to = int(inner.min()) if len(inner) else int(lengths[low])
        path = tree[lines[low]][depth:to]
        now = before + overlap(path) if len(path) else before
        # What is left of the longest path below, and of each asked set, bounds the overlap that can still come.
        left = np.minimum(room - now, int(lengths[low:high].max()) - to)
        alive = (now + left) * (num + den) >= num * (int(sizes[low:high].min()) + asked_sizes)
        if not alive.any():
            continue
        if not len(inner) or to == lengths[low:high].max():
            for k in range(low, high):
                fits = now * (num + den) >= num * (sizes[k] + asked_sizes)
                yield lines[k], np.flatnonzero(fits)
            continue
        cuts = [low, *(low + 1 + np.flatnonzero(inner == to)), high]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            stack.append((a, b, to, now))


def _verify(num: int, den: int):
    """Link counts and spanning forests of pairs of blocks; rows come sorted by (cluster, x, y), in runs."""

    def one(rows: list[dict]) -> pa.RecordBatch:
        x, y = rows[0]["x"], rows[0]["y"]
        sets = [np.frombuffer(r["grams"], "<u8") for r in rows]
        every, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Commonest first, so that paths are shared; n-grams of one set only can never overlap.
        rank = np.empty(len(every), np.int64)
        rank[np.lexsort((every, -counts))] = np.arange(len(every))
        keep = counts > 1
        parts = np.split(at, np.cumsum([len(s) for s in sets])[:-1])
        lines = [np.sort(rank[p[keep[p]]]) for p in parts]
        sizes = np.array([len(s) for s in sets], np.int64)
        weight = np.array([r["copies"] for r in rows], np.int64)
        block = np.array([r["block"] for r in rows])
        mine, theirs = np.flatnonzero(block == x), np.flatnonzero(block == y)
        links, ends = np.zeros(len(rows), np.int64), []
        for i, fit in trie_links([lines[k] for k in mine], [lines[k] for k in theirs], sizes[mine], sizes[theirs], num, den):
            a, b = mine[i], theirs[fit]
            b = b[b != a]
            if not len(b):
                continue
            links[a] += weight[b].sum()
            if x != y:
                links[b] += weight[a]
            ends.append((np.full(len(b), a), b))
            if len(ends) > 200:
                ends = [forest(*(np.concatenate(z) for z in zip(*ends, strict=True)))]
        a, b = forest(*(np.concatenate(z) for z in zip(*ends, strict=True))) if ends else (np.zeros(0, np.int64),) * 2
        root = np.arange(len(rows))
        root[a] = b
        key = np.array([r["key"] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(links), pa.array(key[root])], ["key", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for row in batch.slice(at, 200).to_pylist():
                    if held and (row["cluster"], row["x"], row["y"]) != key:
                        yield one(list(held.values()))
                        held = {}
                    key = row["cluster"], row["x"], row["y"]
                    # A set is held once; sets that a first fingerprint alone put together are told apart by the second.
                    held.setdefault((row["block"], row["f1"], row["f2"]), row)
        if held:
            yield one(list(held.values()))

    return run


def _sets(n: int, names: list[str], kinds: list[str]):
    """Rows (text, f1, f2 and others) whose text has that set, without the text, each set once in a task, with its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets, own = [], []
                for text, a, b in zip(part.column("text"), part.column("f1").to_pylist(), part.column("f2").to_pylist(), strict=True):
                    s = ngram_set(text.as_py(), n)
                    fits = (a, b) not in seen and _fingerprint(s) == (a, b)  # an id may stand on several texts
                    own.append(fits)
                    sets.append(s.tobytes() if fits else b"")
                    if fits:
                        seen.add((a, b))
                whole = pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(sets, pa.binary())], [*names, "grams"])
                yield whole.filter(pa.array(own, pa.bool_()))

    return run, ", ".join([f"{k} {t}" for k, t in zip(names, kinds, strict=True)] + ["grams binary"])


def _without_ids(texts: DataFrame, n: int, stay: DataFrame) -> DataFrame:
    """The sets of classes of which no row has an id: from the texts without ids, each set once in a task, met by fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for text in batch.column(0):
                s = ngram_set(text.as_py(), n)
                if len(s) and (key := _fingerprint(s)) not in seen:
                    seen.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["f1", "f2", "grams"])

    found = texts.where("id is null").select("text").mapInArrow(run, "f1 long, f2 long, grams binary")
    met = found.join(stay.where("rep is null"), ["f1", "f2"])
    return met.groupBy("key", "f1", "f2", "size", "copies").agg(F.first("grams").alias("grams"))


def _common_last(sets: DataFrame):
    """A broadcast order of n-grams: those that stretches of the sets repeat come last, by their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            keep = counts >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["gram", "n"])

        for batch in batches:
            for grams in batch.column(0):
                held.append(np.frombuffer(grams.as_buffer(), "<u8"))
                total += len(held[-1])
                if total >= 4 * FLUSH:
                    yield flush()
                    total = 0
        yield flush()

    counted = sets.select("grams").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = commonest(counted, MOST_COMMON).toArrow()
    return sets.sparkSession.sparkContext.broadcast(_Order(top["gram"].to_numpy().view(np.uint64), top["n"].to_numpy()))


def similar_documents(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id_col, keep columns, n_shingles, component_id, n_links, n_copies, component_key): one row for each row of docs.

    threshold: numerator and denominator of the least Jaccard similarity. n_links: rows it links with; n_copies: rows
    with the same set, itself included. component_key: a number of the component that rows without ids have, too; null
    for empty sets. Clusters of near copies are compared set by set, so that their cost grows with the square of the
    number of different sets in a cluster; their copies are counted, not compared.
    """
    num, den = threshold
    spark = docs.sparkSession
    kept = [f"_{k}" for k in range(len(keep))]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(k).alias(x) for k, x in zip(keep, kept, strict=True)])
    kinds = "".join(f", {x} {texts.schema[x].dataType.simpleString()}" for x in kept)
    rows = durable(texts.select("text", "id", *kept).mapInArrow(_describe(n), f"id long{kinds}, size long, f1 long, f2 long"))
    # A class is named by its smallest id; null ids take no part in naming.
    classes = rows.where("size > 0").groupBy("f1", "f2", "size").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    many = rows.count()
    classes = durable(few(classes, many).withColumn("key", F.monotonically_increasing_id()))
    buckets = max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    met = _meetings(texts, n, num, den, buckets).withColumnRenamed("node", "f1")
    enough = F.col("met") >= F.greatest(F.lit(1), F.floor(F.col("size") / SPARE))
    columns = ["key", "f1", "f2", "size", "copies"]
    stay = durable(few(classes.join(met, "f1").where(enough).select("rep", *columns), many))
    read, kinds = _sets(n, columns, ["long"] * 5)
    named = texts.select(F.col("id").alias("rep"), "text").join(stay, "rep").mapInArrow(read, kinds)
    sets = durable(named.unionByName(_without_ids(texts, n, stay)))

    order = _common_last(sets)

    def weighed(found: DataFrame) -> DataFrame:
        """(key, f1, f2, cluster, blocks)."""
        member = found.select(F.col("node").alias("key"), F.col("component").alias("cluster")).join(classes.select("key", "f1", "f2", "size"), "key")
        weights = member.groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
        return durable(few(member.join(weights, "cluster").select("key", "f1", "f2", "cluster", "blocks"), many))

    coarse = weighed(_clusters(sets.withColumn("cluster", F.lit(0).cast("long")), num, den, _first_grams(num, den, order), buckets, many))
    large = sets.join(coarse.where("blocks > 1").select("key", "cluster"), "key")
    fine = weighed(_clusters(large, num, den, _first_runs(num, den, order), buckets, many))
    member = coarse.where("blocks = 1").union(fine)
    placed = member.select("key", "cluster", "blocks", F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.join(placed, "key").withColumn("o", other).withColumn("x", F.least("block", "o")).withColumn("y", F.greatest("block", "o")).select("key", "f1", "f2", "copies", "grams", "cluster", "block", "x", "y")
    checked = durable(pairs.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(_verify(num, den), "key long, links long, other long"))

    linked = checked.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("key").alias("a"), F.col("other").alias("b")), many).withColumnRenamed("node", "key")
    named = classes.join(joined, "key", "left").join(linked, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("f1", "f2", "size", "copies", "least", "component", F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.join(named, ["f1", "f2", "size"], "left")
    return out.select(
        F.col("id").alias(id_col), *[F.col(x).alias(k) for k, x in zip(keep, kept, strict=True)], F.col("size").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), F.col("component").alias("component_key"),
    )
