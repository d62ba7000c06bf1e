"""Exact top-k retrieval where the passages lie: lexical, by vector, or both.

Questions are cut into blocks of bounded size, and each block is broadcast. A task scores its passages against a block, some
thousand at a time, as matrices, and hands on the k best of each question, so that what is shuffled is tasks x questions x k
rows, however many passages there are. No pair of a passage and a question leaves its task unless it is among these.

Lexical scores prune by upper bounds. Within a batch of passages the greatest part that a token can add is known. Tokens
are taken by these bounds; those whose bounds together stay below the k-th score so far cannot bring a passage into the
result alone, so only passages that hold one of the others are scored, from the rarest token on, and a batch that cannot
reach the score at all is left at once. Common words, whose bounds are low, so cost nothing once rare ones have set the score.

Passages and questions with a null id take no part. A null text has no tokens, a null vector or one of another length
than the question's no score by vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.sources.tables import durable, stored

#: Public defaults of the lexical score.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Questions of a block; scores that a task holds at once; digits to which scores are compared.
BLOCK, SCORES, DIGITS = 1_024, 2 << 20, 6


def names_of(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as they do."""
    return column.to_numpy(zero_copy_only=False).astype("U") if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


class Foremost:
    """For each slot the first `most` (score, name): higher rounded scores first, then smaller names."""

    def __init__(self, slots: int, most: int):
        self.slots, self.most = slots, most
        self.held: tuple | None = None
        self.floor = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        close = np.round(score, DIGITS)
        fit = close >= self.floor[slot]
        if not fit.any():
            return
        new = (slot[fit], close[fit], name[fit], score[fit])
        slot, close, name, score = new if self.held is None else (np.concatenate(x) for x in zip(self.held, new, strict=True))
        at = np.lexsort((name, -close, slot))
        rank = np.arange(len(at)) - np.searchsorted(slot[at], slot[at])
        at = at[rank < self.most]
        self.held = slot[at], close[at], name[at], score[at]
        full = np.arange(len(at)) - np.searchsorted(slot[at], slot[at]) == self.most - 1
        self.floor[slot[at][full]] = close[at][full]

    def foremost_of(self, scores: np.ndarray, fit: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(slot, column) of the scores (a line for each slot) that may be among the first: none that `most` others of its
        line are above, so that few of a batch are handed on, even while nothing is held yet."""
        close = np.where(fit, np.round(scores, DIGITS), -np.inf)
        least = self.floor
        if close.shape[1] > self.most:
            least = np.fmax(least, -np.partition(-close, self.most - 1, axis=1)[:, self.most - 1])
        return np.nonzero((close >= least[:, None]) & fit)


@dataclass
class Words:
    """The tokens of a block of questions, with the weights that they have there."""

    vocabulary: pa.Array
    #: For each question its tokens (places in the vocabulary) and their weights.
    tokens: list[np.ndarray]
    weights: list[np.ndarray]
    mean_length: float


@dataclass
class Asked:
    """A block of questions."""

    qid: pa.Array
    words: Words | None = None
    vectors: np.ndarray | None = None


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, times, size) of tokenised texts, sorted by token: how often the row, of that size, has the token."""
    sizes = np.diff(texts.offsets.to_numpy()) if texts.null_count == 0 else np.array([len(x) if x is not None else 0 for x in texts.to_pylist()])
    found = pc.index_in(texts.flatten(), vocabulary)
    row = np.repeat(np.arange(len(sizes)), sizes)
    seen = found.is_valid().to_numpy(zero_copy_only=False)
    token = found.filter(pa.array(seen)).to_numpy().astype(np.int64)
    pair, tf = np.unique(token * len(sizes) + row[seen], return_counts=True)
    token, row = pair // max(1, len(sizes)), pair % max(1, len(sizes))
    return token, row, tf, sizes[row]


def parted(count: tuple, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, part) of counted texts: part is what the token adds for a weight of one."""
    token, row, tf, size = count
    return token, row, tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / words.mean_length))


def postings(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return parted(counted(texts, words.vocabulary), words)


def lexical_scores(posted: tuple, words: Words, rows: int) -> np.ndarray:
    """Scores of every question (line) for every row; 0 where they share no token."""
    token, row, part = posted
    edge = np.searchsorted(token, np.arange(len(words.vocabulary) + 1))
    out = np.zeros((len(words.tokens), rows))
    for line, own, weights in zip(out, words.tokens, words.weights, strict=True):
        for t, w in zip(own, weights, strict=True):
            a, b = edge[t], edge[t + 1]
            line[row[a:b]] += w * part[a:b]
    return out


def pruned_scores(posted: tuple, words: Words, rows: int, best: Foremost, names: np.ndarray, prune: bool) -> tuple[int, int]:
    """Add the rows of one batch to `best`; (postings scored, postings of the questions' tokens)."""
    token, row, part = posted
    edge = np.searchsorted(token, np.arange(len(words.vocabulary) + 1))
    top = np.zeros(len(words.vocabulary))
    np.maximum.at(top, token, part)
    joined = whole = 0
    for q, (own, weights) in enumerate(zip(words.tokens, words.weights, strict=True)):
        here = edge[own + 1] > edge[own]
        own, weights = own[here], weights[here]
        if not len(own):
            continue
        whole += int((edge[own + 1] - edge[own]).sum())
        bound = np.maximum(weights, 0) * top[own]
        at = np.argsort(bound, kind="stable")
        own, weights, upto = own[at], weights[at], np.cumsum(bound[at])
        chosen, left, step = np.zeros(rows, bool), len(own), 1
        # From the rarest token on, some more at a time: what they bring raises the score to reach.
        while left > 0 and (not prune or upto[left - 1] >= best.floor[q] - 2 * 10.0**-DIGITS):
            some = own[max(0, left - step) : left]
            left, step = left - len(some), 2 * step
            new = np.unique(np.concatenate([row[edge[t] : edge[t + 1]] for t in some]))
            new = new[~chosen[new]]
            chosen[new] = True
            score = np.zeros(len(new))
            for t, w in zip(own, weights, strict=True):
                held, its = row[edge[t] : edge[t + 1]], part[edge[t] : edge[t + 1]]
                place = np.searchsorted(held, new)
                place[place == len(held)] = 0
                hit = held[place] == new
                score[hit] += w * its[place[hit]]
                joined += int(hit.sum())
            best.add(np.full(len(new), q), score, names[new])
    return joined, whole


def matrix(column: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors as float64, and which rows have a vector of that length."""
    fine = pc.fill_null(pc.equal(pc.list_value_length(column), wide), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), wide))
    if fine.any():
        out[fine] = column.filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
    return out, fine


def weights(passages: DataFrame, questions: DataFrame) -> tuple[DataFrame, float]:
    """((qid, token, weight) of the tokens of questions (qid, text) that some passage (pid, text) has, mean length).

    A token of a question counts as often as it occurs. A token that is in over half of the passages has a negative
    inverse frequency; it counts EPSILON times the mean of all tokens' instead.
    """
    return _weights(passages.select(tokens(F.col("text")).alias("t")), questions)


def _weights(cut: DataFrame, questions: DataFrame) -> tuple[DataFrame, float]:
    """`weights` of passages that are tokenised already (t)."""
    size = cut.agg(F.count("*").alias("n"), F.count("t").alias("texts"), F.sum(F.when(F.col("t").isNotNull(), F.size("t"))).alias("total")).first()
    if not size["texts"]:
        return questions.sparkSession.createDataFrame([], f"qid {questions.schema['qid'].dataType.simpleString()}, token string, weight double"), 1.0
    df = cut.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = durable(df.select("token", (F.log(size["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
    floor = EPSILON * (idf.agg(F.avg("idf")).first()[0] or 0.0)
    asked = questions.select("qid", F.explode(tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("times"))
    weight = F.col("times") * F.when(F.col("idf") < 0, floor).otherwise(F.col("idf"))
    return asked.join(idf, "token").select("qid", "token", weight.alias("weight")), (size["total"] or 0) / size["texts"] or 1.0


def _blocks(questions: DataFrame, weighted: DataFrame | None, mean_length: float) -> Iterator[Asked]:
    """Blocks of at most BLOCK questions; one at a time meets the driver."""
    rows = durable(questions.where("qid is not null").dropDuplicates(["qid"]))
    n = 1
    while True:
        block = F.pmod(F.xxhash64("qid", F.lit("block")), F.lit(n))
        if (rows.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] or 0) <= BLOCK:
            break
        n *= 2
    held = durable(weighted) if weighted is not None else None
    for b in range(n):
        mine = rows.where(block == b).toArrow().sort_by("qid").combine_chunks()  # as blocks of several shares go together
        if not mine.num_rows:
            continue
        asked = Asked(mine["qid"].chunk(0))
        if held is not None:
            t = held.where(block == b).toArrow().combine_chunks()
            vocabulary = pc.unique(t["token"]) if t.num_rows else pa.array([], pa.string())
            line = pc.index_in(t["qid"], asked.qid).to_numpy() if t.num_rows else np.zeros(0, np.int64)
            at = np.argsort(line, kind="stable")
            token = pc.index_in(t["token"], vocabulary).to_numpy()[at].astype(np.int64) if t.num_rows else np.zeros(0, np.int64)
            weight, edge = t["weight"].to_numpy()[at], np.searchsorted(line[at], np.arange(mine.num_rows + 1))
            cut = list(zip(edge[:-1], edge[1:], strict=True))
            asked.words = Words(vocabulary.combine_chunks() if isinstance(vocabulary, pa.ChunkedArray) else vocabulary, [token[i:j] for i, j in cut], [weight[i:j] for i, j in cut], mean_length)
        if "vector" in mine.column_names:
            vectors = mine["vector"].chunk(0)
            wide = pc.max(pc.list_value_length(vectors)).as_py() or 0
            asked.vectors, fine = matrix(vectors, wide)
            asked.vectors[~fine] = np.nan
        yield asked


def _found(best: Foremost, qid: pa.Array, pid: pa.DataType) -> pa.RecordBatch:
    slot, _, name, score = best.held if best.held is not None else (np.zeros(0, np.int64), None, np.zeros(0, "U1") if pa.types.is_string(pid) else np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([qid.take(pa.array(slot)), pa.array(name.tolist(), pid), pa.array(score)], ["qid", "pid", "score"])


def _scored(passages: DataFrame, blocks: Iterator[Asked], task: Callable, kinds: str) -> DataFrame | None:
    """task(block, batches) over all passages for each block; what it hands on, of all blocks."""
    context, out = passages.sparkSession.sparkContext, None
    for block in blocks:
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return task(shared.value, batches)

        found = durable(passages.mapInArrow(run, kinds))
        out = found if out is None else out.union(found)
        shared.unpersist()
    return out


def _kinds(passages: DataFrame, questions: DataFrame) -> str:
    return f"qid {questions.schema['qid'].dataType.simpleString()}, pid {passages.schema['pid'].dataType.simpleString()}, score double"


def _pieces(batches: Iterator[pa.RecordBatch], questions: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(4_096, SCORES // max(1, questions)))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def best(scored: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best of each question with their ranks; scores equal to DIGITS digits go by pid."""
    order = Window.partitionBy(*by).orderBy(F.round("score", DIGITS).desc(), "pid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _or_none(out: DataFrame | None, passages: DataFrame, kinds: str) -> DataFrame:
    return passages.sparkSession.createDataFrame([], kinds) if out is None else out


def lexical_top(passages: DataFrame, questions: DataFrame, k: int, prune: bool = True, counts: bool = False) -> DataFrame:
    """(qid, pid, score, rank) of the k passages (pid, text) that score best for each question (qid, text) and share a token
    with it. counts: instead (joined, whole), how many postings were scored of those of the questions' tokens."""
    weighted, mean_length = weights(passages, questions)
    rows = passages.where("pid is not null").select("pid", tokens(F.col("text")).alias("t"))

    def task(block: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, joined, whole, kind = Foremost(len(block.qid), k), 0, 0, pa.int64()
        for b in _pieces(batches, 1):
            kind = b.column(0).type
            one = pruned_scores(postings(b.column("t"), block.words), block.words, b.num_rows, found, names_of(b.column(0)), prune)
            joined, whole = joined + one[0], whole + one[1]
        yield pa.RecordBatch.from_arrays([pa.array([joined]), pa.array([whole])], ["joined", "whole"]) if counts else _found(found, block.qid, kind)

    kinds = "joined long, whole long" if counts else _kinds(passages, questions)
    out = _or_none(_scored(rows, _blocks(questions.select("qid"), weighted, mean_length), task, kinds), passages, kinds)
    return out.agg(F.sum("joined").alias("joined"), F.sum("whole").alias("whole")) if counts else best(out, k)


def dense_top(passages: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, pid, score, rank) of the k passages (pid, vector) with the greatest inner products for each question (qid, vector)."""

    def task(block: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kind = Foremost(len(block.qid), k), pa.int64()
        for b in _pieces(batches, len(block.qid)):
            kind = b.column(0).type
            x, fine = matrix(b.column("vector"), block.vectors.shape[1])
            scores = block.vectors @ x.T
            q, row = found.foremost_of(scores, fine)
            found.add(q, scores[q, row], names_of(b.column(0))[row])
        yield _found(found, block.qid, kind)

    kinds = _kinds(passages, questions)
    return best(_or_none(_scored(passages.where("pid is not null").select("pid", "vector"), _blocks(questions.select("qid", "vector"), None, 1.0), task, kinds), passages, kinds), k)


def hybrid_top(passages: DataFrame, questions: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """(qid, pid, score, rank): the weighted sum of both scores, each scaled to 0..1 over all passages (pid, text, vector) with
    a vector; a passage that shares no token with the question (qid, text, vector) has the lexical score 0.

    The least and greatest scores of a question are gathered in a first pass, one row for each task and question; the second
    pass scores again, scales and keeps the k best.
    """
    # Every block of questions reads the passages twice: they are tokenised and put together once.
    held = stored(passages.select("pid", tokens(F.col("text")).alias("t"), "vector"))
    weighted, mean_length = _weights(held.select("t"), questions)
    rows = held.where("pid is not null")

    def both(block: Asked, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, fine = matrix(b.column("vector"), block.vectors.shape[1])
        return block.vectors @ x[fine].T, lexical_scores(postings(b.column("t"), block.words), block.words, b.num_rows)[:, fine], fine

    def bounds(block: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((2, len(block.qid)), np.inf), np.full((2, len(block.qid)), -np.inf)
        for b in _pieces(batches, len(block.qid)):
            for i, s in enumerate(both(block, b)[:2]):
                low[i], high[i] = np.minimum(low[i], s.min(1, initial=np.inf)), np.maximum(high[i], s.max(1, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([block.qid, *map(pa.array, (low[0], high[0], low[1], high[1]))], ["qid", "d_low", "d_high", "l_low", "l_high"])

    def task(item: tuple[Asked, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (d_low, d_high, l_low, l_high) = item
        found, kind = Foremost(len(block.qid), k), pa.int64()
        for b in _pieces(batches, len(block.qid)):
            kind = b.column(0).type
            d, lex, fine = both(block, b)
            scores = weight * _scaled(d, d_low, d_high) + (1 - weight) * _scaled(lex, l_low, l_high)
            q, row = found.foremost_of(scores)
            found.add(q, scores[q, row], names_of(b.column(0))[fine][row])
        yield _found(found, block.qid, kind)

    def with_bounds() -> Iterator[tuple[Asked, np.ndarray]]:
        names = list(NAMES)
        qid = questions.schema["qid"].dataType.simpleString()
        for block in _blocks(questions.select("qid", "vector"), weighted, mean_length):
            met = _scored(rows, iter([block]), bounds, f"qid {qid}, " + ", ".join(f"{n} double" for n in names))
            t = met.groupBy("qid").agg(*[(F.min if n.endswith("low") else F.max)(n).alias(n) for n in names]).toArrow()
            at = pc.index_in(block.qid, t["qid"].combine_chunks()).to_numpy()
            yield block, np.stack([t[n].to_numpy()[at] for n in names])

    kinds = _kinds(passages, questions)
    return best(_or_none(_scored(rows, with_bounds(), task, kinds), passages, kinds), k)


# -- one pass for growing corpora ---------------------------------------------------------------------------------
def weights_by_share(passages: DataFrame, questions: DataFrame, shares: list[float]) -> list[tuple[DataFrame, float]]:
    """`weights` of the passages (pid, text, level) whose level is up to each share, from one count of tokens by level.

    Document frequencies, lengths and numbers of passages of a share are those of the levels up to it, added up.
    """
    return _weights_by_share(passages.select("level", tokens(F.col("text")).alias("t")), questions, shares)


def _weights_by_share(cut: DataFrame, questions: DataFrame, shares: list[float]) -> list[tuple[DataFrame, float]]:
    """`weights_by_share` of passages that are tokenised already (t, level)."""
    level = F.col("level")
    sizes = cut.groupBy("level").agg(F.count("*").alias("n"), F.count("t").alias("texts"), F.sum(F.when(F.col("t").isNotNull(), F.size("t"))).alias("total")).collect()  # a row for each level
    counted = cut.select("level", F.explode(F.array_distinct("t")).alias("token")).groupBy("token", "level").agg(F.count("*").alias("n"))
    upto = [F.sum(F.when(level <= s, F.col("n")).otherwise(0)).alias(f"df{i}") for i, s in enumerate(shares)]
    df = durable(counted.groupBy("token").agg(*upto))
    asked = questions.select("qid", F.explode(tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("times"))
    met, out = durable(asked.join(df, "token")), []
    totals = [[sum(r[c] or 0 for r in sizes if r["level"] <= s) for c in ("n", "texts", "total")] for s in shares]
    idf = [F.when(F.col(f"df{i}") > 0, F.log(t[0] - F.col(f"df{i}") + 0.5) - F.log(F.col(f"df{i}") + 0.5)) for i, t in enumerate(totals)]
    floors = df.agg(*[F.avg(x).alias(f"f{i}") for i, x in enumerate(idf)]).first()
    for i, (_, texts, total) in enumerate(totals):
        weight = F.col("times") * F.when(idf[i] < 0, EPSILON * (floors[i] or 0.0)).otherwise(idf[i])
        out.append((met.where(F.col(f"df{i}") > 0).select("qid", "token", weight.alias("weight")), total / texts if texts and total else 1.0))
    return out


def sweep_top(passages: DataFrame, questions: DataFrame, k: int, shares: list[float], weight: float = 0.5) -> DataFrame:
    """(system, share, qid, pid, score, rank): the k best passages (pid, text, vector, level) for questions (qid, text, vector) by
    the systems "lexical", "vector" and "hybrid", at each share of the passages: those whose level is up to it.

    Texts are cut once. Two passes over their tokens, which are looked up and counted once in each, serve all shares and
    systems together: one for the bounds that scale the scores, one that scores.
    """
    held = stored(passages.select("pid", tokens(F.col("text")).alias("t"), "vector", F.col("level").cast("double").alias("level")))
    rows = held.where("pid is not null")
    weighted = _weights_by_share(held.select("level", "t"), questions, shares)
    qid, pid = (df.schema[c].dataType.simpleString() for df, c in ((questions, "qid"), (passages, "pid")))

    def scores(blocks: list[Asked], near: np.ndarray, fine: np.ndarray, count: tuple, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each share the scores by vector and by words of the passages that take part, and which these are."""
        level = b.column("level").to_numpy(zero_copy_only=False)
        for block, share in zip(blocks, shares, strict=True):
            there = level <= share
            yield near[:, fine & there], lexical_scores(parted(count, block.words), block.words, b.num_rows)[:, there], there

    def met(blocks: list[Asked], b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple]:
        x, fine = matrix(b.column("vector"), blocks[0].vectors.shape[1])
        return blocks[0].vectors @ x.T, fine, counted(b.column("t"), blocks[0].words.vocabulary)

    def bounds(blocks: list[Asked], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((len(shares), 2, len(blocks[0].qid)), np.inf), np.full((len(shares), 2, len(blocks[0].qid)), -np.inf)
        for b in _pieces(batches, len(blocks[0].qid)):
            near, fine, count = met(blocks, b)
            for i, (d, lex, there) in enumerate(scores(blocks, near, fine, count, b)):
                for j, s in enumerate((d, lex[:, fine[there]])):
                    low[i, j], high[i, j] = np.minimum(low[i, j], s.min(1, initial=np.inf)), np.maximum(high[i, j], s.max(1, initial=-np.inf))
        for i in range(len(shares)):
            yield pa.RecordBatch.from_arrays([blocks[0].qid, pa.array(np.full(len(blocks[0].qid), i), pa.int32()), *map(pa.array, (low[i, 0], high[i, 0], low[i, 1], high[i, 1]))], ["qid", "i", *NAMES])

    def task(item: tuple[list[Asked], np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, edges = item
        n, kind = len(blocks[0].qid), pa.int64()
        found = [[Foremost(n, k) for _ in SYSTEMS] for _ in shares]
        for b in _pieces(batches, n):
            kind, names = b.column(0).type, names_of(b.column(0))
            near, fine, count = met(blocks, b)
            # A token of a passage is known at every share at which the passage takes part.
            shares_one = _sharing(count, blocks, b.num_rows)
            for i, (d, lex, there) in enumerate(scores(blocks, near, fine, count, b)):
                both = fine[there]
                d_low, d_high, l_low, l_high = edges[i]
                mixed = weight * _scaled(d, d_low, d_high) + (1 - weight) * _scaled(lex[:, both], l_low, l_high)
                for best_of, s, fit, own in zip(found[i], (lex, d, mixed), (shares_one[:, there], True, True), (names[there], names[there][both], names[there][both]), strict=True):
                    q, row = best_of.foremost_of(s, fit)
                    best_of.add(q, s[q, row], own[row])
        for share, of_share in zip(shares, found, strict=True):
            for system, best_of in zip(SYSTEMS, of_share, strict=True):
                out = _found(best_of, blocks[0].qid, kind)
                yield pa.RecordBatch.from_arrays([pa.array([system] * out.num_rows, pa.string()), pa.array(np.full(out.num_rows, share)), *out.columns], ["system", "share", "qid", "pid", "score"])

    def items() -> Iterator[tuple[list[Asked], np.ndarray]]:
        for blocks in map(_together, zip(*[_blocks(questions.select("qid", "vector"), w, m) for w, m in weighted], strict=True)):
            edge = _scored(rows, iter([blocks]), bounds, f"qid {qid}, i int, " + ", ".join(f"{n} double" for n in NAMES))
            t = edge.groupBy("i", "qid").agg(*[(F.min if n.endswith("low") else F.max)(n).alias(n) for n in NAMES]).toArrow()
            edges = []
            for i in range(len(shares)):
                own = t.filter(pc.equal(t["i"], i)).combine_chunks()
                at = pc.index_in(blocks[0].qid, own["qid"].combine_chunks()).to_numpy()
                edges.append(np.stack([own[n].to_numpy()[at] for n in NAMES]))
            yield blocks, np.stack(edges)

    kinds = f"system string, share double, qid {qid}, pid {pid}, score double"
    return best(_or_none(_scored(rows, items(), task, kinds), passages, kinds), k, ("system", "share", "qid"))


SYSTEMS = ("lexical", "vector", "hybrid")
NAMES = ("d_low", "d_high", "l_low", "l_high")


def _scaled(s: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    span = (high - low)[:, None]
    return np.divide(s - low[:, None], span, out=np.zeros_like(s), where=span > 0)


def _together(blocks: tuple[Asked, ...]) -> list[Asked]:
    """The same questions at several shares, with one vocabulary."""
    vocabulary = pc.unique(pa.concat_arrays([b.words.vocabulary for b in blocks]))
    for b in blocks:
        at = pc.index_in(b.words.vocabulary, vocabulary).to_numpy()
        b.words = Words(vocabulary, [at[t].astype(np.int64) for t in b.words.tokens], b.words.weights, b.words.mean_length)
    return list(blocks)


def _sharing(count: tuple, blocks: list[Asked], rows: int) -> np.ndarray:
    """Whether a question (line) and a row share a token that is known at some share."""
    token, row, _, _ = count
    edge = np.searchsorted(token, np.arange(len(blocks[0].words.vocabulary) + 1))
    out = np.zeros((len(blocks[0].qid), rows), bool)
    for line, *own in zip(out, *[b.words.tokens for b in blocks], strict=True):
        for t in np.unique(np.concatenate(own)):
            line[row[edge[t] : edge[t + 1]]] = True
    return out
