"""Language identification by words first, backing off to shorter and shorter character n-grams for unseen words.

Learning counts every word of every labelled text, and every n-gram of these words, per language. All counts stay, in
tables in the checkpoint folder; log frequencies per language are smoothed over all learnt words (n-grams of a length).
A learnt word adds its own log frequencies; a word never learnt those of its longest n-grams that were learnt, on
average. The best sum wins, ties go to the first name. `MOST_WORDS` and `MOST_GRAMS` (of each length) only say how many
of the commonest ones workers hold; a block's other words are joined with the tables, with the same result.

Null text or no letter: `und` with score 0. Null labels are not learnt from. No labelled rows: all are `und`. Repeated
rows count as often as they occur. Very long texts: read whole. Empty tables: no rows. Null ids and other columns,
whatever their names, take no part in learning or prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import commonest, stored

MOST_WORDS, MOST_GRAMS, LENGTHS, SMOOTH = 400_000, 20_000, (5, 4, 3, 2, 1), 0.5
#: Letters of the longest word, and numbers of all words together, that a worker holds: with many languages, fewer words.
LONGEST, NUMBERS = 48, 4_000_000
#: Different words to be looked up and texts of a block that is scored together.
BLOCK_WORDS, BLOCK_TEXTS = 50_000, 5_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if there is no letter."""
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def word_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all rows, summed for stretches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > 300_000:
                yield flush()
        yield flush()

    return labelled.select(text_col, lang_col).where(F.col(lang_col).isNotNull()).mapInArrow(run, "lang string, word string, n long")


class Model:
    """Log frequencies per language of the commonest words and n-grams; small enough to send to every worker."""

    def __init__(self, langs: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[int, tuple[dict[str, int], np.ndarray]]):
        self.langs, self.words, self.word_logs, self.grams = langs, words, word_logs, grams


class Learnt(NamedTuple):
    """What workers hold, and the tables (word, logs) and (gram, logs) of all that was learnt."""

    model: Model
    words: DataFrame | None
    grams: DataFrame | None


def _cut(padded: Column, long: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(long + 1 - size, F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))


def _logs(counts: list[Column], totals: list[int], rows: int) -> Column:
    return F.array(*[F.log((c + SMOOTH) / F.lit(float(t + SMOOTH * max(1, rows)))) for c, t in zip(counts, totals, strict=True)])


def _held(table: DataFrame, key: str, most: int, langs: int) -> tuple[dict[str, int], np.ndarray]:
    """The commonest keys, at most `most`, with the row of their log frequencies."""
    top = commonest(table, most).select(key, "logs").toArrow()
    flat = np.array(pa.concat_arrays([c.flatten() for c in top["logs"].chunks] or [pa.array([], pa.float64())]), np.float64)
    return {k: n for n, k in enumerate(top[key].to_pylist())}, flat.reshape(top.num_rows, langs)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Learnt:
    named = sorted(r[0] for r in labelled.select(lang_col).where(F.col(lang_col).isNotNull()).distinct().collect())
    per = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{k}") for k, x in enumerate(named)]
    counts = stored(word_counts(labelled, text_col, lang_col).groupBy("word").agg(*per)) if named else None
    cols = [f"l{k}" for k in range(len(named))]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]
    of = counts.agg(F.count("*").alias("rows"), *sums).first() if named else None
    cols = [c for c in cols if of[c]]
    langs = [named[int(c[1:])] for c in cols]
    if not langs:
        return Learnt(Model([], {}, np.zeros((0, 0)), {}), None, None)
    n = sum((F.col(c) for c in cols), F.lit(0)).alias("n")
    words = counts.select("word", n, _logs([F.col(c) for c in cols], [of[c] for c in cols], of["rows"]).alias("logs"))
    padded, long = F.concat(F.lit(" "), F.col("word"), F.lit(" ")), F.length("word") + 2
    cut = [F.when(long >= m, _cut(padded, long, m)).otherwise(F.array().cast("array<string>")) for m in LENGTHS]
    spans = counts.select(*cols, F.explode(F.concat(*cut)).alias("gram"))
    gram_counts = stored(spans.groupBy("gram").agg(*[F.sum(c).alias(c) for c in cols]))
    size = F.length("gram")
    by_size = {r["size"]: r for r in gram_counts.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in cols]).collect()}
    logs = F.coalesce(*[F.when(size == m, _logs([F.col(c) for c in cols], [r[c] for c in cols], r["rows"])) for m, r in by_size.items()])
    grams = gram_counts.select("gram", n, logs.alias("logs"))
    most = min(MOST_WORDS, NUMBERS // len(langs))
    model = Model(langs, *_held(words.where(F.length("word") <= LONGEST), "word", most, len(langs)), {m: _held(grams.where(size == m), "gram", MOST_GRAMS, len(langs)) for m in LENGTHS})
    return Learnt(model, words.select("word", "logs"), grams.select("gram", "logs"))


_MODELS: dict = {}


def _shared(shared, serial: int) -> Model:
    if serial not in _MODELS:
        _MODELS.clear()
        _MODELS[serial] = shared.value
    return _MODELS[serial]


def _looked_up(wanted: DataFrame, learnt: Learnt, shared, serial: int) -> DataFrame:
    """(word, logs) of different words; those never learnt get the mean of their longest learnt n-grams, if any."""
    langs = range(len(learnt.model.langs))
    met = stored(wanted.join(learnt.words, "word", "left"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, size, n, gram, logs): sums over the n-grams that workers hold, and the others with their number."""
        model = _shared(shared, serial)
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column(0).to_pylist():
                padded = f" {word} "
                for m in LENGTHS:
                    table, logs = model.grams[m]
                    of = Counter(padded[i : i + m] for i in range(len(padded) - m + 1))
                    rows += [(word, m, c, g, None) for g, c in of.items() if g not in table]
                    if held := [(table[g], c) for g, c in of.items() if g in table]:
                        at, c = np.array(held).T
                        rows.append((word, m, int(c.sum()), None, (logs[at] * c[:, None]).sum(0).tolist()))
                        break  # shorter ones are not asked for
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["word", "size", "n", "gram", "logs"])

    parts = stored(met.where("logs is null").select("word").mapInArrow(cut, "word string, size int, n long, gram string, logs array<double>"))
    n = F.col("n")
    joined = parts.where("gram is not null").drop("logs").join(learnt.grams, "gram").select("word", "size", "n", F.transform("logs", lambda x: x * n).alias("logs"))
    sums = parts.where("gram is null").select("word", "size", "n", "logs").union(joined).groupBy("word", "size").agg(F.sum("n").alias("n"), *[F.sum(F.col("logs")[k]).alias(f"l{k}") for k in langs])
    best = sums.groupBy("word").agg(F.max_by(F.array(*[F.col(f"l{k}") / n for k in langs]), "size").alias("logs"))
    return met.where("logs is not null").union(best)


def predict(docs: DataFrame, learnt: Learnt, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred and score (0 to 1, the winner's share under equal priors).

    Workers add up the words that they hold and number the others in blocks of texts; these are looked up once for a
    block, and the block is finished with them.
    """
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    langs = learnt.model.langs
    if not langs:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(learnt.model)
    serial = shared._jbroadcast.id()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shared(shared, serial)
        block, texts, numbers = TaskContext.get().partitionId() << 32, 0, {}
        names = [*keep, "block", "total", "at", "pos", "word"]
        for batch in batches:
            blocks, totals, ats, asked = [], [], [], []
            for text in batch.column(len(keep)):
                if len(numbers) >= BLOCK_WORDS or texts >= BLOCK_TEXTS:
                    asked.append((block, list(numbers)))
                    block, texts, numbers = block + 1, 0, {}
                words = words_of(text.as_py())
                known = np.fromiter(map(model.words.get, words, repeat(-1)), np.int64, len(words))
                other = [numbers.setdefault(words[k], len(numbers)) for k in np.flatnonzero(known < 0)]
                texts += 1
                blocks.append(block)
                totals.append(model.word_logs[known[known >= 0]].sum(0).tobytes() if words else None)
                ats.append(np.array(other, "<i4").tobytes())
            none = pa.nulls(len(blocks), pa.int32()), pa.nulls(len(blocks), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(blocks, pa.int64()), pa.array(totals, pa.binary()), pa.array(ats, pa.binary()), *none], names)
            for b, words in asked:
                yield lookup(b, words, batch.schema)
        if numbers:
            yield lookup(block, list(numbers), batch.schema)

    def lookup(block: int, words: list[str], schema: pa.Schema) -> pa.RecordBatch:
        n = len(words)
        cols = [*(pa.nulls(n, schema.field(k).type) for k in range(len(keep))), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(words, pa.string())]
        return pa.RecordBatch.from_arrays(cols, [*keep, "block", "total", "at", "pos", "word"])

    state = stored(docs.select(*keep, text_col).mapInArrow(held, f"{kinds}, block long, total binary, at binary, pos int, word string"))
    asked = state.where("pos is not null").select("block", "pos", "word")
    answers = asked.join(_looked_up(asked.select("word").distinct(), learnt, shared, serial), "word").select("block", "pos", "logs")
    lines = state.where("pos is null").select(*keep, "block", "total", "at")
    both = lines.unionByName(answers, allowMissingColumns=True).select(*keep, "block", "total", "at", "pos", "logs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after another, the answers of a block before its texts."""
        now, logs = None, np.zeros((0, len(langs)))
        for batch in batches:
            block, pos, flat = (batch.column(k) for k in ("block", "pos", "logs"))
            block, pos, flat = block.to_numpy(), pos.fill_null(-1).to_numpy(), np.array(flat.flatten(), np.float64).reshape(-1, len(langs))
            taken, best, share, rows = 0, [], [], []
            edge = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(pos < 0) != 0)) + 1, [len(block)]]) if len(block) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if block[a] != now:
                    now, logs = block[a], np.zeros((0, len(langs)))
                if pos[a] >= 0:
                    more = int(pos[a:b].max()) + 1 - len(logs)
                    logs = np.concatenate([logs, np.zeros((max(0, more), len(langs)))])
                    logs[pos[a:b]] = flat[taken : taken + b - a]
                    taken += b - a
                    continue
                for total, at in zip(batch.column("total")[a:b].to_pylist(), batch.column("at")[a:b].to_pylist(), strict=True):
                    if total is None:
                        best.append("und")
                        share.append(0.0)
                        continue
                    at = np.frombuffer(at, "<i4")
                    at = at[at < len(logs)]  # words of which nothing was learnt have no answer and add nothing
                    total = np.frombuffer(total) + logs[at].sum(0)
                    k = int(np.argmax(total))
                    best.append(langs[k])
                    share.append(float(1 / np.exp(total - total[k]).sum()))
                rows += range(a, b)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(keep)], pa.array(best, pa.string()), pa.array(share, pa.float64())], [*keep, "lang_pred", "score"])

    return both.repartition("block").sortWithinPartitions("block", F.col("pos").isNull()).mapInArrow(finish, f"{kinds}, lang_pred string, score double")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score): learnt from rows whose crc32(id) mod 3 is not 1, predicted for all rows."""
    rest = F.crc32(F.col(id_col).cast("string")) % 3
    learnt = learn(docs.where(rest != 1), text_col, lang_col)
    return predict(docs, learnt, text_col, (id_col,)).select(id_col, (F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 3 == 1).alias("held_out"), "lang_pred", "score")
