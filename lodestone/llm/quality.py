"""Quality classification by co-training on two views of a document: its text, and its metadata.

Each view has a logistic classifier of its own. Both start from the labelled sample; round by round each names those of
all other documents that it is sure of (log odds beyond the prior by `SURE`), and those pseudo-labels go to the training of the other
view. A round trains both views until their penalised losses no longer fall; a view that a round made worse on the
calibration documents, labelled ones that neither view nor pool has, stays as it was. Each view's score is then calibrated
on those documents, and the calibrated log odds are added (the prior counted once) to score every document.

Only the labelled sample is bounded: at most `LABELLED` documents, chosen by hash of the id. The pool is every document
that is not in it. A round is at most `STEPS` Newton steps, each one pass over the pool's stored features; a step after
which the loss is greater is halved. Tasks hand on sums of losses, slopes and curvatures by view and class, so that what
meets the driver does not grow with the table. Pseudo-labels of a class weigh as much as its labels at most, however many
there are.

The text view has shares of characters, statistics of words, lines and repetition, and a lexicon: log odds of hashed
words and byte 4-grams, counted over labelled documents; a document of one half of the training sample is described by
the lexicon of the other half. The metadata view has source, language and length.

Null or empty text: described as an empty text. Very long texts: described whole. Null metadata: a value of its own.
Null ids: scored, and in the pool. Repeated rows: scored each. Labels of unknown ids or null labels are not used; if an
id has several labels the least counts, if it has several texts one of them. Without labelled documents of both classes
every document is kept with probability 1. Empty documents: no rows. Other columns are ignored, whatever their names;
columns named in `keep` are carried along.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

#: Bound of the labelled sample; rounds of co-training, Newton steps in a round at most; fall of the loss, as a share of
#: the documents, below which a round has settled; log odds beyond the prior from which a view is sure.
LABELLED, ROUNDS, STEPS, SETTLED, SURE = 8_000, 3, 16, 1e-5, 2.0
#: A document with less than this probability of good quality is rejected.
REJECT_BELOW = 0.5
#: Hashed words, and hashed 4-grams, of the lexicon.
TERMS = 1 << 16
_META = 64


def terms(raw: bytes, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words, and of all 4-grams of bytes."""
    words = np.fromiter(map(zlib.crc32, counts), np.uint32, len(counts)) % TERMS
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = a[:-3] | (a[1:-2] << 8) | (a[2:-1] << 16) | (a[3:] << 24) if len(a) > 3 else np.zeros(0, np.uint32)
    return words, (grams * np.uint32(2654435761)) >> np.uint32(16)


def text_features(text: str | None, lexicon: np.ndarray) -> np.ndarray:
    """lexicon: log odds (words and grams, term)."""
    raw = (text or "").encode()
    shares = np.bincount(np.minimum(np.frombuffer(raw, np.uint8), 128), minlength=129)[:129] / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    same = sum(map(bytes.__eq__, words, words[1:])) if words else 0
    shouted = sum(map(bytes.isupper, words))
    wordlike = sum(map(bytes.isalpha, words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    n_lines = max(1, sum(lines.values()))
    more = [
        np.log1p(len(words)), np.log1p(len(raw) / n), np.log1p(sizes.std()), len(counts) / n, same / n, shouted / n, wordlike / n,
        max(counts.values(), default=0) / n, np.log1p(n_lines), 1 - len(lines) / n_lines, np.log1p(n / n_lines), n == 1,
    ]
    for odds, own in zip(lexicon, terms(raw, counts), strict=True):
        x = odds[own] if len(own) else np.zeros(1, np.float32)
        more += [x.mean(), (x > 0.5).mean(), (x < -0.5).mean(), np.minimum(x, 0).mean()]
    return np.concatenate([np.sqrt(shares), more]).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(_META + 3, np.float32)
    for name, value in (("source", source), ("lang", lang)):
        x[zlib.crc32(f"{name}={value}".encode()) % _META] += 1
    size = np.log1p(max(0, n_chars or 0))
    x[_META:] = size / 10, (size / 10) ** 2, n_chars is None
    return x


class Logistic:
    """Ridge logistic regression by Newton steps, on standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 12) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = self._ready(x)
        self.w = np.zeros(z.shape[1])
        keep = np.diag([0.01, *[ridge] * (z.shape[1] - 1)])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            slope = z.T @ (p - y) + keep @ self.w
            self.w -= np.linalg.solve((z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + keep, slope)
        return self

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], 1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._ready(x) @ self.w, -30, 30)

    def slopes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Curvature, slope, loss and number of rows in one array of (features + 1, features + 4)."""
        z = self._ready(x)
        t = np.clip(z @ self.w, -30, 30)
        p = 1 / (1 + np.exp(-t))
        sums = [np.full((z.shape[1], 1), v) for v in ((np.logaddexp(0, t) - y * t).sum(), float(len(y)))]
        return np.concatenate([(z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z, (z.T @ (p - y))[:, None], *sums], 1)

    def at(self, w: np.ndarray) -> Logistic:
        out = Logistic()
        out.mean, out.scale, out.w = self.mean, self.scale, w
        return out


class Descent:
    """Newton steps of one view on summed slopes; a step that raises the penalised loss is halved."""

    def __init__(self, model: Logistic, ridge: float = 3.0):
        self.best = self.now = model
        self.loss, self.done, self.step, self.way = np.inf, False, 1.0, np.zeros(len(model.w))
        self.keep = np.diag([0.01, *[ridge] * (len(model.w) - 1)])

    def take(self, sums: np.ndarray) -> None:
        """sums: of the slopes of `now`, over all rows that count."""
        loss = sums[0, -2] + self.now.w @ self.keep @ self.now.w / 2
        if loss > self.loss + 1e-9 * abs(self.loss):
            self.step /= 2
            self.done = self.step < 1e-3
        else:
            self.best, self.loss, self.step = self.now, loss, 1.0
            slope = sums[:, -3] + self.keep @ self.now.w
            self.way = -np.linalg.solve(sums[:, :-3] + self.keep, slope)
            self.done = -slope @ self.way / 2 < SETTLED * max(1.0, sums[0, -1])
        self.now = self.best if self.done else self.best.at(self.best.w + self.step * self.way)


def calibrated_loss(model: Logistic, x: np.ndarray, y: np.ndarray) -> float:
    """Mean loss of a view on documents, once it is calibrated on them."""
    odds = model.odds(x)[:, None]
    t = Logistic().fit(odds, y, ridge=0.1).odds(odds)
    return float((np.logaddexp(0, t) - y * t).mean())


class CoTrained:
    """Two views' classifiers with their calibrations, and the lexicon of the text view."""

    def __init__(self, models: list[Logistic], views: list[np.ndarray], y: np.ndarray, prior: float, lexicon: np.ndarray):
        self.models, self.prior, self.lexicon = models, prior, lexicon
        self.calibrated = [Logistic().fit(m.odds(v)[:, None], y, ridge=0.1) for m, v in zip(models, views, strict=True)]

    def odds(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated log odds of each view, and of both together."""
        each = [c.odds(m.odds(v)[:, None]) for c, m, v in zip(self.calibrated, self.models, views, strict=True)]
        return [*each, each[0] + each[1] - self.prior]


def _sample(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """About, and never more than, `most` rows with the least hashes of their ids."""
    share = min(1.0, 0.95 * most / max(1, df.count()))
    mixed = F.pmod(F.xxhash64(id_col, F.lit("quality")), F.lit(1 << 30))
    return df.where(F.col(id_col).isNotNull() & (mixed < int(share * (1 << 30)))).limit(most)


def _lexicons(mine: DataFrame) -> np.ndarray:
    """Log odds (half left out or none, words and grams, term) of terms of labelled texts: (text, label, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, 2, TERMS + 1), np.int64)  # half, label, kind, term; last the number of texts
        for b in batches:
            for text, label, half in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                for kind, own in enumerate(terms(raw, Counter(raw.split()))):
                    counts[half, label, kind, np.unique(own)] += 1
                    counts[half, label, kind, TERMS] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["at", "n"])

    summed = mine.select("text", "label", "half").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, 2, 2, TERMS + 1))
    counts.ravel()[summed["at"].to_numpy()] = summed["n"].to_numpy()
    out = []
    for own in (counts[1], counts[0], counts.sum(0)):  # for texts of half 0, of half 1, and of neither
        share = np.log((own[..., :TERMS] + 1) / (own[..., TERMS:] + 2))
        out.append(np.where(own[..., :TERMS].sum(0) > 1, share[1] - share[0], 0))
    return np.array(out, np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float16) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _pool_slopes(pool: DataFrame, sure: list[Logistic], now: list[Logistic], prior: float, moving: list[bool]) -> list[np.ndarray]:
    """For each moving view (class, ...): summed slopes of `now` over the documents that the other view of `sure` is sure of."""
    shared = pool.sparkSession.sparkContext.broadcast((sure, now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firm, models = shared.value
        sums = [[0, 0], [0, 0]]
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                views = [_matrix(b.column(k).slice(at, 2_000)) for k in ("text", "meta")]
                odds = [m.odds(v) - prior for m, v in zip(firm, views, strict=True)]
                for k in np.flatnonzero(moving).tolist():
                    for label, own in ((0, odds[1 - k] < -SURE), (1, odds[1 - k] > SURE)):
                        sums[k][label] = sums[k][label] + models[k].slopes(views[k][own], np.full(own.sum(), float(label)))
        rows = [(k * 2 + label, n, line.tobytes()) for k in (0, 1) for label in (0, 1) if not np.isscalar(sums[k][label]) for n, line in enumerate(sums[k][label])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["slot", "line", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for slot, line, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[slot, line] = total.get((slot, line), 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slot", "line", "sums"]
        )

    kinds = "slot int, line int, sums binary"
    lines = {(r["slot"], r["line"]): np.frombuffer(r["sums"]) for r in pool.select("text", "meta").mapInArrow(run, kinds).repartition("slot", "line").mapInArrow(add, kinds).collect()}
    shared.unpersist()
    return [np.array([[lines.get((k * 2 + label, n), np.zeros(len(m.w) + 3)) for n in range(len(m.w))] for label in (0, 1)]) for k, m in enumerate(now)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rounds: int = ROUNDS) -> CoTrained | None:
    """The model, or None if there are not labelled documents of both classes. The labels are sampled, then met with their documents."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.min(F.col(label_col)).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("labelled", F.lit("fold")), F.lit(8))  # 6 and 7: for calibration
    chosen = _sample(known, "labelled", LABELLED).withColumn("half", F.when(fold < 6, fold % 2).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), "text", "source", "lang", "n_chars")
    met = rows.join(F.broadcast(chosen), F.col("id") == F.col("labelled"), "left")
    lexicons = _lexicons(met.where("half is not null"))
    if not all(np.abs(x).any() for x in lexicons[2:]):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                half = [2 if h is None else h for h in part.column("half").to_pylist()]
                text = [text_features(t.as_py(), shared.value[h]).astype("<f2").tobytes() for t, h in zip(part.column("text"), half, strict=True)]
                meta = [meta_features(*r).astype("<f2").tobytes() for r in zip(*(part.column(k).to_pylist() for k in ("source", "lang", "n_chars")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("labelled", "label", "half")), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["labelled", "label", "half", "text", "meta"])

    described = stored(met.select("labelled", "label", "half", "text", "source", "lang", "n_chars").mapInArrow(describe, f"labelled {known.schema['labelled'].dataType.simpleString()}, label int, half int, text binary, meta binary"))
    own = described.where("label is not null").groupBy("labelled").agg(F.min(F.struct("label", "half", "text", "meta")).alias("x")).orderBy("labelled").select("x.*").toArrow()
    y, held = own["label"].to_numpy().astype(float), own["half"].is_null().to_numpy()
    if len(y) < 8 or y[~held].min(initial=1) == y[~held].max(initial=0):
        return None
    views = [_matrix(own[k]) for k in ("text", "meta")]
    mine, named = [v[~held] for v in views], y[~held]
    models = [Logistic().fit(v, named) for v in mine]
    prior = float(np.log(named.mean() / (1 - named.mean())))
    pool = described.where("label is null")
    if not held.any() or y[held].min() == y[held].max():
        held = np.ones(len(y), bool)
    apart = [v[held] for v in views]
    losses = [calibrated_loss(m, v, y[held]) for m, v in zip(models, apart, strict=True)]
    for _ in range(rounds):
        ways = [Descent(m) for m in models]
        for _ in range(STEPS):
            found = _pool_slopes(pool, models, [d.now for d in ways], prior, [not d.done for d in ways])
            for k, d in enumerate(ways):
                if not d.done:
                    sums = d.now.slopes(mine[k], named)
                    for label in (0, 1):
                        sums = sums + found[k][label] * min(1.0, (named == label).sum() / max(1.0, found[k][label][0, -1]))
                    d.take(sums)
            if all(d.done for d in ways):
                break
        new = [calibrated_loss(d.best, v, y[held]) for d, v in zip(ways, apart, strict=True)]
        better = [a <= b for a, b in zip(new, losses, strict=True)]
        models = [d.best if ok else m for d, m, ok in zip(ways, models, better, strict=True)]
        losses = [min(a, b) for a, b in zip(new, losses, strict=True)]
        if not any(better):
            break
    return CoTrained(models, apart, y[held], prior, lexicons[2])


def score(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep columns, p_text, p_meta, p_quality, keep) of every row."""
    if model is None:
        one = F.lit(1.0)
        return docs.select(id_col, *keep, one.alias("p_text"), one.alias("p_meta"), one.alias("p_quality"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                text = np.stack([text_features(t.as_py(), shared.value.lexicon) for t in b.column("_text")])
                meta = np.stack([meta_features(*r) for r in zip(*(b.column(k).to_pylist() for k in ("_source", "_lang", "_n_chars")), strict=True)])
                p = [1 / (1 + np.exp(-o)) for o in shared.value.odds([text, meta])]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *map(pa.array, p), pa.array(p[2] >= REJECT_BELOW)], [*names, "p_text", "p_meta", "p_quality", "keep"])

    rows = docs.select(F.col(id_col).alias("id"), *keep, *[F.col(k).alias(f"_{k}") for k in ("text", "source", "lang", "n_chars")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(run, f"{kinds}, p_text double, p_meta double, p_quality double, keep boolean").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    return score(docs, train(docs, labels, id_col, rounds=rounds), id_col, keep)
