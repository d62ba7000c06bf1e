"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text.

Texts are lower-cased (A-Z) and cut to words of digits, letters and non-ASCII characters; a window is `window`
consecutive words of an item (a shorter item is one window). The normalised text is scanned once; matches are mapped to
word numbers, and the words' places in the original text give the spans.

The windows are made, grouped and dealt to blocks of bounded size in Spark; a benchmark of one block (the usual case) is
one automaton and one scan, of a larger one each block is sent to the workers and scanned for in turn.

Null, empty or wordless documents: no words, no hits, not contaminated. Very long texts: scanned once, whole. Null, empty
or wordless items have no window. Windows of items without an id hit words, but name no item. An item id that repeats
with other text adds its windows to the same id. Windows that several items share count for each of them. Repeated rows
are judged each; empty tables: no rows, or no hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable

#: Bytes of windows in one automaton; a larger benchmark is scanned for in several blocks, one automaton in memory at a time.
BLOCK_BYTES = 16_000_000
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}

_AUTOMATON: dict = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(key binary, items array<string>): each different window, spaces around its words, with the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = normal_words(text.as_py())
                keys = {b" ".join([b"", *words[i : i + window], b""]) for i in range(max(1, len(words) - window + 1) if words else 0)}
                yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.binary()), pa.array([item] * len(keys), pa.string())], ["key", "item"])

    made = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "key binary, item string")
    return made.groupBy("key").agg(F.collect_set("item").alias("items"))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[dict[str, list]]:
    """Windows with their items, a bounded block at a time, dealt by hash."""
    windows = durable(windows_of(benchmark, id_col, text_col, window))
    held = windows.agg(F.sum(F.octet_length("key") + 8 * F.size("items") + 8).alias("bytes")).first()["bytes"] or 0
    count = -(-held // BLOCK_BYTES)
    for k in range(count):
        block = windows.where(F.pmod(F.xxhash64("key"), F.lit(count)) == k).toArrow()
        if block.num_rows:
            yield {key.decode("latin-1"): items for key, items in zip(block["key"].to_pylist(), block["items"].to_pylist(), strict=True)}


def _automaton(shared, alone: bool):
    import ahocorasick

    if shared.id not in _AUTOMATON:
        if not alone or len(_AUTOMATON) > 3:
            _AUTOMATON.clear()
        machine = ahocorasick.Automaton()
        for n, (key, items) in enumerate(shared.value.items()):
            machine.add_word(key, (key.count(" ") - 1, items))
        machine.make_automaton()
        _AUTOMATON[shared.id] = machine
    return _AUTOMATON[shared.id]


class _Shared:
    def __init__(self, spark, block):
        self.cast = spark.sparkContext.broadcast(block)
        self.id = self.cast._jbroadcast.id()

    def __getstate__(self):
        return {"cast": self.cast, "id": self.id}

    @property
    def value(self):
        return self.cast.value


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id_col, keep columns, n_words, n_hit, n_items, items array<long>, spans array<struct<start,end>>, items_sha256, contaminated).

    A text is contaminated if it has hit words and `share` times their number is at least the number of words.
    spans: stretches of hit words as code points of the original text, end exclusive.
    """
    shared = [_Shared(docs.sparkSession, b) for b in _blocks(benchmark, item_col, item_text_col, window)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(k).alias(f"_{n}") for n, k in enumerate(keep)])
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in (id_col, *keep))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        # Several automata take turns in memory, so that each then scans a whole batch.
        rows_at_once = 500 if len(shared) == 1 else 10_000
        for batch in (b.slice(at, rows_at_once) for b in batches for at in range(0, b.num_rows, rows_at_once)):
            texts = batch.column(1)
            normal = [b" ".join([b"", *normal_words(t.as_py()), b""]).decode("latin-1") for t in texts]
            found: list[list] = [[] for _ in normal]
            for s in shared:
                machine = _automaton(s, len(shared) == 1)
                for hits, text in zip(found, normal, strict=True):
                    hits.extend(machine.iter(text))
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items", "spans", "sha")}
            for n, (hits, text) in enumerate(zip(found, normal, strict=True)):
                words = max(0, text.count(" ") - 1)
                items, spans, n_hit = set(), [], 0
                if hits:
                    gaps = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                    depth = np.zeros(words + 1, np.int64)
                    for end, (length, ids) in hits:
                        last = int(np.searchsorted(gaps, end))
                        depth[last - length] += 1
                        depth[last] -= 1
                        items.update(ids)
                    hit = np.cumsum(depth)[:words] > 0
                    n_hit = int(hit.sum())
                    at = [m.span() for m in word.finditer(texts[n].as_py().translate(_LOWER))]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    spans = [{"start": at[i][0], "end": at[j - 1][1]} for i, j in zip(edge[::2], edge[1::2], strict=True)]
                names = sorted(items)
                out["n_words"].append(words)
                out["n_hit"].append(n_hit)
                out["items"].append(names)
                out["spans"].append(spans)
                out["sha"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(map(len, out["items"]), pa.int64()), pa.array(out["items"], pa.list_(pa.string())),
                 pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out["sha"], pa.string()),
                 pa.array([h > 0 and share * h >= w for h, w in zip(out["n_hit"], out["n_words"], strict=True)], pa.bool_())],
                [id_col, *keep, "n_words", "n_hit", "n_items", "items", "spans", "items_sha256", "contaminated"],
            )

    return rows.mapInArrow(
        scan, f"{kinds}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, items_sha256 string, contaminated boolean"
    )
