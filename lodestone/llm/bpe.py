"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched where their boundaries resynchronise.

A text of at most one chunk is encoded as it stands. A longer one is cut to overlapping chunks; each is pre-tokenised
from its own start, and the first boundary that a chunk shares with the one before it, inside their overlap, is where
the two are stitched. Pre-tokenisation looks only forward, so that from a shared boundary on both agree. A boundary
after white space is not used (how a white-space run is cut depends on what follows it). Chunks that share no boundary
are joined to one piece. Decoding looks up each id's bytes and concatenates them.

Runs of `LONG_RUN` or more blanks are given to the tokenizer as one pre-token, without its last blank if a text follows:
that is how the pattern cuts them, and the library's regular expressions run out of stack on very long ones.

Null text: encoded as the empty text, no ids, no bytes. Very long texts: in chunks, as above. Repeated rows: encoded each
for itself. Empty tables: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

CHUNK = 16_384
OVERLAP = 1_024
#: Rows that a worker encodes or decodes before it hands them on.
ROWS = 200
#: Blanks in a row that are cut out before the regular expression of the tokenizer sees them; and what is a blank to it.
LONG_RUN = 1_000
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

_ENCODING: dict = {}


def encoding(path: str, pattern: str):
    """The tokenizer of a rank file, built once in each Python worker."""
    if (path, pattern) not in _ENCODING:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODING[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[path, pattern]


def encode_text(path: str, pattern: str, text: str) -> list[int]:
    """The ids of a whole text."""
    tokenizer = encoding(path, pattern)
    runs = [m.span() for m in _BLANKS.finditer(text)] if len(text) >= LONG_RUN else []
    if not runs:
        return tokenizer.encode_ordinary(text)
    ids, at = [], 0
    for start, end in runs:
        if end < len(text):
            end -= 1  # the last blank may belong to what follows
        ids += tokenizer.encode_ordinary(text[at:start])
        ids += tokenizer._encode_single_piece(text[start:end])
        at = end
    return ids + tokenizer.encode_ordinary(text[at:])


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array(x, np.int32) for x in ids])))


def _encode_rows(df: DataFrame, keep: list[str], path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """keep columns and ids of the last column, which is a text; and the bytes that the ids decode to, if asked for."""
    names = [*keep, "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = encoding(path, pattern).decode_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [encode_text(path, pattern, t.as_py() or "") for t in part.column(len(keep))]
                back = [pa.array(map(join, ids), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _lists(ids), *back], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keep)])
    return df.mapInArrow(run, f"{kinds}, ids array<int>" + ", decoded binary" * decoded)


def _cut(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, id, k, last, body): overlapping chunks, each text read once from its start to its end.

    The chunks are written down, so that the numbers of the rows are the same for all who read them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                text, one = batch.column(1)[n].as_py(), batch.slice(n, 1)
                count = -(-len(text) // chunk)
                for at in range(0, count, ROWS):
                    ks = range(at, min(count, at + ROWS))
                    same = pa.array(np.zeros(len(ks), np.int64))
                    body = pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks], pa.string())
                    yield pa.RecordBatch.from_arrays([one.column(2).take(same), one.column(0).take(same), pa.array(ks, pa.int32()), pa.array([k == count - 1 for k in ks]), body], ["row", "id", "k", "last", "body"])

    return stored(long.select("id", "text", "row").mapInArrow(run, f"row long, id {long.schema['id'].dataType.simpleString()}, k int, last boolean, body string"))


def _chunks(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, id, k, last, body, head, tail): head and tail are the usable boundaries in the overlaps with the chunks before and after."""
    cut = _cut(long, chunk, overlap).repartition("row", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        token = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for body, last in zip(batch.column(4), batch.column(3), strict=True):
                text = body.as_py()
                ends = [m.end() for m in token.finditer(text)]
                if not last.as_py():
                    ends = [e for e in ends if e < len(text)]
                ends = [e for e in ends if not text[e - 1].isspace()]
                heads.append([e for e in ends if e < overlap])
                tails.append([e - chunk for e in ends if chunk <= e])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, lists), pa.array(tails, lists)], ["row", "id", "k", "last", "body", "head", "tail"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return cut.mapInArrow(run, f"{kinds}, head array<int>, tail array<int>")


def pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, id, k, piece): stretches of whole pre-tokens that make up each text, in the order of k."""
    order = Window.partitionBy("row").orderBy("k")
    cuts = _chunks(long, pattern, chunk, overlap).withColumn("cut", F.array_min(F.array_intersect(F.lag("tail").over(order), "head")))
    runs = cuts.withColumn("run", F.sum(F.when(F.col("cut").isNotNull() | (F.col("k") == 0), 1).otherwise(0)).over(order))
    runs = runs.withColumn("next", F.lead("cut").over(order)).withColumn(
        "own", F.when(F.col("next").isNotNull(), F.substring("body", F.lit(1), F.lit(chunk) + F.col("next"))).when(F.col("last"), F.col("body")).otherwise(F.substring("body", 1, chunk))
    )
    joined = runs.groupBy("row", "run").agg(F.first("id").alias("id"), F.min("k").alias("k"), F.sort_array(F.collect_list(F.struct("k", "cut", "own"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["own"]), "")
    return joined.select("row", "id", "k", F.substring(whole, F.coalesce(F.get("parts", 0)["cut"], F.lit(0)) + 1, F.length(whole)).alias("piece"))


def _parts(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, text) of texts of one chunk at most, and (id, text, row) of longer ones."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = F.length("text") <= chunk
    return rows.where(short), rows.where(~short).withColumn("row", F.monotonically_increasing_id())


def _stitched(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(id, ids) of texts that are cut to chunks."""
    parts = _encode_rows(pieces(long, pattern, chunk, overlap), ["row", "id", "k"], path, pattern)
    whole = parts.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return whole.select("id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids array<int>): the ids of each whole text, without special tokens."""
    short, long = _parts(docs, id_col, text_col, chunk)
    return _encode_rows(short, ["id"], path, pattern).union(_stitched(long, path, pattern, chunk, overlap)).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of tokens and out_col binary, the concatenated bytes of its ids."""
    names = [*tokens.columns, out_col]
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = encoding(path, pattern).decode_bytes
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([join(x.values.to_pylist()) for x in part.column(at)], pa.binary())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{kinds}, `{out_col}` binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids array<int>, decoded binary): as encode and decode; a text of one chunk meets one Python worker only."""
    short, long = _parts(docs, id_col, text_col, chunk)
    back = decode(_stitched(long, path, pattern, chunk, overlap), path, pattern)
    return _encode_rows(short, ["id"], path, pattern, decoded=True).union(back).withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of encoding each text and decoding its ids."""
    return round_trip(docs, path, pattern, id_col, text_col).select(
        id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
