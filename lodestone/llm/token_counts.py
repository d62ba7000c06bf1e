"""Token counts: greedy longest-match piece counts in linear time, without building the pieces.

The vocabulary is a trie of byte strings. Every node has a failure link and the number of pieces popped on the way
there, both worked out once; a word is then read byte by byte, adding popped counts, and each byte is read once. A word
is matched with one leading space, so that pieces that begin with a space start words and all others continue them.

Words are what white space (space, tab to carriage return) separates. Null, empty or blank texts: 0 words, 0 tokens.
A word with a byte that no piece begins with counts as one unknown token. Very long texts and words: read once, as all.
Repeated rows count each for themselves. Empty tables: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose counts a worker remembers, and the longest that it does; beyond that number the memory starts anew.
REMEMBERED, LONGEST = 250_000, 64

_MACHINES: dict = {}


class PieceCounter(dict):
    """Counts of words seen so far; a missing word is read through the automaton."""

    def __init__(self, pieces):
        super().__init__()
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                if byte not in self.next[at]:
                    self.next[at][byte] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                at = self.next[at][byte]
            whole[at] = at > 0
        # fail[v]: where matching goes on when v has no fitting child (-1: nowhere); popped[v]: pieces finished on that way.
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.next[parent].items():
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                z, count = self.fail[parent], self.popped[parent]
                while z >= 0 and byte not in self.next[z]:
                    z, count = self.fail[z], count + self.popped[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.next[z][byte], count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        at, count = 0, 0
        for byte in b" " + word:
            while byte not in self.next[at]:
                if self.fail[at] < 0:
                    return self.keep(word, 1)
                at, count = self.fail[at], count + self.popped[at]
            at = self.next[at][byte]
        while at > 0:
            if self.fail[at] < 0:
                count = 1
                break
            at, count = self.fail[at], count + self.popped[at]
        return self.keep(word, count)

    def keep(self, word: bytes, count: int) -> int:
        if len(word) <= LONGEST:
            self[word] = count
        return count


def piece_counter(path: str) -> PieceCounter:
    if path not in _MACHINES:
        with open(path, "rb") as f:
            _MACHINES[path] = PieceCounter(base64.b64decode(line.split()[0]) for line in f if line.strip())
    return _MACHINES[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens) of each whole text; path: a file of base64 pieces, one a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counter(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode().split()
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long")
