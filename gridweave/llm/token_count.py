"""Operator 8: token counts, without identifiers.

Each word is merged with a heap of adjacent pairs over a doubly linked list of
its symbols: the pair of the lowest rank goes first (of equal ranks the
leftmost), and every merge makes the word one token shorter.  The count is the
number of symbols less the number of merges.

Texts are cut at ASCII white space, which no token of such a vocabulary
crosses, and at changes between plain letters, digits and signs; words with any
other character go through the file's own normaliser and pre-tokenizer.  A
batch's distinct pieces are merged once and found again in bounded caches of the
Python process.

Defined results: a null or empty text has 0 bytes and 0 tokens; white space
alone has 0 tokens; special strings inside a text count as one token each.  A
document with a null id keeps its row.  Repeated rows give repeated rows.  Other
columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import text, vocab

#: Entries of a cache before it starts anew.
CACHE = 800_000


def merges(symbols: list[int], table: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges a word of these symbols undergoes."""
    n = len(symbols)
    if n < 2:
        return 0
    ids, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(m[0], i, m[1], pair) for i in range(n - 1) if (m := table.get(pair := (ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, made, pair = heapq.heappop(heap)
        j = after[i]
        if j < 0 or (ids[i], ids[j]) != pair:
            continue  # one of the two is gone
        ids[i], ids[j], done = made, -1, done + 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if m := table.get(pair := (made, ids[k])):
                heapq.heappush(heap, (m[0], i, m[1], pair))
        if (h := before[i]) >= 0 and (m := table.get(pair := (ids[h], made))):
            heapq.heappush(heap, (m[0], h, m[1], pair))
    return done


class Counter:
    """Token counts of pieces, kept by the lower-cased piece and by the piece as it stands."""

    def __init__(self, path: str):
        self.v = vocab.load(path)
        self.chunks: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            s = self.v.symbols(piece)
            n = len(s) - merges(s, self.v.merge_of)
            if len(piece) <= 64:
                self.pieces[piece] = n
        return n

    def chunk(self, chunk: bytes) -> int:
        """Tokens of a piece of ASCII letters, or of anything else without white space."""
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        if chunk.isalpha():
            n = self.piece(chunk.decode().lower())
        elif text.LETTERS.fullmatch(chunk):
            n = self.piece("".join(map(self.v.shown.__getitem__, chunk.decode().lower().encode())))
        else:
            n = sum(1 if isinstance(p, int) else self.piece(p) for p in self.v.pieces(chunk.decode("utf-8", "replace")))
        if len(chunk) <= 64:
            self.chunks[chunk] = n
        return n

    def sizes(self, chunks: list[bytes]) -> np.ndarray:
        known = [*map(self.chunks.get, chunks)]
        return np.array([self.chunk(c) if n is None else n for c, n in zip(chunks, known)], np.int64)


_counters: dict[str, Counter] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, Counter(path))
        for rows, buf, off in text.slices(batches):
            w = text.words(buf, off)
            mark = text.pieces(w, single_digits=True)
            letters = ~text.SEPARATOR[buf]
            first = np.flatnonzero(mark)
            where = np.cumsum(letters) - letters  # of each byte among those kept
            cut = np.append(where[first], letters.sum()).astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cut), pa.py_buffer(buf[letters])]).dictionary_encode()
            sizes = counter.sizes(coded.dictionary.to_pylist())
            total = np.zeros(len(first) + 1, np.int64)
            np.cumsum(sizes[coded.indices.to_numpy()] if len(first) else [], out=total[1:])
            ptr = np.searchsorted(first, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off)), pa.array(total[ptr[1:]] - total[ptr[:-1]])], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document.

    docs: has doc_id and text.  path: a tokenizers file whose pre-tokenizer
    drops white space and never joins across it.
    """
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
