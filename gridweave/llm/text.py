"""Words of many texts at once, as numpy arrays over one UTF-8 buffer.

The separators are ASCII, so words can be cut on bytes.  Everything here works
on slices of an Arrow batch that hold a bounded number of text bytes (one text
at least), whatever the batch size of the session.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def texts(column: pa.Array) -> pa.Array:
    """A binary array without nulls (null: empty)."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "").cast(pa.large_binary())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with about `most` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts(batch.column(batch.schema.get_field_index(column)))
        off = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        raw = whole.buffers()[2]
        buf = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(whole):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


@dataclass
class Words:
    """Word i is buf[start[i]:end[i]]; text d has the words ptr[d]..ptr[d+1]."""

    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def binary(self) -> pa.Array:
        """The words themselves as an Arrow array."""
        data = self.buf[~SEPARATOR[self.buf]]
        off = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=off[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    keep = ~SEPARATOR[buf]
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    edge = off[(off > 0) & (off < len(buf))]  # a text's end parts words too
    first[edge] = keep[edge]
    last[edge - 1] = keep[edge - 1]
    start = np.flatnonzero(first)
    return Words(buf, off, start, np.flatnonzero(last) + 1, np.searchsorted(start, off))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash() takes the hash of any span."""
    up, _ = _power(len(buf))
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
    return run


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes anywhere."""
    _, down = _power(len(run))
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes; entry i starts at word i."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(out)]
    return mix(out)


# Kinds of bytes for cutting words into pieces: letters are ASCII letters and the
# two-byte letters U+00C0..U+017F; the kind HARD is left to a pre-tokenizer.
LETTER, DIGIT, OTHER, HARD = 1, 2, 3, 4
KIND = np.full(256, HARD, np.uint8)
KIND[33:127] = OTHER
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = LETTER
KIND[39] = HARD  # contractions
KIND[SEPARATOR] = 0
#: Second bytes that make no plain letter: U+00D7, U+00F7, and U+0130, whose lower case is two characters.
NO_LETTER = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
#: A piece of plain letters, with a space before it perhaps.
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")


def pieces(w: Words, single_digits: bool) -> np.ndarray:
    """A mark at every byte of the buffer where a piece of a word begins.

    Words with a HARD byte, or with "<|", stay whole.
    """
    buf = w.buf
    kind = KIND[buf]
    before = np.empty_like(buf)
    before[:1], before[1:] = 0, buf[:-1]
    tail = (buf >= 0x80) & (buf < 0xC0) & (before >= 0xC3) & (before <= 0xC5)
    for lead, second in NO_LETTER:
        tail &= ~((before == lead) & (buf == second))
    kind[tail] = LETTER
    hard = (kind == HARD) | ((buf == 124) & (before == 60))
    change = np.zeros(len(buf) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    if single_digits:
        change[:-1] |= kind == DIGIT
    change[w.start] = True
    if hard.any():
        count = np.concatenate([[0], np.cumsum(hard)])
        for i in np.flatnonzero(count[w.end] > count[w.start]).tolist():
            change[w.start[i] + 1 : w.end[i]] = False
    return change[: len(buf)] & (kind > 0)
