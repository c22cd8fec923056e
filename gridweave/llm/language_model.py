"""Operator 6: language-model scores.

Two models learn from the documents that are not held out.

Base: add-one unigram over all tokens.  Token counts are summed before the
shuffle and kept as a table by word hash (96 bits).  The HEAD most frequent words
travel to the tasks (20 bytes each, whatever their length); all other words of a
document are joined to the table.

Model: a hashed maximum-entropy model with a class-factored softmax over all
words.  The TOP most frequent words are leaves of their own, every other word
belongs to one of TAILS leaves by a hash of its last letters and whether it is
long, so unseen words have leaves too.  CLASSES leaves that follow each other
make a class, and

    P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf).

The first two factors are softmaxes; the third is add-one by counts, with a share
for unseen words, so the scores are probabilities over all words.  Features of a
history: the previous word, the one before it (a skip), both together, the leaves
of both, and the last two of the most frequent words, however far back (a skip);
for the second factor the previous word, its leaf and those last two.  A hash takes
each feature to one of the rows of its table, whose number grows with the training
tokens from 2^LEAST_BITS to 2^MOST_BITS.

A row's value for a target is the log of how much more often the target follows
the row than it stands anywhere, from counts over all training tokens.  The
model's parameters are one weight for each feature, factor and size of row
(BUCKETS of them): STEPS gradient updates, each over the documents of another
share, sum the gradient over the tasks and move the weights by it, divided by a
bound of the curvature that the rows' counts give, and by a part of the move
before.  All training tokens take part, each judged by the counts without itself.
Counts are whole numbers and the sums do not depend on order but for rounding, so
partitions and reruns do not change the scores.

Scoring runs in numpy batches over sparse rows.

Defined results: a null or empty text is its end token alone; a null id counts
as the text "" for the hold-out rule and keeps its row; repeated rows are
learned and scored one by one; ties of frequent words go by hash; an empty table
gives no rows.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import text
from gridweave.sources.scratch import Scratch

HEAD = 1 << 19
START_BITS = 19
CLASSES = 32
TOP = TAILS = CLASSES * CLASSES // 2
#: Rows of a feature's table: one for about 2^TOKENS_BITS training tokens.
LEAST_BITS, MOST_BITS, TOKENS_BITS = 13, 17, 11
STEPS, MOMENTUM = 4, 0.5
BUCKETS = 8
#: Features of the first and the second factor.
FIRST, SECOND = 5, 3
PRIOR = 4.0
RIDGE, START = 10.0, 0.4
BATCH = 2048
SMALL = 2048
BLOCK = 1024
LONG = 4
ONES = np.ones(CLASSES, np.float32)
END = np.uint64(0x1F3D5B79A2C4E608)
SEEDS = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
WIDE = 64


def held_out(docs: DataFrame) -> DataFrame:
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.withColumn("held_out", key % 7 == 2)


def _lower(buf: np.ndarray) -> np.ndarray:
    """buf with A-Z lower-cased."""
    return buf | ((buf - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def _hash(padded: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; of words over WIDE bytes the rest at once. 8 bytes follow the texts."""
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = end - start
    h = text.mix((eight[start] & MASK.take(size, mode="clip")) + size.astype(np.uint64) * seed)
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < WIDE:
        h[more] = text.mix(h[more] * seed + (eight[start[more] + k] & MASK.take(size[more] - k, mode="clip")))
        k += 8
        more = more[size[more] > k]
    if len(more):
        rest = np.concatenate([padded[a:b] for a, b in zip((start[more] + k).tolist(), end[more].tolist())])
        to = np.cumsum(size[more] - k)
        h[more] = text.mix(h[more] * seed + text.span_hash(text.prefix_hash(rest), to - size[more] + k, to))
    return h


def _keys(buf: np.ndarray, off: np.ndarray) -> tuple[text.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, the number of each among the distinct ones; of those the two hashes, the tail groups and how often they occur."""
    buf = _lower(buf)
    w = text.words(buf, off)
    padded = np.append(buf, np.zeros(8, np.uint8))
    codes, first, h = _coded(_hash(padded, w.start, w.end, SEEDS[0]))
    start, end = w.start[first], w.end[first]
    other = (_hash(padded, start, end, SEEDS[1]) >> np.uint64(33)).astype(np.int32)
    size = end - start
    last, before = buf[end - 1].astype(np.uint64), np.where(size > 1, buf[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    tail = text.mix(last * np.uint64(256) + before + (size > LONG).astype(np.uint64) * np.uint64(65536) + np.uint64(7)) % np.uint64(TAILS)
    return w, codes, h, other, tail.astype(np.int16), np.bincount(codes, minlength=len(h))


def _coded(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each distinct hash for all words, the place of its first one, and those hashes."""
    coded = pa.array(h.view(np.int64)).dictionary_encode()
    codes = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first, h[first]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, buf, off in text.slices(batches, most=2 * text.SLICE_BYTES):
        _, _, h, other, tail, n = _keys(buf, off)
        columns = [np.append(h, END).view(np.int64), np.append(other, 0).astype(np.int32), np.append(tail, 0).astype(np.int16), np.append(n, len(off) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "other", "tail", "n"])


@dataclass
class Vocabulary:
    h: np.ndarray  # hashes of the head, sorted
    other: np.ndarray
    count: np.ndarray
    leaf: np.ndarray  # place among the most frequent words, -1 for the rest
    tokens: int  # N
    types: int  # V
    bits: int
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log of P(class)
    second: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log of P(leaf | class)
    within: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of the denominator of P(word | leaf)
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # in h by the first bits, made where it is used

    def find(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Place in the head, or -1.

        Hashes are even, so the first bits lead to where a word would stand, or a few places before.
        """
        if not len(self.h):
            return np.full(len(h), -1)
        if not len(self.starts):
            self.starts = np.searchsorted(self.h, np.arange(1 << START_BITS, dtype=np.uint64) << np.uint64(64 - START_BITS))
        at = np.minimum(self.starts[h >> np.uint64(64 - START_BITS)], len(self.h) - 1)
        open_ = np.flatnonzero(self.h[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] < len(self.h)]
            open_ = open_[self.h[at[open_]] < h[open_]]
        at = np.minimum(at, len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.other[at] == other), at, -1)


@dataclass
class Tokens:
    """Tokens of a slice, each text's end token after its words.

    The distinct words of the slice are numbered; the end has the next number, and
    what stands before a text the one after.
    """

    doc: np.ndarray
    code: np.ndarray  # number of the word
    leaf: np.ndarray
    front: np.ndarray  # number of the last of the most frequent words before it in its text, from 1; 0: none
    begin: np.ndarray  # first and last token of each text
    end: np.ndarray
    key: np.ndarray  # by number: hash
    leaves: np.ndarray  # leaf, 2000 before a text
    place: np.ndarray  # in the head, or -1
    other: np.ndarray  # second hash
    lately: np.ndarray  # mix of the leaves of each of the most frequent words and of the one before it in its text


def _tokens(buf: np.ndarray, off: np.ndarray, v: Vocabulary) -> Tokens:
    w, codes, h, other, tail, _ = _keys(buf, off)
    key, other = np.append(h, [END, np.uint64(1)]), np.append(other, [0, 0]).astype(np.int32)
    place = v.find(key[:-1], other[:-1])
    leaves = np.where(place >= 0, v.leaf[place] if len(v.leaf) else -1, -1)
    leaves = np.append(np.where(leaves >= 0, leaves, TOP + np.append(tail, 0).astype(np.int64)), 2000)
    n_docs, n_words = len(off) - 1, len(h)
    size = np.diff(w.ptr) + 1
    end = np.cumsum(size) - 1
    begin = end - size + 1
    code = np.insert(codes, w.ptr[1:], n_words)
    doc = np.repeat(np.arange(n_docs), size)
    leaf = leaves.take(code)
    is_front = leaf < TOP
    is_front[end] = False
    front, seen = np.flatnonzero(is_front), np.cumsum(is_front)
    before = seen[begin] - is_front[begin]  # of earlier texts
    seen -= is_front
    # the last two frequent words, however far back
    last = np.append(2000, leaf[front]).astype(np.uint64)
    second = np.append(last[:1], last[:-1])
    second[before[before < len(front)] + 1] = 2000  # the first one of a text, if it has any
    return Tokens(doc, code, leaf, np.where(seen > np.repeat(before, size), seen, 0), begin, end, key, leaves, np.append(place, -1), other, text.mix(last * np.uint64(4096) + second))


def _rows(t: Tokens, bits: int) -> np.ndarray:
    """Rows of the features of both factors for all tokens."""
    before = len(t.key) - 1
    one, two = np.append(before, t.code[:-1]), np.append([before] * 2, t.code[:-2])[: len(t.code)]
    one[t.begin], two[t.begin] = before, before
    two[t.begin[t.end > t.begin] + 1] = before
    rows = np.empty((FIRST + SECOND, len(t.code)), np.int32)
    leaf = t.leaves.astype(np.uint64)

    def row(f: np.ndarray, own_bits: int = bits) -> np.ndarray:
        return (text.mix(f) >> np.uint64(64 - own_bits)).astype(np.int32)

    row(t.key + np.uint64(11)).take(one, out=rows[0], mode="clip")
    row(t.key + np.uint64(23)).take(two, out=rows[1], mode="clip")
    rows[2] = row((t.key * np.uint64(3) + np.uint64(37)).take(one) + (t.key * np.uint64(7)).take(two))
    rows[3] = row((leaf * np.uint64(4096) + np.uint64(41)).take(one) + leaf.take(two))
    row(t.lately + np.uint64(43)).take(t.front, out=rows[4], mode="clip")
    # the second factor's rows of a class lie together
    row(t.key + np.uint64(53), bits - 5).take(one, out=rows[5], mode="clip")
    row(leaf + np.uint64(71), bits - 5).take(one, out=rows[6], mode="clip")
    row(t.lately + np.uint64(61), bits - 5).take(t.front, out=rows[7], mode="clip")
    rows[FIRST:] += (t.leaf // CLASSES).astype(np.int32) << np.int32(bits - 5)
    rows += np.arange(FIRST + SECOND, dtype=np.int32)[:, None] << np.int32(bits)
    return rows


def _statistics(vocabulary):
    """Blocks of how often each target follows each row, over all tokens of a task, in the narrowest type that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        table = np.zeros(((FIRST + SECOND) << v.bits) * CLASSES, np.uint32)
        for _, buf, off in text.slices(batches, most=text.SLICE_BYTES // 2):
            t = _tokens(buf, off, v)
            class_, inner = (t.leaf // CLASSES).astype(np.int32), (t.leaf % CLASSES).astype(np.int32)
            for f, r in enumerate(_rows(t, v.bits)):
                np.add.at(table, r * np.int32(CLASSES) + (class_ if f < FIRST else inner), np.uint32(1))
        table = table.reshape(-1, BLOCK * CLASSES)
        for b in np.flatnonzero(table.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([table[b].astype(np.min_scalar_type(table[b].max())).tobytes()], pa.binary())], ["block", "n"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by block; a task holds its share of the blocks once."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, n in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = held.setdefault(block, np.zeros(BLOCK * CLASSES))
            buf = n.as_buffer()
            own += np.frombuffer(buf, f"u{buf.size // (BLOCK * CLASSES)}")
    for block, n in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n.astype(np.float32).tobytes()], pa.binary())], ["block", "n"])


def _values(n: np.ndarray, total: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logs of how much more often targets follow a row than they stand anywhere."""
    return np.log((n + PRIOR * np.exp(prior)) / (total + PRIOR)[..., None]) - prior


def _bucket(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(total + 1) / 2, BUCKETS - 1).astype(np.int64)


def _prepared(counts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes of all rows, and the scale of each factor's steps; the rows' values take the place of the counts.

    A weight's scale is the variance of its rows' values under the rows' own shares of
    targets, summed over all training tokens; times the number of features it bounds
    the curvature, since the features of a token add up.
    """
    rows = 1 << v.bits
    sizes, scale = np.zeros(len(counts), np.float32), np.zeros((FIRST + SECOND, BUCKETS))
    for f in range(FIRST + SECOND):
        for a in range(f * rows, (f + 1) * rows, BLOCK):
            at = slice(a, a + BLOCK)
            n = counts[at].astype(np.float64)
            total = n.sum(1)
            prior = v.first[None] if f < FIRST else v.second[(np.arange(a - f * rows, a - f * rows + BLOCK) >> (v.bits - 5))]
            value = _values(n, total, prior)
            n /= np.maximum(total, 1)[:, None]
            spread = (n * value**2).sum(1) - (n * value).sum(1) ** 2
            scale[f] += np.bincount(_bucket(total), total * spread, BUCKETS)
            sizes[at], counts[at] = total, value
    return sizes, [scale[:FIRST].reshape(-1) * FIRST, scale[FIRST:].reshape(-1) * SECOND]


def _weighted(values: np.ndarray, sizes: np.ndarray, v: Vocabulary, weights: list[np.ndarray]) -> np.ndarray:
    """Values of all rows times their weights, in place of the values; rows of feature f begin at f << bits.

    The first feature of each factor holds the logs of the targets' own shares too.
    """
    rows = 1 << v.bits
    every = np.concatenate(weights).reshape(-1, BUCKETS)
    for f in range(FIRST + SECOND):
        for a in range(f * rows, (f + 1) * rows, BLOCK):
            at = slice(a, a + BLOCK)
            prior = v.first[None] if f < FIRST else v.second[(np.arange(a - f * rows, a - f * rows + BLOCK) >> (v.bits - 5))]
            values[at] = values[at] * every[f][_bucket(sizes[at])][:, None] + (prior if f in (0, FIRST) else 0)
    return values


def _gradient(values: np.ndarray, sizes: np.ndarray, weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, want: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Gradient of a batch; parameter f * BUCKETS + b is feature f's weight for rows of bucket b.

    A token is judged by the counts without itself: that moves all values of a row
    alike, which a softmax does not see, but for the value of the target.
    """
    size = sizes.take(rows)
    of = np.arange(len(rows))[:, None] * BUCKETS + _bucket(size)
    at = np.arange(0, len(want) * CLASSES, CLASSES) + want
    own = prior.take(at if len(prior) > 1 else want)
    w, g = weights.astype(np.float32).take(of), held[:, : len(want)]
    mine = np.empty(rows.shape, np.float32)
    for f, r in enumerate(rows):
        values.take(r, 0, g[f], "clip")
        g[f].reshape(-1).take(at, out=mine[f], mode="clip")
    seen = np.exp(mine + own) * (size + np.float32(PRIOR))
    less = np.log(np.maximum(seen - 1, np.float32(PRIOR) * np.exp(own)) / seen)
    z = np.einsum("fnk,fn->nk", g, w, order="C")
    z += prior
    z.reshape(-1)[at] += np.einsum("fn,fn->n", w, less)
    np.exp(np.minimum(z, 80, out=z), out=z)
    scale = 1 / np.maximum(z @ ONES, np.float32(1e-30))
    mine += less * (1 - z.take(at) * scale)
    for f in range(len(rows)):
        mine[f] -= np.einsum("nk,nk->n", z, g[f]) * scale
    return np.bincount(of.reshape(-1), mine.reshape(-1), len(weights))


def _gradients(vocabulary, table, weights: list[np.ndarray]):
    """Rows (factor, place, value) of the sums of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (values, sizes) = vocabulary.value, table.value
        first, second = v.first.astype(np.float32)[None], v.second.astype(np.float32)
        sums, held = [np.zeros(len(w)) for w in weights], np.empty((FIRST, SMALL, CLASSES), np.float32)
        for _, buf, off in text.slices(batches, most=text.SLICE_BYTES // 2):
            t = _tokens(buf, off, v)
            rows, class_, inner = _rows(t, v.bits), t.leaf // CLASSES, t.leaf % CLASSES
            for a in range(0, len(t.doc), SMALL):
                at = slice(a, a + SMALL)
                sums[0] += _gradient(values, sizes, weights[0], first, rows[:FIRST, at], class_[at], held)
                sums[1] += _gradient(values, sizes, weights[1], second.take(class_[at], 0), rows[FIRST:, at], inner[at], held[:SECOND])
        for factor, gradient in enumerate(sums):
            at = np.flatnonzero(gradient)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), factor, np.int32)), pa.array(at.astype(np.int32)), pa.array(gradient[at])], ["factor", "place", "value"])

    return run


SCORED = "row long, doc_id long, held_out boolean, h long, other int, n long, n_tokens long, n_known long, base double, model double"
SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def _log_p(value: np.ndarray, rows: np.ndarray, want: np.ndarray) -> np.ndarray:
    """log10 of the probabilities of the targets."""
    z = value.take(rows[0], 0)
    held = np.empty_like(z)
    for r in rows[1:]:
        z += value.take(r, 0, held, "clip")
    np.minimum(z, 80, out=z)
    own = z.take(np.arange(0, len(want) * CLASSES, CLASSES) + want).astype(np.float64)
    np.exp(z, out=z)
    return (own - np.log(np.maximum(z @ ONES, 1e-30).astype(np.float64))) / np.log(10)


def _score(vocabulary, weighted):
    """A row for each document without its rare words, and one for each rare word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, value = vocabulary.value, weighted.value
        log_all = np.log10(v.tokens + v.types + 1)
        log_count = np.log10(np.append(v.count, 0) + 1.0)
        for rows, buf, off in text.slices(batches, most=text.SLICE_BYTES // 2):
            t = _tokens(buf, off, v)
            n_docs, n = len(off) - 1, len(t.doc)
            score = np.empty(n)
            features, class_, inner = _rows(t, v.bits), t.leaf // CLASSES, t.leaf % CLASSES
            for a in range(0, n, BATCH):
                at = slice(a, a + BATCH)
                score[at] = _log_p(value, features[:FIRST, at], class_[at]) + _log_p(value, features[FIRST:, at], inner[at])
            place = t.place.take(t.code)
            known = log_count[t.place].take(t.code)  # 0 where there is no place
            tail = t.leaf >= TOP
            score += np.where(tail, known - v.within[np.maximum(t.leaf - TOP, 0)], 0)
            sums = [np.bincount(t.doc, x, n_docs) for x in (known - log_all, score)]
            count = np.bincount(t.doc[place >= 0], minlength=n_docs)
            none, zero = pa.nulls(n_docs, pa.int64()), pa.nulls(n_docs, pa.int32())
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], none, zero, none, pa.array(t.end - t.begin + 1), pa.array(count), *map(pa.array, sums)], SCORED_NAMES)
            rare = place < 0
            rare[t.end] = False
            if rare.any():
                key, times = np.unique(t.doc[rare] * len(t.key) + t.code[rare], return_counts=True)
                doc, code = key // len(t.key), key % len(t.key)
                m = len(key)
                long, double = pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), long, pa.nulls(m, pa.bool_()), pa.array(t.key[code].view(np.int64)), pa.array(t.other[code]), pa.array(times.astype(np.int64)), long, long, double, double], SCORED_NAMES)

    return run


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """The head and the sums by tail group; what comes to the driver has a fixed bound."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    level = F.floor(F.log2("n") * 16)  # 16 for each doubling
    lowest, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if held + r["count"] > HEAD:
            break
        lowest, held = r["level"], held + r["count"]
    head = (counts.filter(level >= lowest) if lowest is not None else counts.limit(0)).toArrow()
    h, other, tail, n = (head.column(c).to_numpy() for c in ("h", "other", "tail", "n"))
    h = h.view(np.uint64)
    order = np.lexsort((other, h))
    h, other, tail, n = h[order], other[order], tail[order].astype(np.int64), n[order]
    top = np.lexsort((h, -n))[:TOP]
    leaf = np.full(len(h), -1)
    leaf[top] = np.arange(len(top))
    v = Vocabulary(h, other, n, leaf, int(total[0] or 0), int(total[1]), 0)
    v.bits = int(np.clip(np.ceil(np.log2(max(v.tokens, 1))) - TOKENS_BITS, LEAST_BITS, MOST_BITS))
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    tokens, types, at = np.zeros(TAILS), np.zeros(TAILS), tails.column("tail").to_numpy().astype(np.int64)
    tokens[at], types[at] = tails.column("n").to_numpy(), tails.column("types").to_numpy()
    np.subtract.at(tokens, tail[top], n[top])
    np.subtract.at(types, tail[top], 1)
    v.within = np.log10(tokens + types + 1)
    leaves = np.zeros(TOP + TAILS)
    leaves[: len(top)] = n[top]
    leaves[TOP:] = tokens
    leaves = leaves.reshape(CLASSES, CLASSES) + 0.5
    v.first, v.second = np.log(leaves.sum(1) / leaves.sum()), np.log(leaves / leaves.sum(1, keepdims=True))
    return v


def _sums(weights: list[np.ndarray], rows: pa.Table) -> list[np.ndarray]:
    """The gradient of each factor."""
    factor, place, value = (rows.column(c).to_numpy() for c in ("factor", "place", "value"))
    out = [np.zeros(len(w)) for w in weights]
    for k, gradient in enumerate(out):
        gradient[place[factor == k]] = value[factor == k]
    return out


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    texts = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    learned = texts.filter(~F.col("held_out"))
    counts = learned.select("text").mapInArrow(_counts, "h long, other int, tail short, n long").groupBy("h", "other", "tail").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    v = _vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    blocks = learned.select("text").mapInArrow(_statistics(shared), "block int, n binary").repartition("block").mapInArrow(_sum_blocks, "block int, n binary").toArrow()
    found = np.zeros(((FIRST + SECOND) << v.bits, CLASSES), np.float32)
    for block, n in zip(blocks.column(0).to_pylist(), blocks.column(1)):
        found[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(n.as_buffer(), np.float32).reshape(BLOCK, CLASSES)
    del blocks
    sizes, scale = _prepared(found, v)
    sent = spark.sparkContext.broadcast((found, sizes))
    weights = [np.full(n * BUCKETS, START) for n in (FIRST, SECOND)]
    moves = [np.zeros(len(w)) for w in weights]
    share = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(STEPS))
    for k in range(STEPS):
        ahead = [w + MOMENTUM * m for w, m in zip(weights, moves)]
        sums = learned.filter(share == k).select("text").mapInArrow(_gradients(shared, sent, ahead), "factor int, place int, value double")
        found_sums = _sums(weights, sums.groupBy("factor", "place").agg(F.sum("value").alias("value")).toArrow())
        moves = [MOMENTUM * m + g / (s / STEPS + RIDGE) for m, g, s in zip(moves, found_sums, scale)]
        weights = [np.clip(w + m, -0.5, 2) for w, m in zip(weights, moves)]
    sent.unpersist()
    weighted = spark.sparkContext.broadcast(_weighted(found, sizes, v, weights))
    numbered = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    scored = scratch.keep(numbered.mapInArrow(_score(shared, weighted), SCORED), "scored")
    rare = scored.filter(F.col("h").isNotNull()).select("row", "h", "other", "n").join(counts.select("h", "other", F.col("n").alias("c")), ["h", "other"])
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("known"))
    told = scored.filter(F.col("h").isNull()).join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return told.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
