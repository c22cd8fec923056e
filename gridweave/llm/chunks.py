"""Operator 4: repeated substrings by content-defined chunks.

A gear hash rolls over the bytes of a text: each step shifts the hash left by one
and adds a random number of the byte, so its 16 bits depend on the last 16 bytes.
A chunk ends after each byte whose hash is the least of some WINDOW consecutive
ones (the leftmost, if several are), so places follow from the bytes around them
alone, an insertion moves only the chunks it touches, and no two places of varied
text are more than WINDOW bytes apart.  A place whose hash also stands within
the 16 bytes before it is none: text that repeats a few bytes has no places, and
stretches without one are cut every MAX_CHUNK bytes from the last one.

Chunks are found again by a 64-bit digest and their length.  Those that two
documents have are kept (least and greatest id by digest, summed before the
shuffle; hot digests are broadcast), and chunks of a document that follow each
other and are all kept make a span, which counts with MIN_WORDS words or more.  A
passage that two documents share loses 16 bytes and up to WINDOW bytes at its
beginning and up to WINDOW bytes at its end, so a passage of more than
2 * WINDOW + 16 bytes and MIN_WORDS words is sure to be found, unless it repeats a
few bytes.  Spans are parted where the first holder of the chunks changes.

The hash needs no byte loop: the sum over 16 bytes is built by doubling.

Defined results: null and empty texts have no chunks; rows with a null id are
left out; rows of one id are one document (they do not match each other; if their
texts differ, places refer to either); an empty table gives no rows.  Only doc_id
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import text
from gridweave.llm.membership import spread_join
from gridweave.llm.suffixes import over
from gridweave.sources.scratch import Scratch

BITS = 16
WINDOW, MAX_CHUNK = 96, 2048
MIN_WORDS = 15
#: Chunks of one digest that are not hot, at least.
GROUP = 1 << 16
GEAR = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << BITS, 256, dtype=np.uint16)
NO_PLACE = np.uint16((1 << BITS) - 1)


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte."""
    h, n = GEAR[buf], 1
    while n < BITS:
        shifted = h[:-n] << np.uint16(n)
        h = h.copy()
        h[n:] += shifted
        n *= 2
    return h


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the chunks of all texts, in order."""
    size = len(buf)
    h = np.clip(gear(buf), np.uint16(1), NO_PLACE - np.uint16(1))
    # a text's first bytes would still show the text before it
    edge = (off[:-1][np.diff(off) > 0][:, None] + np.arange(BITS - 1)).reshape(-1)
    h[edge[edge < size]] = NO_PLACE
    start = off[:-1][np.diff(off) > 0]
    if size > WINDOW:
        least = over(h, WINDOW, np.minimum)
        across = np.zeros(size + 1, np.int32)  # windows that reach into the next text
        np.add.at(across, np.maximum(off[:-1], off[1:] - WINDOW + 1), 1)
        np.add.at(across, off[1:], -1)
        least[np.cumsum(across)[: len(least)] > 0] = 0
        most = over(np.concatenate([np.zeros(WINDOW - 1, np.uint16), least, np.zeros(WINDOW - 1, np.uint16)]), WINDOW, np.maximum)
        at = np.flatnonzero((most == h) & (h < NO_PLACE))
        at = at[at >= BITS]
        once = np.ones(len(at), bool)
        for k in range(1, BITS + 1):
            once &= h[at] != h[at - k]
        cut = at[once] + 1
        start = np.union1d(start, cut[cut < size])
    gap = np.diff(np.append(start, size))
    extra = np.maximum(gap - 1, 0) // MAX_CHUNK
    if extra.any():
        more = np.repeat(start, extra) + MAX_CHUNK * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        start = np.union1d(start, more)
    return start


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in text.slices(batches):
        start = chunk_starts(buf, off)
        end = np.append(start[1:], len(buf))
        owner = np.searchsorted(off, start, "right") - 1
        w = text.words(buf, off)
        n_words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
        digest = text.span_hash(text.prefix_hash(buf), start, end)
        first = np.searchsorted(start, off[:-1])
        small = [(np.arange(len(start)) - first[owner]), start - off[owner], end - off[owner], n_words]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), *(pa.array(c.astype(np.int32)) for c in small), pa.array(digest.view(np.int64))], ["doc_id", "chunk", "start_byte", "end_byte", "n_words", "digest"])


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk (its number), start_byte, end_byte, n_words (that begin in it), digest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    return texts.mapInArrow(_chunks, "doc_id long, chunk int, start_byte int, end_byte int, n_words int, digest long")


SPANS = "doc_id long, start_byte int, end_byte int, n_words int, n_chunks int, first_doc_id long, kept boolean, span_start int, span_end int"


def _spans(min_words: int):
    """Spans of the documents, from the list of shared chunks of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if not len(flat):
                continue
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            start, end, n_words, first = (flat.field(k).to_numpy() for k in range(4))
            order = np.lexsort((first, end, start, of))
            of, start, end, n_words, first = (c[order] for c in (of, start, end, n_words, first))
            new = np.ones(len(of), bool)  # repeated rows give a chunk more than once
            new[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
            of, start, end, n_words, first = (c[new] for c in (of, start, end, n_words, first))
            turn = np.ones(len(of), bool)
            turn[1:] = (of[1:] != of[:-1]) | (start[1:] != end[:-1])
            span = np.cumsum(turn) - 1
            head = np.flatnonzero(turn)
            tail = np.append(head[1:], len(of)) - 1
            enough = np.add.reduceat(n_words, head)[span] >= min_words
            turn[1:] |= first[1:] != first[:-1]
            piece = np.flatnonzero(turn)
            last = np.append(piece[1:], len(of)) - 1
            words, keep = np.add.reduceat(n_words, piece), enough[piece]
            doc, i = batch.column(0).to_numpy()[of[piece]], span[piece]
            columns = [doc, start[piece], end[last], words, last - piece + 1, first[piece], first[piece] == doc, start[head][i], end[tail][i]]
            types = [np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, bool, np.int32, np.int32]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(t)) for c, t in zip(columns, types)], [c.split()[0] for c in SPANS.split(", ")])

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, group: int = GROUP) -> DataFrame:
    """doc_id, start_byte, end_byte, n_words, n_chunks, first_doc_id, kept, span_start, span_end: chunks that other documents have too.

    span_start and span_end bound a span of min_words words or more; start_byte and
    end_byte the piece of it whose chunks have this first holder.  kept: this
    document is the first holder.  group: rows of a digest that is not hot, at least.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    all_ = scratch.keep(chunks(docs).select("doc_id", "start_byte", "end_byte", "n_words", "digest"), "all").withColumn("size", F.col("end_byte") - F.col("start_byte"))
    shared = all_.groupBy("digest", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first <> last").drop("last")
    shared = scratch.keep(shared, "shared")
    hits = spread_join(all_, shared, ["digest", "size"], all_.count(), group)
    lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct("start_byte", "end_byte", "n_words", "first")).alias("chunks"))
    return lists.mapInArrow(_spans(min_words), SPANS)
