"""Operator 9: quality rules as a short-circuit cascade.

The base figures of every text come from a few numpy passes over a slice.  Texts
that pass the base rule go through the cascade: each task times every rule on a
sample of the first texts it meets and counts what the rule rejects there, puts
the rules in order of rejections per second, and then gives each rule only what
the ones before it left.  A text is kept if no rule rejects it, so the order
changes the cost and never the verdict.

Defined results: a null or empty text has no words and fails the base rule;
lines are compared as they stand, without their newline; repeated rows give
repeated rows; a null id keeps its row.  quality() reads doc_id and text alone;
keep_good() passes all columns of the kept rows on unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import text

#: Texts that a task tries the rules on before it orders them.
SAMPLE = 64


def _per_text(mark: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a mark on bytes (or words) between the offsets."""
    total = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows sorted by group and key, and whether each differs from the one before."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


@dataclass
class Texts:
    """Texts of one slice."""

    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, which: np.ndarray) -> Texts:
        """Some of the texts, in a buffer of their own."""
        if len(which) == len(self):
            return self
        size = np.diff(self.off)[which]
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(self.off[which], size)
        return Texts(self.buf[at], off)

    @cached_property
    def words(self) -> text.Words:
        return text.words(self.buf, self.off)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.ptr)

    @cached_property
    def run(self) -> np.ndarray:
        return text.prefix_hash(self.buf)

    def word_chars(self) -> np.ndarray:
        return _per_text(~text.SEPARATOR[self.buf] & ((self.buf & 0xC0) != 0x80), self.off)

    def n_symbols(self) -> np.ndarray:
        return _per_text(SYMBOL[self.buf], self.off)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of the lines with a word."""
        newline = np.flatnonzero(self.buf == 10)
        start = np.unique(np.concatenate([self.off[:-1][np.diff(self.off) > 0], newline + 1]))
        start = start[start < len(self.buf)]
        if not len(start):
            return start, start, start
        owner = np.searchsorted(self.off, start, "right") - 1
        stop = np.append(newline, len(self.buf))[np.searchsorted(newline, start)]
        end = np.minimum(stop, self.off[owner + 1])
        has = np.concatenate([[0], np.cumsum(~text.SEPARATOR[self.buf])])
        some = has[end] > has[start]
        return start[some], end[some], owner[some]

    def n_dup_lines(self) -> np.ndarray:
        start, end, owner = self.lines
        order, new = _repeats(owner, text.span_hash(self.run, start, end))
        return np.bincount(owner[order][~new], minlength=len(self))

    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        doc = w.doc()
        three = text.windows(text.span_hash(self.run, w.start, w.end), 3)
        inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
        order, new = _repeats(doc[inside], three[inside])
        again = ~new
        again[:-1] |= ~new[1:]  # the first of its kind, if another follows
        at = inside[order[again]]
        mark = np.zeros(len(doc), bool)
        for k in range(3):
            mark[at + k] = True
        return _per_text(mark, w.ptr)

    def share_of_words(self, mark: np.ndarray) -> np.ndarray:
        """Words with a marked byte, as a share of all."""
        w = self.words
        total = np.concatenate([[0], np.cumsum(mark)])
        return _per_text(total[w.end] > total[w.start], w.ptr) / np.maximum(self.n_words, 1)


SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[0xC2:] = True  # one byte of each character beyond ASCII
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def _line_share(t: Texts, mark: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    start, end, owner = t.lines
    n = np.bincount(owner, minlength=len(t))
    return np.bincount(owner[mark(start, end)], minlength=len(t)) / np.maximum(n, 1)


def _bullets(t: Texts) -> np.ndarray:
    return _line_share(t, lambda s, e: np.isin(t.buf[s], [*b"-*+"])) > 0.9


def _ellipses(t: Texts) -> np.ndarray:
    dot = t.buf == 46
    return _line_share(t, lambda s, e: (e - s >= 3) & dot[e - 1] & dot[np.maximum(e - 2, 0)] & dot[np.maximum(e - 3, 0)]) > 0.3


def _shouting(t: Texts) -> np.ndarray:
    up, all_ = _per_text(UPPER[t.buf], t.off), _per_text(LETTER[t.buf], t.off)
    return up > 0.5 * np.maximum(all_, 1)


def _mean_word(t: Texts) -> np.ndarray:
    mean = t.word_chars() / np.maximum(t.n_words, 1)
    return (mean < 2.5) | (mean > 14)


#: Each rule tells which texts it rejects; all texts have 50 words at least.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "symbols": lambda t: t.n_symbols() > 0.1 * t.n_words,
    "shouting": _shouting,
    "exclamation": lambda t: _per_text(t.buf == 33, t.off) > 0.3 * t.n_words,
    "mean_word": _mean_word,
    "wordless": lambda t: t.share_of_words(LETTER[t.buf]) < 0.7,
    "digits": lambda t: _per_text(DIGIT[t.buf], t.off) > 0.25 * np.maximum(t.word_chars(), 1),
    "bullets": _bullets,
    "ellipses": _ellipses,
    "dup_lines": lambda t: t.n_dup_lines() > 0.5 * np.maximum(np.bincount(t.lines[2], minlength=len(t)), 2),
    "braces": lambda t: _per_text((t.buf == 123) | (t.buf == 125), t.off) > 0.05 * t.n_words,
}


def order_rules(sample: Texts, rules: dict[str, Callable[[Texts], np.ndarray]]) -> list[str]:
    """Names of the rules by rejections per second on the sample (then by name)."""
    gain = {}
    for name, rule in rules.items():
        fresh = Texts(sample.buf, sample.off)  # nothing computed before
        began = time.perf_counter()
        rejected = int(np.count_nonzero(rule(fresh)))
        gain[name] = (rejected + 0.5) / (time.perf_counter() - began + 1e-6)
    return sorted(rules, key=lambda n: (-gain[n], n))


def cascade(texts: Texts, order: list[str], rules: dict[str, Callable[[Texts], np.ndarray]]) -> np.ndarray:
    """Numbers of the texts that no rule rejects."""
    left = np.arange(len(texts))
    for name in order:
        if not len(left):
            break
        bad = rules[name](texts)
        if bad.any():
            left, texts = left[~bad], texts.take(np.flatnonzero(~bad))
    return left


def base_figures(t: Texts) -> dict[str, np.ndarray]:
    found = {"n_words": t.n_words, "word_chars": t.word_chars(), "n_symbols": t.n_symbols(), "n_dup_lines": t.n_dup_lines(), "n_repeat_words": t.n_repeat_words()}
    return found | {"base_failed": (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])}


def _judged(batches: Iterator[pa.RecordBatch], rules: dict, sample: int) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    order: list[str] = []
    for rows, buf, off in text.slices(batches):
        t = Texts(buf, off)
        found = base_figures(t)
        passed = np.flatnonzero(~found["base_failed"])
        rest = t.take(passed)
        if not order and len(rest):
            order = order_rules(rest.take(np.unique(np.linspace(0, len(rest) - 1, sample).astype(int))), rules)
        kept = np.zeros(len(t), bool)
        kept[passed[cascade(rest, order, rules)]] = True
        yield rows, found | {"kept": kept}


def quality(docs: DataFrame, rules: dict[str, Callable[[Texts], np.ndarray]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base figures, base_failed and kept of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _judged(batches, rules, sample):
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in longs), "base_failed boolean", "kept boolean"]))


def keep_good(docs: DataFrame, rules: dict[str, Callable[[Texts], np.ndarray]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows of the kept documents, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _judged(batches, rules, sample):
            yield rows.filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)
