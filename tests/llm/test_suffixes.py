"""Repeated passages against all windows of 50 words."""

import random
import re
from collections import defaultdict

import pytest

from gridweave.llm import suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
r = random.Random(3)


def prose(n):
    return " ".join(f"w{r.randrange(10**7)}" for _ in range(n))


def words(t):
    return WORD.findall(t or "")


def holders(rows):
    own = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            own[tuple(w[k : k + 50])].add(i)
    return own


def first_holders(rows):
    """Document to the first holder of each word, None outside of repeated windows."""
    own, out = holders(rows), {}
    for i, t in rows:
        w = words(t)
        first = [None] * len(w)
        for k in range(len(w) - 49):
            ids = own[tuple(w[k : k + 50])]
            if len(ids) > 1:
                m = min(ids)
                for j in range(k, k + 50):
                    if first[j] is None or (first[j] != i and (m == i or m < first[j])):
                        first[j] = m
        if any(x is not None for x in first):
            out[i] = first
    return out


def told(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    n, out = {i: len(words(t)) for i, t in rows}, {}
    for s in suffixes.spans(df, **options).collect():
        first = out.setdefault(s.doc_id, [None] * n[s.doc_id])
        assert not any(x is not None for x in first[s.start_word : s.end_word])
        first[s.start_word : s.end_word] = [s.first_doc_id] * s.n_words
        assert s.kept == (s.first_doc_id == s.doc_id)
        assert s.span_start <= s.start_word < s.end_word <= s.span_end and s.span_end - s.span_start >= 50
    return out


def joined_passages():
    a, b = prose(80), prose(80)
    return [(1, a), (2, f"{a} {b}"), (3, f"{a} {b}")]


def repeated_phrase():
    phrase = " ".join([prose(7)] * 200)
    return [(1, f"{prose(30)} {phrase} {prose(20)}"), (2, f"{prose(40)} {phrase} {prose(9)}")]


def shorter_partners():
    """Two documents share 50 words, and many more share 49 of them."""
    p = prose(50).split()
    rows = [(1, f"{prose(60)} {' '.join(p)} {prose(60)}"), (2, f"{prose(30)} {' '.join(p)} {prose(60)}")]
    for k in range(12):
        rows += [(3 + k, f"{prose(20)} {' '.join(p[1:])} {prose(30)}"), (30 + k, f"{prose(20)} {' '.join(p[:-1])} {prose(30)}")]
    return rows


def segments():
    """Texts put together from a few segments, with copies, negative ids and periodic texts."""
    parts = [prose(r.choice([3, 10, 24, 25, 26, 30, 49, 50, 51, 60, 75, 120])) for _ in range(25)]
    rows = [(i * 3 - 50, " ".join(r.choice(parts) if r.random() < 0.8 else prose(r.randrange(1, 40)) for _ in range(r.randrange(1, 9)))) for i in range(150)]
    return [*rows, (1001, rows[4][1]), (1002, rows[4][1]), (1003, "x " * 300), (1004, "x " * 280), (1005, None), (1006, "")]


def common_passage():
    """Many documents share a passage, with surroundings of their own or shared by some."""
    p = prose(70)
    some = [prose(4) for _ in range(3)]
    return [(k, f"{prose(30)} {r.choice(some) if k % 2 else ''} {p} {r.choice(some) if k % 3 else prose(5)} {prose(30)}") for k in range(120)]


@pytest.mark.parametrize("group", [suffixes.GROUP, 20, 1])
@pytest.mark.parametrize("make", [joined_passages, repeated_phrase, shorter_partners, segments, common_passage])
def test_spans_equal_all_windows(spark, make, group):
    rows = make()
    assert told(spark, rows, group=group) == first_holders(rows)


@pytest.mark.parametrize("make", [joined_passages, segments, common_passage])
def test_cutting_loses_no_repeated_passage(spark, make):
    rows = make()
    df = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], "doc_id long, text string, cut_doc int, cut_spans int, n_chars long").repartition(3)
    cut = suffixes.cut_repeats(df)
    assert cut.dtypes == df.dtypes
    after = {c.doc_id: c for c in cut.collect()}
    assert all((c.cut_doc, c.cut_spans) == (5, 6) and c.n_chars in (7, len(c.text or "")) for c in after.values())
    first = first_holders(rows)
    left = {tuple(w[k : k + 50]) for c in after.values() for w in [words(c.text)] for k in range(len(w) - 49)}
    for i, t in rows:
        w, f = words(t), first.get(i, [None] * len(words(t)))
        own = [x for x, m in zip(w, f) if m in (None, i)]
        assert words(after[i].text) == own if own or not w else i not in after
    assert all(window in left for window, ids in holders(rows).items() if len(ids) > 1)


def test_rows_of_one_id_and_null_ids(spark):
    p = prose(60)
    rows = [(7, p), (7, f"{prose(100)} {p} {prose(20)}"), (None, p), (9, f"{prose(5)} {p}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(s.doc_id, s.first_doc_id, s.kept) for s in suffixes.spans(df).collect()}
    assert (9, 7, False) in got and {g[0] for g in got} == {7, 9}
    assert suffixes.spans(df.filter("doc_id = 7")).count() == 0
    assert suffixes.cut_repeats(df).filter("doc_id is null").count() == 1
