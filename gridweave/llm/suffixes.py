"""Operator 7: passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only where the content selects them: at words whose SEED-word
hash is the least of some SPREAD consecutive ones.  A passage of
SEED + SPREAD - 1 = MIN_WORDS words has SPREAD seeds, and the leftmost least one
of them is selected in every document that holds the passage.  So each window of
MIN_WORDS words belongs to one suffix, which sees it as `a` words left of its
seed and SIDE - a words right of it.

1. Every text gives its selected positions.  Seeds that only one content has are
   dropped; texts that are whole copies of another stand back behind the
   smallest id of their class.
2. Each remaining suffix carries as many words on either side of its seed as its
   own windows reach.  Suffixes of one slice with equal sides travel as one row
   with their documents and places.
3. The suffixes of a seed are sorted by their right side, neighbours are compared
   (the words they share), and for each a the runs that share SIDE - a words or
   more are parted by their a words to the left.  What stays together holds the
   same window: its least and greatest document tell whether it repeats, and
   which document has it first.
4. Seeds with more than GROUP suffixes are not held in one task: their rows meet
   by the hash of each window, with the least and greatest document summed before
   the shuffle, and the answer is joined back to the rows.
5. Windows are joined to spans of any length, and these are parted where the
   first holder changes.

The result is the same as of comparing all windows of MIN_WORDS words of all
texts: a word is in a span if it lies in a window that another document has too,
and a window's first holder keeps all of its words, so no passage is lost when
the other pieces are cut.

Words are compared as they stand, by hashes.  A match needs two different ids.

Defined results: null, empty and short texts have no spans; rows with a null id
are left out; rows of one id are one document (they do not match each other; if
their texts differ, places refer to either); ties do not arise, as the first
holder is the smallest id; an empty table gives no rows.  spans() reads the id
and text alone; cut_repeats() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import text
from gridweave.llm.membership import spread_join
from gridweave.sources.scratch import Scratch, free_name

MIN_WORDS = 50
SEED = 25
SPREAD = MIN_WORDS - SEED + 1
SIDE = SPREAD - 1
#: Suffixes of one seed that a task holds at once.
GROUP = 1 << 14
#: Positions whose sides are laid out at once.
POSITIONS = 1 << 15
LAST = np.uint64(2**64 - 1)
STEP = np.uint64(0xD6E8FEB86659FD93)


def over(x: np.ndarray, n: int, fold: np.ufunc) -> np.ndarray:
    """fold over each n consecutive entries."""
    size = 1
    while size * 2 <= n:
        x = fold(x[:-size], x[size:])
        size *= 2
    return fold(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def selected(hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected word positions of all texts, and their seeds."""
    if len(hashes) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seed = text.windows(hashes, SEED)
    n = np.diff(ptr)
    end = np.repeat(ptr[1:], n)[: len(seed)]
    whole = np.arange(len(seed)) + SEED <= end
    ranked = np.where(whole, seed, LAST)
    least = over(ranked, SPREAD, np.minimum)
    padded = np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD - 1, np.uint64)])
    most = over(padded, SPREAD, np.maximum)
    at = np.flatnonzero((most == ranked) & whole & np.repeat(n >= MIN_WORDS, n)[: len(seed)])
    return at, seed[at]


def _hashed(buf: np.ndarray, off: np.ndarray) -> tuple[text.Words, np.ndarray]:
    w = text.words(buf, off)
    return w, text.span_hash(text.prefix_hash(buf), w.start, w.end)


def _digests(hashes: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's sequence of words."""
    place = (np.arange(len(hashes)) - np.repeat(ptr[:-1], np.diff(ptr))).astype(np.uint64)
    out = []
    for salt in (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1342543DE82EF95)):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(text.mix(hashes + text.mix(place + salt)), out=total[1:])
        out.append((total[ptr[1:]] - total[ptr[:-1]]).view(np.int64))
    return out


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of MIN_WORDS or more, with its selected positions and their seeds."""
    for rows, buf, off in text.slices(batches):
        w, hashes = _hashed(buf, off)
        at, seed = selected(hashes, w.ptr)
        bounds = np.searchsorted(at, w.ptr)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
        offsets = pa.array(bounds.astype(np.int32))
        long = pa.array(np.diff(w.ptr) >= MIN_WORDS)
        columns = [rows.column(0), pa.array(np.diff(w.ptr)), *map(pa.array, _digests(hashes, w.ptr)), pa.ListArray.from_arrays(offsets, pa.array((at - w.ptr[owner]).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(seed.view(np.int64)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "d1", "d2", "at", "seeds"]).filter(long)


def _packed(codes: np.ndarray) -> pa.Array:
    """Rows of 32-bit words as binary, so that byte order is word order."""
    width = codes.shape[1] * 4
    data = np.ascontiguousarray(codes.astype(">u4"))
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, .. words of each row of codes."""
    out = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
    for k in range(codes.shape[1]):
        out[k + 1] = out[k] * STEP + codes[:, k]
    return out


#: Rows of either kind: sides with the seed as key, or (hot seeds) windows with a digest of all as key.
CONTEXT = "key long, near binary, far binary, near_n int, far_n int, lo long, hi long, wins array<long>, docs array<long>, ats array<int>"
MATCHES = "doc long, start int, stop int, first long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of suffixes with equal sides: their sides, or for hot seeds the hashes of their windows."""
    for rows, buf, off in text.slices(batches):
        w, hashes = _hashed(buf, off)
        for column, hot in ((2, False), (3, True)):
            lists = rows.column(column)
            owner = np.repeat(np.arange(len(off) - 1), np.diff(np.asarray(lists.offsets)))
            local = lists.flatten().to_numpy().astype(np.int64)
            fits = local + SEED <= np.diff(w.ptr)[owner]  # another text of this id may be longer
            owner, local = owner[fits], local[fits]
            for a in range(0, len(local), POSITIONS):
                yield from _context_rows(w, hashes, rows.column(0).to_numpy(), owner[a : a + POSITIONS], local[a : a + POSITIONS], hot)


def _context_rows(w: text.Words, hashes: np.ndarray, ids: np.ndarray, own: np.ndarray, place: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
    seeds = text.windows(hashes, SEED)
    code = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), 1)
    k = np.arange(SIDE)
    at = place + w.ptr[own]
    seed = seeds[at]
    # how far the seed is the leftmost least one
    n_left, n_right = np.minimum(place, SIDE), np.minimum(w.ptr[own + 1] - at - SEED, SIDE)
    before, after = np.maximum(at[:, None] - 1 - k, 0), np.minimum(at[:, None] + 1 + k, len(seeds) - 1)
    stop = (seeds[before] <= seed[:, None]) | (k >= n_left[:, None])
    n_left = np.where(stop.any(1), stop.argmax(1), SIDE)
    stop = (seeds[after] < seed[:, None]) | (k >= n_right[:, None])
    n_right = np.where(stop.any(1), stop.argmax(1), SIDE)
    use = n_left + n_right >= SIDE
    if not use.any():
        return
    own, place, at, seed, n_left, n_right = (x[use] for x in (own, place, at, seed, n_left, n_right))
    right = np.where(k < n_right[:, None], code[np.minimum(at[:, None] + SEED + k, len(code) - 1)], 0)
    left = np.where(k < n_left[:, None], code[np.maximum(at[:, None] - 1 - k, 0)], 0)
    hr, hl = _prefixes(right), _prefixes(left)
    digest = text.mix(seed + text.mix(hr[SIDE] + text.mix(hl[SIDE])) + (n_left * 64 + n_right).astype(np.uint64))
    doc = ids[own]
    order = np.lexsort((place, doc, digest))
    new = np.ones(len(order), bool)
    new[1:] = digest[order][1:] != digest[order][:-1]
    head = np.flatnonzero(new)
    i = order[head]
    n = len(i)
    docs, ats = doc[order], place[order].astype(np.int32)
    offsets = pa.array(np.append(head, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (docs, ats)]
    if hot:
        split = np.arange(SIDE + 1)[:, None]
        wins = text.mix(seed[i] + text.mix(hr[::-1][:, i] + STEP * text.mix(hl[:, i])))
        ok = (split <= n_left[i]) & (SIDE - split <= n_right[i])
        flat = pa.array(wins.T.reshape(-1).view(np.int64), mask=~ok.T.reshape(-1))
        windows = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * (SIDE + 1)).astype(np.int32)), flat)
        binary, int_ = pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())
        columns = [pa.array(digest[i].view(np.int64)), binary, binary, int_, int_, pa.array(docs[head]), pa.array(docs[np.append(head[1:], len(order)) - 1]), windows]
    else:
        long = pa.nulls(n, pa.int64())
        columns = [pa.array(seed[i].view(np.int64)), _packed(right[i]), _packed(left[i]), pa.array(n_right[i].astype(np.int32)), pa.array(n_left[i].astype(np.int32)), long, long, pa.nulls(n, pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays([*columns, *lists], _names(CONTEXT))


def _told(hit: np.ndarray, first: np.ndarray, docs: pa.ListArray, ats: pa.ListArray) -> pa.RecordBatch:
    """Matches from the windows [split, row] that repeat and their first holders, for all members of the rows."""
    hit, first = np.ascontiguousarray(hit.T), np.ascontiguousarray(first.T)
    same = hit[:, 1:] & hit[:, :-1] & (first[:, 1:] == first[:, :-1])
    edge = np.zeros((len(hit), 1), bool)
    begin, end = hit & ~np.concatenate([edge, same], 1), hit & ~np.concatenate([same, edge], 1)
    row, low = np.nonzero(begin)
    high = np.nonzero(end)[1]
    offsets = np.asarray(docs.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    n = np.diff(offsets)[row]
    which = np.repeat(np.arange(len(row)), n)
    member = offsets[row][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    doc, at = docs.flatten().to_numpy()[member], ats.flatten().to_numpy()[member]
    start, stop, holder = at - high[which], at - low[which] + MIN_WORDS, first[row, low][which]
    # members of a row are sorted, so overlapping places of one document follow each other
    new = np.ones(len(doc), bool)
    new[1:] = (which[1:] != which[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1 if len(doc) else head
    return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(start[head].astype(np.int32)), pa.array(stop[tail].astype(np.int32)), pa.array(holder[head])], _names(MATCHES))


def _compare(t: pa.Table) -> pa.RecordBatch:
    """Matches of the suffixes of whole seeds, sorted by seed and right side."""
    t = t.combine_chunks()
    key = t.column("key").to_numpy()
    near, far = (np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(-1, SIDE).astype(np.uint32) for c in ("near", "far"))
    near_n, far_n = (t.column(c).to_numpy() for c in ("near_n", "far_n"))
    docs, ats = (pa.concat_arrays(t.column(c).chunks) for c in ("docs", "ats"))
    offsets = np.asarray(docs.offsets)
    lists = docs.flatten().to_numpy()
    lo, hi = lists[offsets[:-1] - offsets[0]], lists[offsets[1:] - offsets[0] - 1]
    n = len(key)
    differ = near[1:] != near[:-1]
    share = np.where(differ.any(1), differ.argmax(1), SIDE)  # words that neighbours share
    share = np.minimum(share, np.minimum(near_n[1:], near_n[:-1]))
    share = np.concatenate([[-1], np.where(key[1:] == key[:-1], share, -1)])
    left = _prefixes(far)
    hit, first = np.zeros((SIDE + 1, n), bool), np.zeros((SIDE + 1, n), np.int64)
    for a in range(SIDE + 1):
        rows = np.flatnonzero((far_n >= a) & (near_n >= SIDE - a))
        if not len(rows):
            continue
        run = np.cumsum(share < SIDE - a)[rows].astype(np.uint64)
        group = text.mix(left[a, rows] + text.mix(run))
        order = np.argsort(group, kind="stable")
        g = group[order]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(head, len(g)))
        least, most = np.minimum.reduceat(lo[rows[order]], head), np.maximum.reduceat(hi[rows[order]], head)
        hit[a, rows[order]] = np.repeat(least != most, size)
        first[a, rows[order]] = np.repeat(least, size)
    return _told(hit, first, docs, ats)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_compare of sorted rows, some whole seeds at once."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last seed may go on
        if held and (cut or held[0].column(0)[0].as_py() != key[-1]):
            held.append(pa.Table.from_batches([batch.slice(0, cut)]))
            yield _compare(pa.concat_tables(held))
            held = []
        elif cut:
            yield _compare(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(pa.Table.from_batches([batch.slice(cut)]))
    if held:
        yield _compare(pa.concat_tables(held))


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of rows of a hot seed from the splits that repeat and their first holders."""
    for batch in batches:
        answers = batch.column(0)
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(answers.offsets)))
        flat = answers.flatten()
        hit, first = np.zeros((SIDE + 1, batch.num_rows), bool), np.zeros((SIDE + 1, batch.num_rows), np.int64)
        split = flat.field(0).to_numpy()
        hit[split, row] = True
        first[split, row] = flat.field(1).to_numpy()
        yield _told(hit, first, batch.column(1), batch.column(2))


def _hot_matches(rows: DataFrame) -> DataFrame:
    """Matches of the seeds that no task holds: rows meet by the hash of each window."""
    windows = rows.select(F.explode("wins").alias("win"), "lo", "hi").filter("win is not null")
    firsts = windows.groupBy("win").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first <> last").select("win", "first")
    kinds = rows.groupBy("key").agg(F.first("wins").alias("wins")).select("key", F.posexplode("wins").alias("split", "win"))
    answers = kinds.join(firsts, "win").groupBy("key").agg(F.collect_list(F.struct("split", "first")).alias("answers"))
    return rows.join(answers, "key").select("answers", "docs", "ats").mapInArrow(_answered, MATCHES)


def _own_windows(start: np.ndarray, stop: np.ndarray, first: np.ndarray, doc: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of the first of a class of n-word copies: windows that no older document has repeat in its copies alone."""
    free = np.ones(n - MIN_WORDS + 1, bool)
    older = first < doc
    for a, b in zip(start[older].tolist(), stop[older].tolist()):
        free[a : b - MIN_WORDS + 1] = False
    flips = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    a, b = flips[::2], flips[1::2] + MIN_WORDS - 1
    return np.concatenate([start, a]), np.concatenate([stop, b]), np.concatenate([first, np.full(len(a), doc)])


PIECES = "doc_id long, start_word int, end_word int, n_words int, first_doc_id long, kept boolean, span_start int, span_end int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each document, parted where the first holder changes."""
    for batch in batches:
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
        start, stop, first, whole = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for i, doc in enumerate(batch.column(0).to_pylist()):
            s, e, f, own = (x[offsets[i] : offsets[i + 1]] for x in (start, stop, first, whole))
            own = own & (f == doc)
            if own.any():
                s, e, f = _own_windows(s[~own], e[~own], f[~own], doc, int(e[own].max()))
            base = int(s.min())
            size = int(e.max()) - base
            # the smallest holder last, and what this document holds first after all
            order = np.lexsort((-f, f == doc))
            holder, covered = np.zeros(size, np.int64), np.zeros(size, bool)
            for a, b, x in zip((s[order] - base).tolist(), (e[order] - base).tolist(), f[order].tolist()):
                holder[a:b] = x
                covered[a:b] = True
            turn = np.ones(size, bool)
            turn[1:] = (covered[1:] != covered[:-1]) | (holder[1:] != holder[:-1])
            a = np.flatnonzero(turn)
            b = np.append(a[1:], size)
            flips = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
            a, b = a[covered[a]], b[covered[a]]
            span = np.searchsorted(flips[::2], a, "right") - 1
            for column, x in zip(out, (np.full(len(a), doc), a + base, b + base, holder[a], flips[::2][span] + base, flips[1::2][span] + base)):
                column.append(x)
        doc, a, b, holder, low, high = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        columns = [doc, *(x.astype(np.int32) for x in (a, b, b - a)), holder, holder == doc, *(x.astype(np.int32) for x in (low, high))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _names(PIECES))


def spans(docs: DataFrame, key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """doc_id, start_word, end_word, n_words, first_doc_id, kept, span_start, span_end: the repeated spans of each document.

    Words count from 0, ends are exclusive.  span_start and span_end bound the
    maximal span, which has MIN_WORDS or more; start_word and end_word the piece of
    it that has this first holder.  kept: this document is the first holder.
    group: suffixes of one seed above which it is dealt by windows.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    found = scratch.keep(texts.mapInArrow(_positions, "doc long, n_words long, d1 long, d2 long, at array<int>, seeds array<long>"), "found")
    classes = found.groupBy("d1", "d2", "n_words").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last")
    copies = scratch.keep(found.select("doc", "n_words", "d1", "d2").join(classes, ["d1", "d2", "n_words"]).select("doc", F.col("n_words").cast("int").alias("n_words"), "first").distinct(), "copies")
    placed = found.select("doc", "d1", F.inline(F.arrays_zip("at", "seeds")))
    shared = placed.groupBy("seeds").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("seeds", (F.col("n") > group).alias("hot"), "n")
    shared = scratch.keep(shared, "shared")
    total = found.agg(F.sum(F.size("at"))).first()[0] or 0
    hits = spread_join(placed.select("doc", "at", "seeds"), shared, ["seeds"], total, group)
    each = lambda hot: F.array_sort(F.collect_set(F.when(F.col("hot") == hot, F.col("at"))))
    hits = scratch.keep(hits.groupBy("doc").agg(each(False).alias("at"), each(True).alias("hot_at")), "hits")
    scratch.drop("found")
    ours = hits.join(copies.filter("doc <> first").select("doc"), "doc", "left_anti").join(texts, F.col("doc") == F.col("doc_id"))
    context = scratch.keep(ours.select("doc", "text", "at", "hot_at").mapInArrow(_contexts, CONTEXT), "context")
    sides = context.filter("wins is null").select("key", "near", "far", "near_n", "far_n", "docs", "ats")
    matches = sides.repartition("key").sortWithinPartitions("key", "near").mapInArrow(_neighbours, MATCHES)
    if not shared.filter("hot").isEmpty():
        matches = matches.unionByName(_hot_matches(context.filter("wins is not null").select("key", "lo", "hi", "wins", "docs", "ats")))
    matches = scratch.keep(matches, "matches")
    scratch.drop("hits", "shared", "context")
    # copies repeat whole, and what their first has from others they have from there too
    whole = copies.select("doc", F.lit(0).alias("start"), F.col("n_words").alias("stop"), "first", F.lit(True).alias("whole"))
    older = matches.filter("first < doc").withColumnRenamed("doc", "rep")
    passed = copies.filter("doc <> first").select("doc", F.col("first").alias("rep")).distinct().join(older, "rep").select("doc", "start", "stop", "first")
    all_ = matches.unionByName(passed).withColumn("whole", F.lit(False)).unionByName(whole).groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "first", "whole")).alias("found"))
    return all_.mapInArrow(_pieces, PIECES)


def _cut(names: list[str], at: int, cuts_at: int, chars: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in text.slices(batches, column="text"):
            w = text.words(buf, off)
            lists = rows.column(cuts_at).to_pylist()
            column = rows.column(at).to_pylist()
            keep = np.ones(len(lists), bool)
            for d, cuts in enumerate(lists):
                if not cuts:
                    continue
                parts, begin = [], int(off[d])
                left = n = int(w.ptr[d + 1] - w.ptr[d])
                for cut in sorted(cuts, key=lambda c: c["start_word"]):
                    if cut["end_word"] > n:  # a place in another text of this id
                        continue
                    a, b = int(w.ptr[d]) + cut["start_word"], int(w.ptr[d]) + cut["end_word"]
                    parts.append(buf[begin : w.start[a]].tobytes())
                    begin = int(w.end[b - 1])
                    left -= b - a
                parts.append(buf[begin : off[d + 1]].tobytes())
                column[d] = b"".join(parts).decode()
                keep[d] = left > 0
            out = rows.columns[: len(names)]
            out[at] = pa.array(column, pa.string())
            if chars:
                old = out[names.index(chars)]
                size = pc.utf8_length(out[at]).cast(old.type)
                out[names.index(chars)] = pc.if_else(pa.array([bool(c) for c in lists], pa.bool_()), size, old)
            yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(keep))

    return run


def cut_repeats(docs: DataFrame, key: str = "doc_id", chars: str | None = "n_chars") -> DataFrame:
    """docs without the passages that a document of a smaller id holds too.

    Every repeated passage stays whole in its first holder, and words outside of
    repeated passages stay.  Rows that lose all their words are left out; `chars`,
    if docs has such a column, gets the new length of the texts that were cut.
    Ids should be unique: rows of one id with different texts share their places.
    """
    of, cuts_name = free_name(docs.columns, "cut_doc"), free_name(docs.columns, "cut_spans")
    cuts = spans(docs, key).filter(~F.col("kept")).groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(cuts_name))
    joined = docs.join(cuts, F.col(key).cast("long") == F.col(of), "left").select(*docs.columns, cuts_name)
    return joined.mapInArrow(_cut(docs.columns, docs.columns.index("text"), len(docs.columns), chars if chars in docs.columns else None), docs.schema)
