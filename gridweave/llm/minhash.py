"""Operator 1: MinHash near-duplicates with tensored banding.

A document's set holds its distinct SHINGLE-word shingles as 64-bit hashes.
Documents with equal sets form a class, and only one of a class goes on.

Two collections of M bands are computed, each band of ROWS MinHash values, so
2 * M * ROWS values in all.  Every pair of a band of the first and a band of the
second makes one table key: M * M tables of 2 * ROWS values each.  At similarity
0.75 a pair of documents misses all tables with probability below 0.0006
(1 - (1 - (1 - 0.75^2)^10)^2); above 0.8 it is below 0.0001.

Members of a bucket are not paired with each other.  They are linked to the
first member of their bucket, and before that to the first one that also agrees
in a further band.  Each task of the sketching side does this for the rows it
has and sends on only these first ones, so a bucket of a hot group reaches the
shuffle as a few rows for each task.

Links are confirmed on full sets: first the most frequent link of each document,
then what still runs between different components.  Confirmed links make the
components.

A bucket whose members are then in more than one component is open, and all its
pairs of different components are looked at: open buckets are cut into units of
about UNIT rows, and each two units meet in one task.  A bit map of each set (the
parity of the shingles in each bit) bounds a pair's difference from below, so it
parts the pairs that surely are not similar without loss.  Of the others a task
gives no more than a few for each document: the closest one of each, and a tree
of close pairs over all components that they join.  These are confirmed on full
sets.  Where the whole tree holds, the units' components are one.  Where it does
not, the components that the units' trees join make a net.  A document is in one net
however many tables it shares; the full sets of a net meet, again in units, and
tasks try all pairs between components that are still apart and give a tree of the
links they find.  So every pair that shares a table is in one component or known to
be no link, and no task gives more rows than a few for each document that it has
read.  A bucket or net of several units is read once for each other unit.

Defined results: texts that are null or have no words are linked with nothing
and are components of their own (n_shingles 0); repeated rows are copies and
each keeps its row; rows with a null id are left out; an empty table gives no
rows.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import text
from gridweave.llm.membership import Members
from gridweave.operators.components import components
from gridweave.sources.scratch import Scratch

SHINGLE = 5
PERCENT = 75
M = 10
ROWS = 2
#: Rows of an open bucket that meet others at once, and the bits of a set's map at most.
UNIT, MOST_BITS = 1000, 1 << 16
#: Shingles after which a text counts as one more row of its unit.
LONG = 1000
_RNG = np.random.Generator(np.random.PCG64(75))
_ODD = _RNG.integers(1, 2**63, (2 * M * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_TABLE = text.mix(np.arange(1, M * M + 1, dtype=np.uint64))


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    buf = text.LOWER[buf]
    w = text.words(buf, off)
    hashes = text.span_hash(text.prefix_hash(buf), w.start, w.end)
    five = text.windows(hashes, SHINGLE)
    parts = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if b - a >= SHINGLE:
            parts.append(np.unique(five[a : b - SHINGLE + 1]))
        elif b > a:
            parts.append(text.windows(np.concatenate([hashes[a:b], np.zeros(1, np.uint64)]), b - a + 1))
        else:
            parts.append(hashes[:0])
    return np.concatenate(parts or [hashes[:0]]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def sketches(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """2 * M bands of each non-empty set, and zeros for empty ones."""
    some = np.flatnonzero(np.diff(ptr))
    least = np.zeros((len(ptr) - 1, 2 * M, ROWS), np.uint64)
    if len(some):
        for k, (a, b) in enumerate(_ODD):
            v = (sets ^ a) * b
            v ^= v >> np.uint64(32)
            least[some, k // ROWS, k % ROWS] = np.minimum.reduceat(v * b, ptr[some])
    band = np.zeros(least.shape[:2], np.uint64)
    for r in range(ROWS):
        band = text.mix(band + least[:, :, r])
    return band


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in text.slices(batches):
        sets, ptr = shingle_sets(buf, off)
        n = np.diff(ptr)
        total = np.zeros(len(sets) + 1, np.uint64)
        prints = []
        for salt in (np.uint64(1), np.uint64(0x5851F42D4C957F2D)):
            np.cumsum(text.mix(sets + salt), out=total[1:])
            prints.append(pa.array((total[ptr[1:]] - total[ptr[:-1]]).view(np.int64)))
        band = np.ascontiguousarray(sketches(sets, ptr))
        size = 16 * M
        packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * size).astype(np.int32)), pa.py_buffer(band)])
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), *prints, packed], ["doc_id", "n", "p1", "p2", "bands"])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def star_links(key: np.ndarray, sub: np.ndarray, doc: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of bucket members to first members, and the rows that lead a sub-bucket.

    whole: also link the leaders of a bucket's sub-buckets to the bucket's first.
    Rows must be sorted by key, sub and doc.
    """
    lead = _runs(key, sub)
    head = np.flatnonzero(lead)
    first = doc[head[np.cumsum(lead) - 1]] if len(doc) else doc
    a, b = first[~lead], doc[~lead]
    if whole and len(head):
        own = _runs(key[head])
        top = doc[head[np.flatnonzero(own)[np.cumsum(own) - 1]]]
        a, b = np.concatenate([a, top[~own]]), np.concatenate([b, doc[head[~own]]])
    differ = a != b
    return a[differ], b[differ], head


def table_keys(band: np.ndarray) -> np.ndarray:
    """The M * M table keys of each row of bands, one row after the other."""
    f, g = band[:, :M, None], band[:, None, M:]
    return text.mix((f * np.uint64(0x9E3779B97F4A7C15) + g) ^ _TABLE.reshape(1, M, M)).reshape(-1).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets (key, sub, doc), and links (any key; doc and other)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            rows = batch.slice(at, 4000)
            doc = rows.column(0).to_numpy()
            band = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint64).reshape(-1, 2 * M)
            key = table_keys(band)
            sub = np.broadcast_to(np.roll(band[:, M:], -1, 1)[:, None, :], (len(doc), M, M)).reshape(-1)
            sub = (sub >> np.uint64(32)).astype(np.uint32).view(np.int32)
            each = np.repeat(doc, M * M)
            order = np.lexsort((each, sub, key))
            key, sub, each = key[order], sub[order], each[order]
            a, b, head = star_links(key, sub, each, False)
            n, k = len(head), len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[head], text.mix(b.view(np.uint64)).view(np.int64)])), pa.array(np.concatenate([sub[head], np.zeros(k, np.int32)])), pa.array(np.concatenate([each[head], b])), pa.array(np.concatenate([np.full(n, -1), a]), mask=np.arange(n + k) < n)],
                ["key", "sub", "doc", "other"],
            )


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from sorted key rows; a bucket may run on over batches."""
    top = None  # (key, sub, first of the sub-bucket, first of the bucket)
    for batch in batches:
        key, sub, doc = (batch.column(i).to_numpy() for i in range(3))
        other = batch.column(3)
        link = other.is_valid().to_numpy(zero_copy_only=False)
        out_a, out_b = [other.drop_null().to_numpy()], [doc[link]]
        key, sub, doc = key[~link], sub[~link], doc[~link]
        if len(key):
            a, b, head = star_links(key, sub, doc, True)
            out_a.append(a)
            out_b.append(b)
            if top and top[0] == key[0]:
                out_a.append(np.array([top[2] if top[1] == sub[0] else top[3], top[3]]))
                out_b.append(np.array([doc[0], doc[0]]))
            begin = int(np.searchsorted(key, key[-1]))
            first = top[3] if top and top[0] == key[-1] and begin == 0 else int(doc[begin])
            own = int(doc[head[-1]])
            if top and top[0] == key[-1] and top[1] == sub[-1] and head[-1] == 0:
                own = top[2]
            top = (int(key[-1]), int(sub[-1]), own, first)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = _runs(low, high) if len(low) else np.zeros(0, bool)
        count = np.diff(np.append(np.flatnonzero(new), len(low)))
        keep = low[new] != high[new]
        yield pa.RecordBatch.from_arrays([pa.array(low[new][keep]), pa.array(high[new][keep]), pa.array(count[keep].astype(np.int64))], ["a", "b", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in text.slices(batches):
        sets, ptr = shingle_sets(buf, off)
        packed = pa.Array.from_buffers(pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer(ptr * 8), pa.py_buffer(sets)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column(0), packed], ["doc", "set"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), percent) for pair in zip(batch.column(2), batch.column(3))]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, as u, v."""
    left = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    both = left.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "u long, v long")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document in all its tables."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = batch.slice(at, 1000)
            band = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint64).reshape(-1, 2 * M)
            each = pa.array(np.repeat(np.arange(rows.num_rows), M * M))
            yield pa.RecordBatch.from_arrays([pa.array(table_keys(band)), *(rows.column(k).take(each) for k in (0, 1, 3))], ["key", "doc", "comp", "weight"])


def bit_map(shingles: np.ndarray, times: int = 2) -> bytes:
    """Whether an odd number of the shingles falls on each bit; bits are their last ones, `times` as many as shingles or more."""
    width = min(MOST_BITS, max(64, 1 << (times * len(shingles) - 1).bit_length()))
    return np.packbits((np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in text.slices(batches):
        sets, ptr = shingle_sets(buf, off)
        maps = [bit_map(sets[a:b]) if b > a else b"" for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(ptr)), pa.array(maps, pa.binary())], ["doc", "n", "bits"])


def close_pairs(doc: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components that may be similar, and the difference that their maps show.

    side: rows of 0 meet those of 1, and rows of 2 each other.
    """
    width = np.array([len(b) for b in bits], np.int64)
    found = [(doc[:0], doc[:0], n[:0])]
    mixed = side == 2
    for left, right, again in ((side == 0, side == 1, False), (mixed, mixed, True)):
        for wide in np.unique(width[left]).tolist():
            for other in np.unique(width[right]).tolist():
                words = min(wide, other)
                x, y = (np.flatnonzero(m & (width == w)) for m, w in ((left, wide), (right, other)))
                x, y = x[np.argsort(comp[x], kind="stable")], y[np.argsort(comp[y], kind="stable")]
                # the map of twice the bits, folded, is the map of the bits
                mx, my = (np.bitwise_xor.reduce(np.frombuffer(b"".join(bits[i] for i in r.tolist()), np.uint64).reshape(len(r), -1, words // 8), 1) for r in (x, y))
                cx, cy = comp[x], comp[y]
                head = np.flatnonzero(_runs(cx))
                for a, b in zip(head.tolist(), [*head[1:].tolist(), len(x)]):
                    lo, hi = np.searchsorted(cy, cx[a], "left"), np.searchsorted(cy, cx[a], "right")
                    pick = np.arange(hi, len(y)) if again else np.concatenate([np.arange(lo), np.arange(hi, len(y))])
                    if not len(pick):
                        continue
                    ours, ny = my[pick], n[y[pick]]
                    step = max(1, (1 << 20) // ours.size)
                    for at in range(a, b, step):
                        nx = n[x[at : min(b, at + step)], None]
                        gap = np.bitwise_count(mx[at : min(b, at + step), None] ^ ours).sum(2, dtype=np.int64)
                        ok = (gap * (100 + percent) <= (nx + ny) * (100 - percent)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
                        i, j = np.nonzero(ok)
                        found.append((doc[x[at + i]], doc[y[pick[j]]], gap[i, j]))
    a, b, gap = (np.concatenate(f) for f in zip(*found))
    return np.minimum(a, b), np.maximum(a, b), gap


def tree(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the pairs of 0..n-1, best first, that make a least tree of each component."""
    part, edge, out = np.arange(n), np.arange(len(a)), []
    while len(edge):
        u, v = part[a[edge]], part[b[edge]]
        edge, u, v = (x[u != v] for x in (edge, u, v))
        if not len(edge):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, u, edge)
        np.minimum.at(best, v, edge)
        chosen = np.unique(best[best < len(a)])
        out.append(chosen)
        u, v = part[a[chosen]], part[b[chosen]]
        while True:  # the smallest label of all that the chosen pairs join
            label = np.arange(n)
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
            while (label != label[label]).any():
                label = label[label]
            part, u, v = label[part], label[u], label[v]
            if (u == v).all():
                break
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _by_group(told):
    """told() of the table of each group of sorted rows; a group may run on over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            group = batch.column(0).to_numpy()
            head = np.flatnonzero(_runs(group)).tolist()
            for a, b in zip(head, [*head[1:], batch.num_rows]):
                if held and held[0].column(0)[0].as_py() != group[a]:
                    yield told(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield told(pa.concat_tables(held))

    return run


def _close(percent: int):
    """Of the pairs of a group that may be similar: a tree over the components, and the closest one of each document."""

    def told(t: pa.Table) -> pa.RecordBatch:
        doc, comp, n = (t.column(c).to_numpy() for c in ("doc", "comp", "n"))
        a, b, gap = close_pairs(doc, comp, n, t.column("bits").to_pylist(), t.column("side").to_numpy(), percent)
        order = np.lexsort((b, a, gap))
        a, b, gap = a[order], b[order], gap[order]
        ids, first = np.unique(doc, return_index=True)
        names, of = np.unique(comp[first], return_inverse=True)
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        in_tree = np.zeros(len(a), bool)
        in_tree[tree(of[i], of[j], len(names))] = True
        near = in_tree.copy()
        near[np.unique(np.stack([i, j], 1).reshape(-1), return_index=True)[1] // 2] = True
        k = np.flatnonzero(near)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), t.column(0)[0].as_py())), pa.array(a[k]), pa.array(b[k]), pa.array(in_tree[k])], ["group", "a", "b", "tree"])

    return _by_group(told)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _all_links(percent: int):
    """A tree of the links between components of a group, of all pairs on full sets."""

    def told(t: pa.Table) -> pa.RecordBatch:
        doc, comp = (t.column(c).to_numpy() for c in ("doc", "comp"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("set")]
        n = np.array([len(s) for s in sets])
        a, b, gap = close_pairs(np.arange(len(doc)), comp, n, [bit_map(s, 16) for s in sets], t.column("side").to_numpy(), percent)
        names, part = np.unique(comp, return_inverse=True)
        up = list(range(len(names)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for k in np.argsort(gap, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            x, y = top(part[i]), top(part[j])
            if x != y and similar(sets[i], sets[j], percent):
                up[x] = y
                out.append((doc[i], doc[j]))
        u, v = np.array(out, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return _by_group(told)


def crossing(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) between different components, with these as c_a and c_b."""
    side = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.withColumn("c_a", F.coalesce("c_a", "a")).withColumn("c_b", F.coalesce("c_b", "b")).filter("c_a <> c_b")


def meetings(rows: DataFrame, scratch: Scratch, name: str = "") -> tuple[DataFrame, DataFrame]:
    """(members, group and side of each in all its meetings) of rows (key, doc, comp, weight) whose key has several components.

    The rows of a key are cut into units of about UNIT, and each two units meet in a group.
    """
    counts = scratch.keep(rows.groupBy("key", "comp").agg(F.sum("weight").alias("own")), f"{name}counts")
    open_ = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("own").alias("all")).filter("parts > 1")
    # a unit is a part of one large component, or of all the small ones of a bucket
    large = F.col("own") > UNIT
    part = lambda of, size: F.pmod(F.xxhash64(of), F.ceil(F.col(size) / UNIT))
    unit = F.struct(large.alias("large"), F.when(large, F.col("comp")).otherwise(F.lit(0)).alias("of"), F.when(large, part("doc", "own")).otherwise(part("comp", "all")).alias("part"))
    members = rows.join(counts.join(open_, "key"), ["key", "comp"]).select("key", "doc", "comp", unit.alias("unit"))
    members = scratch.keep(members, f"{name}members")
    units = members.select("key", "unit").distinct()
    meet = units.withColumnRenamed("unit", "p").join(units.withColumnRenamed("unit", "q"), "key").filter("p <= q and not (p.large and q.large and p.of = q.of)")
    meet = scratch.keep(meet.withColumn("group", F.xxhash64("key", "p", "q")), f"{name}meet")
    first = members.join(meet.withColumn("unit", F.col("p")), ["key", "unit"]).withColumn("side", F.when(F.col("p") == F.col("q"), 2).otherwise(0))
    last = members.join(meet.filter("p <> q").withColumn("unit", F.col("q")), ["key", "unit"]).withColumn("side", F.lit(1))
    return members, first.unionByName(last).select("group", "doc", "comp", "side")


def open_pairs(links: DataFrame, groups: DataFrame, chosen: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """group, a, b, tree: of the pairs of two units of an open bucket, some that tell whether its components are one.

    links tie the members of each bucket together, so a bucket is open only if one
    of them runs between components, and each of its components has an end of such.
    """
    ends = crossing(links, groups).select(F.explode(F.array("c_a", "c_b")).alias("comp")).distinct()
    loose = chosen.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).join(ends, "comp", "left_semi")
    # a long text counts as several rows
    loose = scratch.keep(loose.select(F.col("doc_id").alias("doc"), "comp", "bands", (1 + F.floor(F.col("n") / LONG)).cast("int").alias("weight")), "loose")
    members, meeting = meetings(loose.mapInArrow(_tables, "key long, doc long, comp long, weight int"), scratch)
    maps = scratch.keep(Members(members.select("doc").distinct(), "doc").through(texts, "doc_id", _bits, "doc long, n long, bits binary").dropDuplicates(["doc"]), "maps")
    met = meeting.join(maps, "doc").select("group", "doc", "comp", "side", "n", "bits")
    close = scratch.keep(met.repartition("group").sortWithinPartitions("group").mapInArrow(_close(percent), "group long, a long, b long, tree boolean"), "close")
    scratch.drop("loose", "counts", "members", "meet", "maps")
    return close


def _ends(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc_id of all that are in a pair."""
    return scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), name)


def _full_sets(ends: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.keep(Members(ends, "doc_id").through(texts, "doc_id", _sets, "doc long, set binary").dropDuplicates(["doc"]), name)


def unsettled(close: DataFrame, groups: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """Meetings of the documents of all groups whose tree does not hold as a whole, and their full sets; None if all hold.

    Many groups hold the same documents, as a pair may share up to M * M tables.
    So the components that their trees join make nets, and a document is in one
    net only: every pair of such a group is in a net, and the units of a net meet.
    """
    broken = scratch.keep(crossing(close.filter("tree"), groups).select("group", "c_a", "c_b"), "failed")
    if broken.isEmpty():
        return None, None
    nets = components(broken.select(F.col("c_a").alias("u"), F.col("c_b").alias("v")), scratch=Scratch(close.sparkSession, "minhash-nets")).select(F.col("node").alias("comp"), F.col("component").alias("key"))
    apart = scratch.keep(close.join(broken.select("group").distinct(), "group", "left_semi").select("a", "b").distinct(), "apart")
    docs = apart.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left")
    rest = scratch.keep(docs.select(F.col("node").alias("doc"), F.coalesce("component", "node").alias("comp")).join(nets, "comp"), "rest")
    sets = _full_sets(rest.select(F.col("doc").alias("doc_id")), texts, scratch, "rest-sets")
    weight = (1 + F.floor(F.length("set") / (8 * LONG))).cast("int").alias("weight")
    return meetings(rest.join(sets, "doc").select("key", "doc", "comp", weight), scratch, "rest-")[1], sets


def near_duplicates(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; key names the column of ids."""
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    sketched = scratch.keep(texts.mapInArrow(_sketch, "doc_id long, n long, p1 long, p2 long, bands binary"), "sketched")
    some = sketched.filter("n > 0")
    classes = scratch.keep(some.groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = some.select("doc_id", "n", "bands").join(classes.select(F.col("rep").alias("doc_id"), "n"), ["doc_id", "n"], "left_semi").dropDuplicates(["doc_id", "n"])
    keyed = chosen.select("doc_id", "bands").mapInArrow(_keys, "key long, sub int, doc long, other long")
    linked = keyed.repartition("key").sortWithinPartitions("key", "sub", "doc").mapInArrow(_links, "a long, b long, n long")
    sizes = classes.select(F.col("rep").alias("a"), F.col("n").alias("size_a"))
    linked = scratch.keep(linked.groupBy("a", "b").agg(F.sum("n").alias("n")), "links")
    links = linked.join(sizes, "a").join(sizes.toDF("b", "size_b"), "b").filter(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    links = scratch.keep(links.select("a", "b", "n"), "sized")
    sets = _full_sets(_ends(links, scratch, "ends"), texts, scratch, "sets")
    best = links.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    found = scratch.keep(confirmed(best.select("a", "b"), sets, percent), "first")
    groups = components(found, scratch=Scratch(docs.sparkSession, "minhash-first"))
    tried = best.select("a", "b")
    second = crossing(links, groups).select("a", "b").join(tried, ["a", "b"], "left_anti")
    found = found.unionByName(scratch.keep(confirmed(second, sets, percent), "second"))
    groups = scratch.keep(components(found, scratch=Scratch(docs.sparkSession, "minhash-second")), "groups-2")
    # all links were tried or lie within a component; what is left are pairs of open buckets without a link
    close = open_pairs(linked, groups, chosen, texts, percent, scratch)
    third = scratch.keep(close.select("a", "b").distinct().join(links.select("a", "b"), ["a", "b"], "left_anti"), "third")
    if not third.isEmpty():
        sets = _full_sets(_ends(third, scratch, "close-ends"), texts, scratch, "close-sets")
        found = found.unionByName(scratch.keep(confirmed(third, sets, percent), "third-found"))
        groups = scratch.keep(components(found, scratch=Scratch(docs.sparkSession, "minhash-third")), "groups-3")
        rest, sets = unsettled(close, groups, texts, scratch)
        if rest is not None:
            found = found.unionByName(scratch.keep(rest.join(sets, "doc").select("group", "doc", "comp", "side", "set").repartition("group").sortWithinPartitions("group").mapInArrow(_all_links(percent), "u long, v long"), "fourth"))
            groups = scratch.keep(components(found, scratch=Scratch(docs.sparkSession, "minhash-fourth")), "groups")
    scratch.drop("links", "sized", "ends", "sets", "close", "close-ends", "close-sets", "failed", "apart", "rest", "rest-sets", "rest-counts", "rest-members", "rest-meet", "first", "second", "third", "third-found", "fourth")
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("p1", "p2", "n", F.coalesce("component", "rep").alias("component"))
    told = sketched.select("doc_id", "n", "p1", "p2").join(named, ["p1", "p2", "n"], "left")
    out = told.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
