"""Operator 2: byte-pair encoding and decoding by speculation and verification.

A text is cut into units that the pre-tokenizer never crosses: a run of plain
letters, of digits or of signs, with the one space before it if it begins a
word; words with any other character; and the white space left between.  For
the units of a batch that the process has not met:

1. all pieces get the longest vocabulary entry at their first position, then at
   the next, and so on, for all pieces at once;
2. every adjacent pair of proposed tokens is tested for compatibility, again
   for all pairs at once: walking the merge trees of both tokens on the two
   sides of their border, would a merge across the border have come first?
   A sequence whose pairs all pass is what merging would have given;
3. only pieces with a failing pair are merged exactly.

Decoding looks every id up and joins the bytes.

Defined results: a null or empty text has no ids; special strings in a text
become their ids; texts where other Unicode spaces stand at a unit's edge, or
that hold special strings, are cut by the library's pre-tokenizer as a whole.
Repeated rows give repeated rows; a null id keeps its row; other columns are
dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm import text, vocab

#: Entries of the unit cache before it starts anew.
CACHE = 150_000
NEVER = np.int64(1 << 60)


def merge_exactly(ids: list[int], table: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Exact merging of one long piece: lowest rank first, of equal ranks the leftmost."""
    n, ids = len(ids), list(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(m[0], i, m[1], p) for i in range(n - 1) if (m := table.get(p := (ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, made, pair = heapq.heappop(heap)
        j = after[i]
        if j < 0 or (ids[i], ids[j]) != pair:
            continue
        ids[i], ids[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for x in (before[i], i):
            if x >= 0 and after[x] >= 0 and (m := table.get(p := (ids[x], ids[after[x]]))):
                heapq.heappush(heap, (m[0], x, m[1], p))
    return [x for x in ids if x >= 0]


def merge_all(v: vocab.Vocabulary, ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact merging of many pieces at once: each round merges the best pair of every piece."""

    def ranks(a, b):
        key = a * v.size + b
        found = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
        hit = v.pair_key[found] == key
        return np.where(hit, v.pair_rank[found], NEVER), np.where(hit, v.pair_made[found], -1)

    done_ids, done_piece, done_at = [], [], []
    at = np.arange(len(ids))
    rank, made = np.full(len(ids), NEVER), np.full(len(ids), -1)
    joint = np.flatnonzero(piece[1:] == piece[:-1])
    rank[joint], made[joint] = ranks(ids[joint], ids[joint + 1])
    while len(ids):
        begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        best = np.minimum.reduceat(rank, begin)
        size = np.diff(np.append(begin, len(ids)))
        is_best = (rank == np.repeat(best, size)) & (rank < NEVER)
        open_ = np.repeat(best < NEVER, size)
        done_ids.append(ids[~open_])
        done_piece.append(piece[~open_])
        done_at.append(at[~open_])
        spot = np.flatnonzero(is_best)
        spot = spot[np.concatenate([[True], piece[spot[1:]] != piece[spot[:-1]]])] if len(spot) else spot  # the leftmost
        ids[spot] = made[spot]
        keep = open_.copy()
        keep[spot + 1] = False
        number = np.cumsum(keep) - 1
        ids, piece, rank, made, at = ids[keep], piece[keep], rank[keep], made[keep], at[keep]
        spot = number[spot]
        for x in (spot, spot - 1):  # the pairs that the merged token is in
            x = x[x >= 0]
            pair = np.append(piece, -1)[x + 1] == piece[x]
            rank[x[~pair & (np.isin(x, spot))]] = NEVER
            x = x[pair]
            rank[x], made[x] = ranks(ids[x], ids[x + 1])
    ids, piece, at = np.concatenate(done_ids or [ids]), np.concatenate(done_piece or [piece]), np.concatenate(done_at or [at])
    order = np.argsort(at, kind="stable")
    return ids[order], piece[order]


def compatible(v: vocab.Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair of tokens stays apart when their bytes are merged together.

    The border parts two fragments at any time: the right edge of `left` and the
    left edge of `right`, as far as their own merges have come.  A fragment lives
    from the merge that makes it until the one that takes it in.  A merge across
    the border wins if its rank is below that of both ends of life (a tie with
    the right side's own merge too, since that stands further right).
    """
    ok = np.ones(len(left), bool)
    at = np.arange(len(left))
    a, b = left.astype(np.int64), right.astype(np.int64)
    end_a, end_b = np.full(len(a), NEVER), np.full(len(b), NEVER)
    while len(at):
        key = a * v.size + b
        found = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
        rank = np.where(v.pair_key[found] == key, v.pair_rank[found], NEVER)
        bad = (rank < end_a) & (rank <= end_b) & (rank < NEVER)
        ok[at[bad]] = False
        born_a, born_b = v.born[a], v.born[b]
        back_a = born_a > born_b  # of equal births the right one came later
        go = ~bad & ((born_a >= 0) | (born_b >= 0))
        end_a, a = np.where(back_a, born_a, end_a), np.where(back_a, v.parts[a, 1], a)
        end_b, b = np.where(back_a, end_b, born_b), np.where(back_a, b, v.parts[b, 0])
        at, a, b, end_a, end_b = at[go], a[go], b[go], end_a[go], end_b[go]
    return ok


class Encoder:
    """Tables and the cache of one vocabulary in one process."""

    def __init__(self, path: str):
        self.v = v = vocab.load(path)
        by_size: dict[int, list[tuple[bytes, int]]] = {}
        for t, i in v.vocab.items():
            raw = bytes(v.alphabet[c] for c in t)
            by_size.setdefault(len(raw), []).append((raw, i))
        self.table = {}
        for n, all_ in by_size.items():
            buf = np.frombuffer(b"".join(x for x, _ in all_), np.uint8)
            at = np.arange(len(all_)) * n
            h = text.span_hash(text.prefix_hash(buf), at, at + n)
            order = np.argsort(h)
            self.table[n] = (h[order], np.array([i for _, i in all_])[order])
        self.symbol = np.array([v.vocab[v.shown[b]] for b in range(256)], np.int64)
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        """Parallel lists by unit number: count (-1: the text must be cut as a whole), ids as text, bytes."""
        self.known.clear()
        self.count: list[int] = []
        self.shown: list[bytes] = []
        self.plain: list[bytes] = []

    def longest_match(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Proposed tokens of all pieces, and the piece of each."""
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        run = text.prefix_hash(buf)
        at, which = np.concatenate([[0], end[:-1]]), np.arange(len(pieces))
        which, at = which[at < end], at[at < end]
        got_piece, got_id, got_at = [], [], []
        while len(at):
            rest = end[which] - at
            token, took = np.full(len(at), -1), np.zeros(len(at), np.int64)
            open_ = np.arange(len(at))
            for n in sorted((n for n in self.table if n <= rest.max()), reverse=True):
                can = open_[rest[open_] >= n]
                if not len(can):
                    continue
                keys, ids = self.table[n]
                h = text.span_hash(run, at[can], at[can] + n)
                found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[found] == h
                token[can[hit]], took[can[hit]] = ids[found[hit]], n
                open_ = open_[token[open_] < 0]
                if not len(open_):
                    break
            got_piece.append(which)
            got_id.append(token)
            got_at.append(at)
            at = at + took
            which, at = which[at < end[which]], at[at < end[which]]
        piece, token, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_piece, got_id, got_at))
        order = np.argsort(place, kind="stable")
        return token[order], piece[order]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each non-empty piece."""
        if not pieces:
            return []
        token, piece = self.longest_match(pieces)
        joint = np.flatnonzero(piece[1:] == piece[:-1])
        key, back = np.unique(token[joint] * self.v.size + token[joint + 1], return_inverse=True)
        fine = compatible(self.v, key // self.v.size, key % self.v.size)[back]
        failing = np.unique(piece[joint[~fine]])
        ptr = np.searchsorted(piece, np.arange(len(pieces) + 1)).tolist()
        flat = token.tolist()
        out = [flat[a:b] for a, b in zip(ptr, ptr[1:])]
        long = [i for i in failing.tolist() if len(pieces[i]) > 64]
        short = [i for i in failing.tolist() if len(pieces[i]) <= 64]
        if short:
            raw = np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)
            ids, piece = merge_all(self.v, self.symbol[raw], np.repeat(np.arange(len(short)), [len(pieces[i]) for i in short]))
            ptr = np.searchsorted(piece, np.arange(len(short) + 1)).tolist()
            flat = ids.tolist()
            for k, i in enumerate(short):
                out[i] = flat[ptr[k] : ptr[k + 1]]
        for i in long:
            out[i] = merge_exactly(self.symbol[np.frombuffer(pieces[i], np.uint8)].tolist(), self.v.merge_of)
        return out

    def whole(self, value: str) -> list[int]:
        """Ids of a text that is cut by the library's pre-tokenizer as a whole."""
        parts = self.v.pieces(value)
        coded = iter(self.encode_pieces([bytes(self.v.alphabet[c] for c in p) for p in parts if not isinstance(p, int)]))
        return [i for p in parts for i in ([p] if isinstance(p, int) else next(coded))]

    def cut(self, unit: bytes) -> list[bytes] | None:
        """The pieces of a unit; None if its text must be cut as a whole."""
        value = unit.decode("utf-8", "replace")
        edge = value.strip(" \t\n\x0b\x0c\r")
        if self.v.special_re.search(value) or edge and any(ord(c) > 127 and c.isspace() for c in (edge[0], edge[-1])):
            return None
        return [bytes(self.v.alphabet[c] for c in p) for p in self.v.pieces(value)]

    def learn(self, units: list[bytes]) -> list[int]:
        """Numbers of the units, coding those not met before."""
        if len(self.known) > CACHE:
            self.clear()
        known = self.known
        new = [u for u in units if u not in known]
        plain = text.LETTERS.fullmatch
        cuts = [(u,) if plain(u) else self.cut(u) for u in new]
        coded = self.encode_pieces([p for c in cuts if c for p in c])
        if len(coded) != len(cuts) or None in cuts:
            all_ = iter(coded)
            coded = [None if c is None else [i for _ in c for i in next(all_)] for c in cuts]
        token = self.v.token_bytes
        first = len(self.count)
        known.update(zip(new, range(first, first + len(new))))
        self.count += [-1 if c is None else len(c) for c in coded]
        self.shown += [("%d," * len(c) % tuple(c)).encode() if c else b"" for c in coded]
        self.plain += [b"".join([token[i] for i in c]) if c else b"" for c in coded]
        return [*map(known.__getitem__, units)]


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units (with the end of all), and the first unit of each text."""
    w = text.words(buf, off)
    mark = np.zeros(len(buf) + 1, bool)
    mark[: len(buf)] = text.pieces(w, single_digits=False)
    mark[off] = True
    mark[w.end] = True
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    inner = w.start[~edge[w.start]]  # words after white space
    mark[inner - 1] = True  # the last white space before a word stands apart
    mark[inner[buf[inner - 1] == 32]] = False  # unless it is a space, which joins it
    mark[len(buf)] = True
    cut = np.flatnonzero(mark)
    return cut, np.searchsorted(cut, off)


_encoders: dict[str, Encoder] = {}


def _encode(path: str, ids: bool, digests: bool, name: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoders.setdefault(path, Encoder(path))
        for rows, buf, off in text.slices(batches, name):
            cut, ptr = units(buf, off)
            coded = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(buf)]).dictionary_encode()
            number = e.learn(coded.dictionary.to_pylist())
            local = coded.indices
            per = np.array([e.count[i] for i in number], np.int64)[local.to_numpy()] if number else np.zeros(0, np.int64)
            lost = np.concatenate([[0], np.cumsum(per < 0)])[ptr]
            whole = {d: e.whole(buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")) for d in np.flatnonzero(np.diff(lost)).tolist()}
            total = np.concatenate([[0], np.cumsum(np.maximum(per, 0))])
            n_tokens = np.diff(total[ptr])
            for d, own in whole.items():
                n_tokens[d] = len(own)
            out, names = [*rows.columns[:-1], pa.array(n_tokens)], [*rows.schema.names[:-1], "n_tokens"]
            if ids:
                flat = np.array(b"".join([e.shown[u] for u in number]).split(b",")[:-1], np.int32)
                sizes = np.array([max(0, e.count[u]) for u in number], np.int64)
                lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(flat)).take(local).flatten().to_numpy()
                parts = [np.array(whole[d], np.int32) if d in whole else lists[total[ptr[d]] : total[ptr[d + 1]]] for d in range(len(off) - 1)]
                out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(np.concatenate(parts))))
                names.append("ids")
            if digests:
                for kind, name_, end in ((e.shown, "ids_sha256", 1), (e.plain, "decoded_sha256", 0)):
                    laid = pa.array([kind[u] for u in number], pa.large_binary()).take(local)
                    data = memoryview(laid.buffers()[2] or b"")
                    at = np.frombuffer(laid.buffers()[1], np.int64)[ptr].tolist() if len(laid) else [0] * len(off)
                    told = [hashlib.sha256(data[a : max(a, b - end)]).hexdigest() for a, b in zip(at, at[1:])]
                    for d, own in whole.items():
                        told[d] = hashlib.sha256(",".join(map(str, own)).encode() if end else b"".join(map(e.v.token_bytes.__getitem__, own))).hexdigest()
                    out.append(pa.array(told, pa.string()))
                    names.append(name_)
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def encode(docs: DataFrame, path: str, ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids and the digests of ids and decoded text."""
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path, ids, digests), schema)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.load(path)
        known = v.token_bytes
        for batch in batches:
            lists = batch.column(1).to_pylist()
            out = [None if x is None else b"".join(known[i] for i in x if i is not None and 0 <= i < v.size).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids (null ids: null; ids outside the vocabulary are left out)."""
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decode(path), "doc_id long, text string")
