"""Operator 10: nearest neighbours by a vantage-point tree for each shard.

A bounded sample of the vectors (one for every SHARD_ROWS, MOST_CENTRES at most)
gives centres.  Every vector goes to its nearest centre, and the vectors of a
centre, with their least and greatest distance to it, are dealt by row into
shards of about SHARD_ROWS, so copies of one vector or one id fill many shards.
Each shard becomes one tree, in the task that searches it.  A tree node splits
its vectors by their distance to a vantage point and remembers the least and
greatest distance on either side.  A query leaves out a side if the triangle
inequality shows all of it to be farther than factor times its k-th best distance
so far.  Factor 1 is exact search; a smaller one prunes more and loses some
neighbours.

A query first goes to a shard of its nearest centre, which gives it a k-th best
distance to begin with.  With that, the same inequality on centres leaves out
whole shards, and the query goes to the others.  Queries travel, not trees, and
each is a row for each shard that it cannot leave out.

Distances are computed in double precision on the original components.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, take no part; vectors of different length are not
compared; rows with a null id are left out; equal query rows are one query, and
rows with one id and different vectors are queries of their own, each with ranks
from 1; a candidate's id counts as often as it stands, and rows with the query's
own id are not its candidates; ties go to the smaller vec_id; fewer candidates
than k give all of them; an empty table gives no rows.  Only vec_id and embedding
are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gridweave.sources.scratch import Scratch

SHARD_ROWS = 8192
BLOCK_ROWS = 512
LEAF = 128
MOST_CENTRES = 4096
SLACK = 1e-9


def build(x: np.ndarray) -> dict:
    """Tree over the rows of x: arrays of rows in tree order and of nodes.

    Node i: rows lo[i]..hi[i]; inner nodes have the vantage point vp[i] and two
    children with the bounds of their distances to it.
    """
    order = np.arange(len(x))
    lo, hi, vp, kids, bounds = [], [], [], [], []

    def grow(a: int, b: int) -> int:
        me = len(lo)
        lo.append(a)
        hi.append(b)
        vp.append(-1)
        kids.append((-1, -1))
        bounds.append((0.0, 0.0, 0.0, 0.0))
        if b - a <= LEAF:
            return me
        rows = order[a:b]
        point = rows[(b - a) // 2]
        d = np.sqrt(((x[rows] - x[point]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        if d[by[-1]] == 0:  # all the same: no split helps
            return me
        order[a:b] = rows[by]
        mid = (b - a) // 2
        vp[me] = int(point)
        left, right = grow(a, a + mid), grow(a + mid, b)
        kids[me] = (left, right)
        bounds[me] = (d[by[0]], d[by[mid - 1]], d[by[mid]], d[by[-1]])
        return me

    grow(0, len(x))
    return {"order": order, "lo": np.array(lo), "hi": np.array(hi), "vp": np.array(vp), "kids": np.array(kids), "bounds": np.array(bounds)}


def within(distance: np.ndarray, factor: float) -> np.ndarray:
    return factor * distance * (1 + SLACK) + SLACK


class Search:
    """The k nearest rows so far for a block of queries."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, most: np.ndarray, k: int, factor: float):
        self.q, self.q_ids, self.most, self.k, self.factor = q, q_ids, most, k, factor
        self.best = np.full((len(q), k), np.inf)
        self.best_id = np.full((len(q), k), np.iinfo(np.int64).max)

    def through(self, ids: np.ndarray, x: np.ndarray, tree: dict) -> None:
        """Goes on with one more tree."""
        self.ids, self.x, self.tree = ids, x, tree
        self.visit(0, np.arange(len(self.q)))

    def reach(self, who: np.ndarray) -> np.ndarray:
        """What lies farther is of no use: the k-th best distance, here or known before."""
        return within(np.minimum(self.best[who, -1], self.most[who]), self.factor)

    def leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        most = max(1, 4_000_000 // max(1, self.x.shape[1] * len(rows)))
        for at in range(0, len(who), most):
            w = who[at : at + most]
            d = np.sqrt(((self.q[w][:, None, :] - self.x[rows][None]) ** 2).sum(2))
            i = np.broadcast_to(self.ids[rows], d.shape)
            d = np.where(i == self.q_ids[w][:, None], np.inf, d)
            i = np.where(np.isinf(d), np.iinfo(np.int64).max, i)
            d, i = np.concatenate([self.best[w], d], 1), np.concatenate([self.best_id[w], i], 1)
            first = np.lexsort((i, d), axis=1)[:, : self.k]
            self.best[w], self.best_id[w] = np.take_along_axis(d, first, 1), np.take_along_axis(i, first, 1)

    def visit(self, node: int, who: np.ndarray) -> None:
        t = self.tree
        if not len(who):
            return
        if t["vp"][node] < 0:
            rows = t["order"][t["lo"][node] : t["hi"][node]]
            for at in range(0, len(rows), 1024):
                self.leaf(rows[at : at + 1024], who)
            return
        d = np.sqrt(((self.q[who] - self.x[t["vp"][node]]) ** 2).sum(1))
        b = t["bounds"][node]
        sides = [(int(t["kids"][node][s]), np.maximum(np.maximum(b[2 * s] - d, d - b[2 * s + 1]), 0)) for s in (0, 1)]
        near = sides[0][1] <= sides[1][1]
        for first in (True, False):
            for s, (kid, gap) in enumerate(sides):
                mine = near if s == 0 else ~near
                mine = mine if first else ~mine
                # the k-th best has moved since, so it is looked at anew
                self.visit(kid, who[mine][gap[mine] <= self.reach(who[mine])])


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)


def _by_dim(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    size = pc.list_value_length(column).to_numpy()
    for dim in np.unique(size).tolist():
        yield dim, np.flatnonzero(size == dim)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(centres)))
    step = max(1, 4_000_000 // max(1, centres.size))
    for a in range(0, len(x), step):
        out[a : a + step] = np.sqrt(((x[a : a + step, None, :] - centres[None]) ** 2).sum(2))
    return out


def _place(centres):
    """Rows with the number of the nearest centre of their length (-1: none) and the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names, "dim", "centre", "away"]
            for dim, rows in _by_dim(batch.column(2)):
                part = batch.take(pa.array(rows))
                near, away = np.full(len(rows), -1), np.zeros(len(rows))
                if dim in centres.value:
                    d = _distances(_matrix(part.column(2)), centres.value[dim])
                    near = d.argmin(1)
                    away = d[np.arange(len(rows)), near]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), dim, np.int32)), pa.array(near.astype(np.int32)), pa.array(away)], names)

    return run


def _route(centres, shards, factor: float):
    """A row for each query and shard that it cannot leave out, without the shard it has been to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch.column(2)):
                table = shards.value.get(dim)
                if table is None:
                    continue
                part = batch.take(pa.array(rows))
                centre, low, high, parts = table
                most = part.column(5).to_numpy()
                gap = np.zeros((len(rows), len(centre)))
                known = centre >= 0
                if known.any():
                    d = _distances(_matrix(part.column(2)), centres.value[dim][centre[known]])
                    gap[:, known] = np.maximum(np.maximum(low[known] - d, d - high[known]), 0)
                q, c = np.nonzero(gap <= within(most, factor)[:, None])
                n = parts[c]
                of = np.repeat(np.arange(len(q)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                home = part.column(4).to_numpy()
                fresh = (at > 0) | (centre[c][of] != home[q][of])
                of, at = of[fresh], at[fresh]
                names = pa.array([f"{dim}/{x}/{y}" for x, y in zip(centre[c][of].tolist(), at.tolist())], pa.string())
                told = part.take(pa.array(q[of]))
                yield pa.RecordBatch.from_arrays([names, *told.columns[:3], told.column(5)], ["shard", "row", "id", "v", "most"])

    return run


def _search(k: int, factor: float):
    """The k best of each shard for its queries; rows are sorted by shard, its vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, tree = None, [], [], None
        for batch in batches:
            shard = np.array(batch.column(0).to_pylist(), object)
            query = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            turn = np.ones(len(shard), bool)
            turn[1:] = (shard[1:] != shard[:-1]) | (query[1:] != query[:-1])
            cut = [*np.flatnonzero(turn).tolist(), len(shard)]
            for a, b in zip(cut, cut[1:]):
                if shard[a] != now:
                    now, ids, parts, tree = shard[a], [], [], None
                x, own = _matrix(batch.column(3).slice(a, b - a)), batch.column(2).slice(a, b - a).to_numpy()
                if not query[a]:
                    ids.append(own)
                    parts.append(x)
                    continue
                if not parts:
                    continue
                if tree is None:
                    all_ids, all_x = np.concatenate(ids), np.concatenate(parts)
                    order = np.argsort(all_ids, kind="stable")
                    all_ids, all_x = all_ids[order], all_x[order]
                    tree = build(all_x)
                row, most = batch.column(1).slice(a, b - a).to_numpy(), batch.column(4).slice(a, b - a).to_numpy()
                for i in range(0, b - a, BLOCK_ROWS):
                    j = slice(i, i + BLOCK_ROWS)
                    s = Search(x[j], own[j], most[j], k, factor)
                    s.through(all_ids, all_x, tree)
                    some = np.isfinite(s.best) & (s.best <= s.most[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, some.sum(1))) for c in (row[j], own[j])] + [pa.array(s.best_id[some]), pa.array(s.best[some])], ["row", "query_id", "vec_id", "score"])

    return run


FOUND = "row long, query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of each query, from 1.

    vectors, queries: have vec_id and embedding.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")

    def usable(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
        fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)) & F.exists("v", lambda c: c != 0)
        return v.filter(fine)

    all_ = scratch.keep(usable(vectors).select(F.monotonically_increasing_id().alias("row"), "id", "v"), "usable")
    wanted = max(1, min(MOST_CENTRES, -(-all_.count() // shard_rows)))
    found: dict[int, list] = {}
    for r in all_.orderBy(F.xxhash64("id", "row"), "row").limit(wanted).select("v").collect():
        found.setdefault(len(r["v"]), []).append(r["v"])
    centres = spark.sparkContext.broadcast({dim: np.unique(np.array(x), axis=0) for dim, x in found.items()})
    rows = "row long, id long, v array<double>, dim int, centre int, away double"
    placed = scratch.keep(all_.mapInArrow(_place(centres), rows), "placed")
    scratch.drop("usable")
    # a row for each centre, and for each length without one
    stats = placed.groupBy("dim", "centre").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")).toArrow()
    shards: dict[int, list] = {}
    for r in stats.to_pylist():
        shards.setdefault(r["dim"], []).append((r["centre"], r["low"], r["high"], r["parts"]))
    shards = spark.sparkContext.broadcast({dim: [np.array(c) for c in zip(*x)] for dim, x in shards.items()})
    parts = F.broadcast(spark.createDataFrame(stats.select(["dim", "centre", "parts"]).to_pandas(), "dim int, centre int, parts int"))
    name = lambda part: F.concat_ws("/", "dim", "centre", part)
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    dealt = placed.join(parts, ["dim", "centre"]).withColumn("part", part).select(name("part").alias("shard"), F.lit(None).cast("long").alias("row"), "id", "v", F.lit(None).cast("double").alias("most"), "part")
    asked = usable(queries).distinct().select(F.monotonically_increasing_id().alias("row"), "id", "v")
    asked = scratch.keep(scratch.keep(asked, "asked").mapInArrow(_place(centres), rows), "homes")

    def search(held: DataFrame, sent: DataFrame) -> DataFrame:
        both = held.drop("part").unionByName(sent)
        return both.repartition("shard").sortWithinPartitions("shard", F.col("row").asc_nulls_first()).mapInArrow(_search(k, factor), FOUND)

    home = asked.select(name(F.lit(0)).alias("shard"), "row", "id", "v", F.lit(math.inf).alias("most"))
    first = scratch.keep(search(dealt.filter("part = 0"), home), "first")
    kth = first.groupBy("row").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(math.inf).alias("most"))
    known = asked.join(kth, "row", "left").select("row", "id", "v", "dim", "centre", F.coalesce("most", F.lit(math.inf)).alias("most"))
    routed = known.mapInArrow(_route(centres, shards, factor), "shard string, row long, id long, v array<double>, most double")
    all_found = first.unionByName(search(dealt, routed))
    # a limit by rank is taken on either side of the shuffle
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return all_found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
