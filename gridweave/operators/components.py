"""Connected components of an undirected graph given as a table of links.

Alternates two steps until nothing changes: every node links its larger
neighbours to its smallest one, then its smaller neighbours to its smallest one.
Both are a minimum by node, which is summed before the shuffle, and a join back;
paths shrink fast, so few rounds are needed.  Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridweave.sources.scratch import Scratch


def _to_smallest(arcs: DataFrame, keys: list[str], only_larger: bool) -> DataFrame:
    """arcs: keys, u, v.  Links each v (and u) to the smallest of u and its neighbours."""
    least = arcs.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = arcs.join(least, [*keys, "u"])
    if only_larger:
        joined = joined.filter(F.col("v") > F.col("u"))
        return joined.select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    back = least.filter(F.col("m") < F.col("u")).select(*keys, "u", F.col("m").alias("v"))
    return joined.filter(F.col("v") > F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(back)


def components(links: DataFrame, keys: tuple[str, ...] = (), scratch: Scratch | None = None, most_rounds: int = 100) -> DataFrame:
    """keys, node, component (its smallest node) for every node of a link.

    links: keys, u, v; loops and repeated links do no harm.  More than most_rounds
    rounds, which no graph of less than 2^most_rounds nodes should need, are an error.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    keys = list(keys)
    links = scratch.keep(links.select(*keys, "u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull()), "links")
    arcs = links.filter("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    arcs = scratch.keep(arcs, "round-0")
    before = None
    for k in range(1, most_rounds + 1):
        both = arcs.unionByName(arcs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, keys, True).distinct()
        arcs = scratch.keep(_to_smallest(large, keys, False).distinct(), f"round-{k}")
        scratch.drop(f"round-{k - 1}")
        now = tuple(arcs.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = links.select(*keys, F.explode(F.array("u", "v")).alias("node")).distinct()
    told = arcs.select(*keys, F.col("u").alias("node"), F.col("v").alias("c"))
    return nodes.join(told, [*keys, "node"], "left").select(*keys, "node", F.coalesce("c", "node").alias("component"))
