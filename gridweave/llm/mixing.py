"""Operator 3: mixing sources to target weights by capped water-filling.

Sources sorted by code point (null last) get the weights in turn.  Each asks for
its share of all words; a source that would exceed `cap` times its own size is
held there and its excess is shared anew by weight, until none exceeds.  That
fixed point is a water level: target = min(cap * size, level * weight).

A source then takes every document floor(target / size) times and once more the
documents that come first in a seeded hash order of id and text, up to the rest of
its target (within half a document).  The order is summed in two steps, over 4096 ranges of
the hash and inside each range, so no task holds a whole source.

Defined results: a null text has size 0; a null source is a source of its own;
a source of size 0 has target 0 and takes nothing; a null id is ordered as the
empty string; repeated rows are taken one by one; an empty table gives no rows.
Only doc_id, source, text and the columns to carry are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridweave.llm.text import WORD
from gridweave.sources.scratch import Scratch

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17


def ranked(df: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """df with `rank`, from 1 in the column's order (null last), without one task for all rows."""
    parts = scratch.keep(df.orderBy(F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "parts")
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last()))
    return parts.join(before.select("part", "before"), "part").withColumn("rank", own + F.col("before")).drop("part", "before")


def water_level(sources: DataFrame, cap: int) -> float:
    """The level at which the capped sources together hold all words; only sums come to the driver."""
    level = -1.0
    while True:
        held = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        s = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(held, F.col("source_size") * cap).otherwise(0)).alias("held"), F.sum(F.when(held, 0).otherwise(F.col("weight"))).alias("free")).first()
        if not s["all"] or not s["free"]:
            return max(level, 0.0)
        new = (s["all"] - s["held"]) / s["free"]
        if new <= level:
            return level
        level = new


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, carry: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, times for each document.

    carry: a column of docs that goes along as `carried`, to tell rows of one id apart.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    along = [F.col(carry).alias("carried")] if carry else []
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("turn"), *along)
    sized = scratch.keep(sized, "sized")
    along = ["carried"] if carry else []
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source", scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = scratch.keep(sources.withColumn("weight", weight.cast("long")), "sources")
    level = water_level(sources, cap)
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.lit(level) * F.col("weight"))
    told = sources.withColumn("target", target).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    told = told.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select(F.col("source").alias("s"), "rank", "source_size", "target", "whole", "rest")
    rows = sized.join(told, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("range", F.substring("turn", 1, 3))
    sums = rows.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.sum("words").over(Window.partitionBy("rank").orderBy("range")) - F.col("words"))
    rows = rows.join(before.select("rank", "range", "before"), ["rank", "range"])
    within = F.sum("size").over(Window.partitionBy("rank", "range").orderBy("turn", "doc_id", "size", *along).rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("before") + within  # words up to and with this document
    extra = F.when(2 * upto - F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.col("whole"))
    return rows.withColumn("times", times.cast("long")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", *along)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS turn
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::BIGINT AS words_left, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS weight_left
  FROM sources
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(max(words_left::DOUBLE / weight_left::DOUBLE) FILTER (words_left::DOUBLE / weight_left::DOUBLE < (3 * source_size)::DOUBLE / weight::DOUBLE), 0) AS level
  FROM filled),
told AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, level * weight) AS target
  FROM sources, level),
upto AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN told t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN size > 0 AND 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM upto
"""
