"""The corpus pipeline: five stages, each written as Parquet and read by the next.

Quality rules drop documents, near-duplicates leave one document of each group,
repeated passages are cut from all documents but the first, the mix repeats or
drops documents to meet its targets, and the rest is encoded.

Stages take rows, not ids, for documents: where an operator needs an id, the rows
of the stage's input are numbered in a written table, so rows with a null id and
different texts under one id are all judged and kept or dropped by themselves.
Repeated rows are copies of each other.  Null and empty texts fail the quality
rules; where they come to a later stage, they are linked with nothing, hold no
passage, have size 0 and encode to no token.  Columns of docs may have any
names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.llm import bpe, minhash, mixing, quality, suffixes
from gridweave.llm.queries import tokenizer
from gridweave.sources.scratch import Scratch, free_name


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and the name of that column."""
    name = free_name(docs.columns, "row_number")
    return Scratch(docs.sparkSession, label).keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id (null last), then of the first row."""
    rows, number = numbered(docs, "near-dedup")
    groups = minhash.near_duplicates(rows, key=number).select(F.col("doc_id").alias("member"), F.col("component_id").alias("group"))
    ids = rows.select(F.col(number).alias("node"), F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    chosen = ids.join(groups, F.col("node") == F.col("member")).groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.node").alias(number))
    return rows.join(chosen, number, "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that an earlier one holds."""
    rows, number = numbered(docs, "repeats")
    return suffixes.cut_repeats(rows, key=number).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    rows, number = numbered(docs, "mix")
    times = free_name(rows.columns, "times")
    taken = mixing.mix(rows, carry=number).filter("times > 0").select(F.col("carried").alias(number), F.col("times").cast("int").alias(times))
    copies = rows.join(taken, number).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times))
    return copies.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text."""
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", good), ("near_dedup", one_of_each), ("repeats", without_repeats), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
