"""The ten operators as queries over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import bpe, chunks, language_model, minhash, mixing, neighbours, quality, suffixes, token_count, url_filter


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ids=False, digests=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("times")


def op4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled(spark))
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), weights).drop("score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(_table(spark, sf_dir, "documents"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.spans(_table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_chunks": op4_chunks,
    "op5_url_filter": op5_url_filter,
    "op9_quality": op9_quality,
    "op6_language_model": op6_language_model,
    "op10_neighbours": op10_neighbours,
    "op7_suffixes": op7_suffixes,
    "op8_token_count": op8_token_count,
}
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.SQL,
    "op5_url_filter": url_filter.sql(),
}
