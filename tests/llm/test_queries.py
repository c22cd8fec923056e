"""Queries of the operators, their SQL, and the pipeline."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm import queries

from ..conftest import DATA
from .test_operators import SCHEMA, corpus


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(agree, name):
    agree(queries.QUERIES[name], queries.ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    stages, sizes = dict(corpus_pipeline.STAGES), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert [*stages] == ["quality", "near_dedup", "repeats", "mixing", "bpe"]
    assert sizes[0] > sizes[1] >= sizes[2] and sizes[4] == sizes[3]
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/near_dedup").collect()}
    assert 0 in kept and not kept & {40, 41, 42}  # copies of 0, 0 and 5
    assert docs.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run_reads_documents(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


AWKWARD = SCHEMA + ", copy int, times int, row_number int, member int, cut_spans int, cut_doc int, kept_id int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, one id for different texts, repeated rows, null and empty texts, a long text, clashing names."""
    text = dict((i, t) for i, t, *_ in corpus())
    rows = [(7, text[0]), (7, text[1]), (None, text[2]), (None, text[2]), (None, text[4]), (8, text[5]), (8, text[5]), (9, None), (10, ""), (11, " ".join(f"{text[i]}" for i in range(20, 40)) * 5)]
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 3 else None, len(t or ""), *[99] * 7) for k, (i, t) in enumerate(rows)], AWKWARD).repartition(2).cache()


@pytest.mark.parametrize("name", ["quality", "near_dedup", "repeats", "mixing"])
def test_stages_take_awkward_rows(spark, awkward, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, "")
    assert out.dtypes == awkward.dtypes
    rows = out.collect()
    assert all(tuple(r)[5:] == (99,) * 7 for r in rows)
    texts = {r.text for r in rows}
    whole = {r.text for r in awkward.collect() if r.text}
    if name in ("quality", "near_dedup"):
        repeated = max(whole, key=len)  # says everything five times
        assert whole - ({repeated} if name == "quality" else set()) <= texts  # different texts under one id or none all stay
    if name == "near_dedup":
        assert len(rows) == 8  # of both pairs of copies one row
    if name == "repeats":
        assert sum(r.text is not None and len(r.text) > 0 for r in rows) == 6 and {9, 10} <= {r.doc_id for r in rows}
    if name == "mixing":
        assert texts <= whole | {None, ""}
    empty = stage(spark, awkward.limit(0), "")
    assert empty.dtypes == awkward.dtypes and empty.count() == 0


def test_encoding_takes_awkward_rows(spark, awkward):
    out = dict(corpus_pipeline.STAGES)["bpe"](spark, awkward, "")
    assert out.count() == awkward.count() and out.filter("n_tokens = 0").count() == 2
    assert dict(corpus_pipeline.STAGES)["bpe"](spark, awkward.limit(0), "").count() == 0
