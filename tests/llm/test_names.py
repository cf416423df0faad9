"""Columns of the input whose names the operators use themselves, and the pipeline on its own output."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from proofbase.llm import common, lines, sharding

HELPERS = ("depth", "shard", "fits", "shard_bytes", "n_bytes", "_key", "_k", "_s", "_r", "_c", "_l", "_gone", "_row", "_own_0", "prefix", "bytes", "docs", "key", "cell", "low", "high", "over", "n_lines", "n_removed", "line", "n", "Depth_", "a b.c")
ROWS = [(i, f"shared line\nown {i}\n\n shared line " if i % 3 else None if i % 2 else "", "en", f"s{i % 7}") for i in range(60)] + [(5, "shared line\nown 5\n\n shared line ", "en", "s5"), (None, "x", None, None), (61, "long words " * 120_000, "en", "s1")]


@pytest.fixture(scope="module")
def named(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return plain, plain.withColumns({x: F.concat(F.lit(x), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for x in HELPERS})


@pytest.mark.parametrize(("operator", "results"), [(sharding.shards, ["n_bytes", "shard", "depth", "shard_bytes", "fits"]), (lines.line_dedup, ["text", "n_lines", "n_removed"])])
def test_any_column_name_is_kept_or_replaced(named, operator, results):
    plain, docs = named
    want = sorted(map(str, operator(plain).select("doc_id", "source", *results).collect()))
    found = operator(docs)
    assert sorted(map(str, found.select("doc_id", "source", *results).collect())) == want
    kept = [x for x in HELPERS if x not in results]
    assert set(found.columns) == {*plain.columns, *HELPERS, *results}
    for r in found.select("doc_id", *(f"`{x}`" for x in kept)).collect():
        assert [r[x] for x in kept] == [f"{x}{'-' if r['doc_id'] is None else r['doc_id']}" for x in kept]
    again = operator(found)
    assert set(again.columns) == set(found.columns) and again.count() == len(ROWS)


def test_pipeline_on_its_own_output(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({x: F.concat(F.lit(x), F.col("doc_id").cast("string")) for x in HELPERS})
    for _ in range(2):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, SF))
        assert set(docs.columns) == {*spark.read.parquet(f"{SF}/documents.parquet").columns, *HELPERS}
        assert docs.where("depth is null or shard_bytes < n_bytes").count() == 0 and docs.count() > 100
