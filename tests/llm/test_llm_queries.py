"""The registered queries, against DuckDB where there is SQL, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trustmill.llm import queries

TABLES = ("documents", "benchmark", "pages", "labels", "embeddings")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op12_conversation_repair"}))  # which has tests of its own
def test_query_gives_whole_results(spark, sf_dir, name):
    n = queries.QUERIES[name](spark, sf_dir).count()
    rows = spark.read.parquet(f"{sf_dir}/{'pages' if 'url' in name or 'warc' in name else 'documents'}.parquet").count()
    assert n >= rows if name.startswith("op1_") else n == rows


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op4_language_id"](spark, sf_dir).filter("held_out").join(docs, "doc_id")
    n, right = found.count(), found.filter("lang = lang_pred").count()
    assert right >= 0.9 * n


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "?! 123", "en", "s", 6), (10**6 + 2, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    before = docs.count()
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            assert out.count() <= before
            before, docs = out.count(), out
            if k == 0:
                assert docs.filter(F.col("doc_id") >= 10**6).count() == 0
    assert out.select("doc_id").distinct().count() == before


def test_stages_of_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
