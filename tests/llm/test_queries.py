"""Registered queries against their SQL twins, and the pipeline."""

import os

import pytest

import corpus_pipeline
from check_oracle import compare, connect
from firegrid.llm import queries

DATA = os.environ.get("FIREGRID_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    assert compare(queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()) == "ok"


@pytest.mark.parametrize("name,columns", [("op3_jaccard_join", {"doc_id", "n_shingles", "component_id"}), ("op6_toxicity_compression", {"doc_id", "held_out", "score", "predicted"}), ("op10_deleted_interpolation", {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"})])
def test_one_row_per_document(spark, name, columns):
    got = queries.QUERIES[name](spark, DATA)
    assert columns <= set(got.columns)
    ids = [r[0] for r in got.select("doc_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert 0.5 * n < docs.count() <= n
    assert set(columns) < set(docs.columns) and docs.count() > 0
