"""The registered queries over the smallest tables, and the pipeline's stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from weftline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = con.execute(queries.ORACLE[name])
    order = sorted((d[0], i) for i, d in enumerate(found.description))
    assert columns == [n for n, _ in order]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for _, i in order]) for r in found.fetchall())


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    packed = corpus_pipeline.run(spark, DATA)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    kept = corpus_pipeline.quality(spark, docs, DATA)
    judged = {r.doc_id for r in queries.op3_rules(spark, DATA).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == judged and kept.columns == docs.columns
    assert ids < judged and len(ids) > 0.6 * len(judged)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns, name
