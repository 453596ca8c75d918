"""The pipeline on the smallest tables and on odd documents."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.cases import no_documents, odd_documents

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        before = {(r.doc_id, r.text, r.source) for r in docs.collect()}
        after = [(r.doc_id, r.text, r.source) for r in out.collect()]
        assert after and set(after) <= before, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert rows.columns == ["doc_id", "lang", "source", "ids", "n_ids"]
    assert rows.count() == docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_odd_documents_pass_through(spark):
    for make in (odd_documents, no_documents):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() >= 0
