"""Stages of the pipeline read what the stage before has written."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_are_written(spark, sf, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.where("doc_id % 2 = 0 OR doc_id > 50")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(k, stage) for k in "abc"])
    got = corpus_pipeline.run(spark, sf)
    want = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0 OR doc_id > 50")
    assert got.count() == want.count() and got.agg(F.sum("doc_id")).first() == want.agg(F.sum("doc_id")).first()
    assert all("documents.parquet" in f for f in read[0]) and not any("documents.parquet" in f for r in read[1:] for f in r)
    assert len(set(map(tuple, read))) == 3
