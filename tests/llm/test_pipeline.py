"""The pipeline's stages one by one, each against its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatquarry.llm import jaccard_join

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs, seen = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if k < 4:
            assert docs.columns == documents.columns
    before = {r.doc_id: r.text for r in documents.collect()}
    for name, after in seen.items():
        assert all(before[k] == v for k, v in after.items()), name
        before = after
    rated = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    good = [k for k in seen["quality"] if k in rated]
    assert sum(rated[k][0] for k in good) > 0.98 * len(good)
    assert len([k for k in good if rated[k][0]]) > 0.98 * sum(q for q, _ in rated.values())
    assert all(rated[k][1] for k in seen["quality"] if k in rated and k not in seen["toxicity"])
    again = jaccard_join.jaccard_join(spark.read.parquet(str(tmp_path / "near_duplicates")))
    assert again.where(~F.col("kept")).count() == 0
    bench = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dropped = {k for k in seen["near_duplicates"] if k not in seen["decontamination"]}
    assert dropped == {k for k, t in seen["near_duplicates"].items() if any(b in t for b in bench)}
    assert docs.where("size > 0 and (taken <= 0 or taken > 3 * size)").count() == 0
    for r in docs.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.15 * r.target + 50
