"""Stages of the pipeline where another table is empty."""

from __future__ import annotations

import pytest

import corpus_pipeline

TEXTS = ["a fine text of some words here", "you vile awful thing go away", None, ""]


@pytest.mark.parametrize("labels", [[], [(1, 0, None)], [(0, 1, 1), (1, 1, 1), (2, 1, 1)], [(77, 0, 0), (78, 0, 1)]])
def test_labels_of_one_kind_condemn_nothing(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, toxicity int")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect())) and kept.columns == docs.columns


def test_empty_benchmark_drops_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))
