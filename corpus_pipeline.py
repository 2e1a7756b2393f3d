"""The corpus pipeline: each stage works on all documents that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``; the last returns token counts and digests.
Each judges a row by its own text, whether its id is null or repeated; rows that repeat id and text are one document, of which
the dedup stages keep one. Null texts are empty ones; all columns pass, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import roundtrip_digests
from tessera.llm.decontaminate import without_contaminated
from tessera.llm.exact_dedup import without_copies
from tessera.llm.ngram_join import without_near_copies
from tessera.llm.toxicity import THRESHOLD, fit, held_out, with_scores
from tessera.workspace import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. Texts are scored in place: nothing is shuffled.

    Where the labels of these documents are not of both kinds there is nothing to learn, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    kinds = labels.where("toxic is not null").join(docs.select("doc_id"), "doc_id", "left_semi").select("toxic").distinct().limit(2).count()
    if kinds < 2:
        return docs
    model = fit(docs, labels)
    own, names = "toxicity", {c.lower() for c in docs.columns}
    while own in names:
        own += "_"
    return with_scores(docs, model, score=own).where(F.col(own) < THRESHOLD).drop(own)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the row that exact dedup keeps."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by n-gram Jaccard similarity, that with the smallest id."""
    return without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return roundtrip_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Toxicity scores and BPE cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
