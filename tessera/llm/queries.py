"""One query for each numbered operator, over its whole table with production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import oracles
from .bpe import roundtrip_digests
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .license_scan import license_scan, templates
from .ngram_join import ngram_jaccard_join
from .phrases import mine_phrases
from .quality_rules import STOP_WORDS, quality_rules
from .sharding import shard_uniformly
from .token_output import token_files_digest
from .toxicity import toxicity
from .url_filter import url_filter
from .vector_codes import vector_codes
from .warc import warc_roundtrip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_digests(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_digest(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_roundtrip(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_uniformly(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_license_scan": op6_license_scan,
        "op7_token_output": op7_token_output,
        "op8_warc": op8_warc,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
        "op11_vector_codes": op11_vector_codes,
        "op12_quality_rules": op12_quality_rules,
        "op13_phrases": op13_phrases,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": oracles.OP2,
        "op3_benchmark_decontamination": oracles.OP3,
        "op4_exact_dedup": oracles.OP4,
        "op6_license_scan": oracles.op6(templates()),
        "op11_vector_codes": oracles.op11(),
        "op12_quality_rules": oracles.op12(STOP_WORDS),
        "op13_phrases": oracles.OP13,
    }
