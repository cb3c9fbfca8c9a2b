"""The queries of this subpackage: one for each operator, over whole tables. None has a form in SQL that DuckDB can run (they need xxhash64,
crc32, tokenizers or models), so tests/llm holds each against a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import edits, langid, lines, media, mixing, neardup, packing, quality, sharding, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_documents(spark, sf_dir))


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.fingerprint_classes(_documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_of_documents(_documents(spark, sf_dir))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.qualities(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cleaned_documents(_documents(spark, sf_dir))


def op7_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of(_documents(spark, sf_dir))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_rows(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
