"""Continuous ingest of document files. An extension: the same parse stage on a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.sources.pdf import parse

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """New files under a path, at most so many in a batch."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    return files.withColumnRenamed("path", "doc_id")


def stream_parsed(spark: SparkSession, path: str, outputs: list[str], **options) -> DataFrame:
    return parse(stream_files(spark, path, **options), outputs)
