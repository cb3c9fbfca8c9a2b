"""Queries over the driver's tables: each a Spark function and, where SQL can say it, the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["layout_queries", "tag_queries", "ocr_queries", "value_queries", "graph_queries", "pdf_queries", "file_queries"]


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"folioflow.plans.{name}")
    return QUERIES, ORACLES
