"""Archival and print standards over document features.

A row of features for each document: encrypted, xmp (text of the metadata stream), lzw, open_action_js, names_js, aa, fonts (array of
struct(name, embedded)), output_intents (array of subtypes), device_spaces, info_title, xmp_title, info_author, xmp_author, page_groups (array of
S names) and print_boxes (array of booleans, one for each page). Checks are columns of one pass; no join.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A_LEVELS = ["A1b", "A2b", "A3b"]
X_LEVELS = ["X1a", "X3", "X4"]


def _differ(a: str, b: str) -> Column:
    return F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))


def conditions() -> dict[str, Column]:
    """Each check's condition; none is null if its features aren't."""
    transparent = F.exists("page_groups", lambda g: g == "Transparency")
    return {
        "no-encryption": ~F.col("encrypted"),
        "xmp-metadata": F.coalesce(F.col("xmp").contains("pdfaid:part") | F.col("xmp").contains("pdfa:part"), F.lit(False)),
        "no-lzw-filters": ~F.col("lzw"),
        "no-javascript": ~(F.col("open_action_js") | F.col("names_js") | F.col("aa")),
        "fonts-embedded": F.forall("fonts", lambda f: f["embedded"]),
        "color-spaces": (F.size("output_intents") > 0) | ~F.col("device_spaces"),
        "metadata-consistency": ~(_differ("info_title", "xmp_title") | _differ("info_author", "xmp_author")),
        "no-transparency": ~transparent,
        "output-intent-pdfx": F.array_contains("output_intents", "GTS_PDFX"),
        "trim-or-art-box": F.forall("print_boxes", lambda b: b),
    }


def checks_of(standard: str) -> list[str]:
    if standard in A_LEVELS:
        base = ["no-encryption", "fonts-embedded", "xmp-metadata", "no-lzw-filters", "no-javascript", "metadata-consistency", "color-spaces"]
        return base + ["no-transparency"] * (standard == "A1b")
    if standard in X_LEVELS:
        return ["output-intent-pdfx", "fonts-embedded", "trim-or-art-box", "no-encryption"] + ["no-transparency"] * (standard == "X1a")
    raise ValueError(f"one of {A_LEVELS + X_LEVELS}")


def _all(passed: list[Column]) -> Column:
    """Whether all that are known hold; null if none is known."""
    return F.when(F.coalesce(*passed).isNotNull(), reduce(and_, [F.coalesce(c, F.lit(True)) for c in passed]))


def report(features: DataFrame, standards: list[str]) -> DataFrame:
    """doc_id, standard, compliant, total, passed_count: a row for each standard, from one pass over the features. Nothing is grouped or shuffled."""
    cond = conditions()
    passed = [[cond[k] for k in checks_of(s)] for s in standards]
    rows = [F.struct(F.lit(s).alias("standard"), _all(p).alias("compliant"), F.lit(len(p)).cast("long").alias("total"), reduce(add, [F.coalesce(c, F.lit(False)).cast("long") for c in p]).alias("passed_count")) for s, p in zip(standards, passed, strict=True)]
    return features.select("doc_id", F.explode(F.array(*rows)).alias("c")).select("doc_id", "c.*")


def validate(features: DataFrame, standard: str) -> DataFrame:
    """doc_id, standard, id, passed: a row for each check of the standard."""
    cond = conditions()
    checks = F.array(*[F.struct(F.lit(k).alias("id"), cond[k].alias("passed")) for k in checks_of(standard)])
    return features.select("doc_id", F.lit(standard).alias("standard"), F.explode(checks).alias("c")).select("doc_id", "standard", "c.id", "c.passed")
