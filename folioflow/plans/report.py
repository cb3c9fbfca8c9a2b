"""The corpus structure report: per document its pages, text, roles and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import layout
from folioflow.sources import pdf


def structure_report(files: DataFrame) -> DataFrame:
    """files (doc_id, content) to doc_id, page_count, text_bytes (first three pages), tagged, and roles: of the first page, and blocks of all."""
    parsed = pdf.parse(files, ["pages", "runs", "tree"])
    first = F.filter("pages", lambda p: p["page_index"] < 3)
    size = F.aggregate(first, F.lit(0).cast("long"), lambda a, p: a + F.octet_length(F.coalesce(p["text"], F.lit(""))))
    docs = parsed.where("error is null").select("doc_id", "page_count", size.alias("text_bytes"), F.col("tree").isNotNull().alias("tagged"))
    blocks = layout.blocks(pdf.text_runs(parsed))
    on_first = F.col("page_index") == 0
    roles = blocks.groupBy("doc_id").agg(
        F.count_if(on_first).alias("blocks"), *[F.count_if(on_first & (F.col("role") == r)).alias(n) for r, n in (("Heading", "headings"), ("Paragraph", "paragraphs"), ("ListItem", "list_items"), ("Code", "code_blocks"))],
        F.count(F.lit(1)).alias("tags_made"),
    )
    out = docs.join(roles, "doc_id", "left")
    counts = ["blocks", "headings", "paragraphs", "list_items", "code_blocks", "tags_made"]
    return out.select("doc_id", "page_count", "text_bytes", "tagged", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
