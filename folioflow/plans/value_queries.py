"""Flags, digests, colours, matrices, functions and byte filters on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.color import cmyk_to_rgb, exponential, matrix_apply, matrix_concat, sampled, stitching
from folioflow.plans import query, table

# The bits, from 0, of what a document's permissions allow
PERMISSIONS = {"print": 2, "modify": 3, "extract": 4, "annotate": 5}


@query("SELECT p_partkey, " + ", ".join(f"(p_size >> {n}) & 1 = 1 AS can_{k}" for k, n in PERMISSIONS.items()) + " FROM part")
def permission_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[(F.getbit(F.col("p_size"), F.lit(n)) == 1).alias(f"can_{k}") for k, n in PERMISSIONS.items()])


RANGE_SQL = "b AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, strlen(text) // 4 AS a, strlen(text) // 2 AS c FROM documents WHERE text IS NOT NULL)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    raw = d.select("doc_id", F.encode("text", "UTF-8").alias("raw")).withColumn("n", F.length("raw"))
    return raw.withColumn("a", F.floor(F.col("n") / 4).cast("int")).withColumn("c", F.floor(F.col("n") / 2).cast("int"))


@query(f"WITH {RANGE_SQL} SELECT doc_id, sha256(unhex(left(h, 2 * a) || substring(h, 2 * c + 1))) AS digest, CAST(a + n - c AS BIGINT) AS signed_length FROM b")
def signed_bytes_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    signed = F.concat(F.substring("raw", F.lit(1), F.col("a")), F.substring("raw", F.col("c") + 1, F.col("n")))
    return r.select("doc_id", F.sha2(signed, 256).alias("digest"), F.length(signed).cast("long").alias("signed_length"))


@query(f"""WITH {RANGE_SQL}, s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n - c ELSE n - c - 1 END AS last, n, c, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '30' ELSE '41' END AS first FROM b)
  SELECT doc_id, CASE WHEN c + last < n THEN 'IncompleteByteRange' WHEN first = '' THEN 'Failed' WHEN first <> '30' THEN 'Unsupported' ELSE 'DigestPresent' END AS status FROM s""")
def byte_range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.signatures import byte_range_status as status

    r = _ranges(spark, sf_dir)
    last = F.when(F.col("doc_id") % 4 == 0, F.col("n") - F.col("c")).otherwise(F.col("n") - F.col("c") - 1)
    contents = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit(""))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("3001"))).otherwise(F.unhex(F.lit("4101")))
    return r.select("doc_id", status(F.col("c"), last, F.col("n"), contents).alias("status"))


@query("""SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'x' || d.doc_id END, d.source) AS title, coalesce(CAST(l.toxic AS VARCHAR), d.lang) AS author, d.source AS creator
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    xmp = x.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    xmp = xmp.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).alias("x_title"), F.col("toxic").cast("string").alias("x_author"))
    return d.join(xmp, "doc_id", "left").select("doc_id", F.coalesce("x_title", "source").alias("title"), F.coalesce("x_author", "lang").alias("author"), F.col("source").alias("creator"))


@query("""SELECT l_returnflag, l_linestatus, round(avg((1 - l_discount) * (1 - l_tax)), 6) AS r, round(avg((1 - l_quantity / 50) * (1 - l_tax)), 6) AS g, round(avg((1 - l_discount * 5) * (1 - l_tax)), 6) AS b FROM lineitem GROUP BY ALL""")
def cmyk_to_rgb_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rgb = cmyk_to_rgb(F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_discount") * 5, F.col("l_tax"))
    return li.select("l_returnflag", "l_linestatus", rgb.alias("c")).groupBy("l_returnflag", "l_linestatus").agg(*[F.round(F.avg(f"c.{k}"), 6).alias(k) for k in "rgb"])


@query("""SELECT o_orderkey, round(o_totalprice * (2 * 0.5) + (o_custkey % 7) * (1 * 0.5 + 3 * -1) + (5 * 0.5 + 7 * -1 + 9), 6) AS x, round(o_totalprice * (2 * 4.0) + (o_custkey % 7) * (1 * 4.0 + 3 * 2) + (5 * 4.0 + 7 * 2 + 8), 6) AS y FROM orders""")
def matrix_apply_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [F.lit(float(v)) for v in (2, 0, 1, 3, 5, 7)]
    m = matrix_concat(n, [F.lit(float(v)) for v in (0.5, 4, -1, 2, 9, 8)])
    p = matrix_apply(m, F.col("o_totalprice"), (F.col("o_custkey") % 7).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 50 AS x FROM lineitem)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN x < 0.5 THEN 0.2 + (x / 0.5) * (x / 0.5) * 0.6 ELSE
    (CASE WHEN 1 - (x - 0.5) / 0.5 >= 0.5 THEN 0.5 + (1 - (x - 0.5) / 0.5 - 0.5) * 2 * 0.5 ELSE (1 - (x - 0.5) / 0.5) * 2 * 0.5 END) END, 6) AS y FROM v""")
def function_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y = stitching(F.col("l_quantity") / 50, [lambda v: exponential(v, 0.2, 0.8, 2), lambda v: sampled(v, [0.0, 0.5, 1.0])], [0.5], [(0, 1), (1, 0)])
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(y, 6).alias("y"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS n_bytes, true AS flate, true AS hex, true AS a85, true AS run_length, true AS predictor FROM documents WHERE text IS NOT NULL")
def filter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.sources.pdf import filter_roundtrips

    return filter_roundtrips(table(spark, sf_dir, "documents").where("text is not null"))
