"""Object graphs, trees and corpus totals on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import graph
from folioflow.plans import query, table


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and supplier as a tree: ids 1000000 + region, 2000000 + nation, 3000000 + supplier; a document for each region."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    top = r.select(F.col("r_regionkey").alias("doc_id"), (F.col("r_regionkey") + 1000000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_regionkey").cast("int").alias("ord"), F.trim("r_name").alias("name"))
    mid = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 2000000).cast("long"), (F.col("n_regionkey") + 1000000).cast("long"), F.col("n_nationkey").cast("int"), F.trim("n_name"))
    low = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), (F.col("s_suppkey") + 3000000).cast("long"), (F.col("s_nationkey") + 2000000).cast("long"), F.col("s_suppkey").cast("int"), F.trim("s_name"))
    return top.union(mid).union(low)


TREE_SQL = """SELECT r_regionkey AS doc_id, CAST(r_regionkey + 1000000 AS BIGINT) AS id, trim(r_name) AS name, 1 AS depth FROM region
  UNION ALL SELECT n_regionkey, n_nationkey + 2000000, trim(r_name) || '.' || trim(n_name), 2 FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT n_regionkey, s_suppkey + 3000000, trim(r_name) || '.' || trim(n_name) || '.' || trim(s_name), 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey"""


@query(f"SELECT doc_id, id, name FROM ({TREE_SQL}) WHERE depth = 3")
def form_qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flatten(_tree(spark, sf_dir)).where("depth = 3").select("doc_id", "id", "name")


@query(f"SELECT doc_id, id, name AS title_path, CAST(depth AS INT) AS depth FROM ({TREE_SQL})")
def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flatten(_tree(spark, sf_dir)).select("doc_id", "id", F.col("name").alias("title_path"), "depth")


@query("""SELECT n_regionkey AS doc_id, s_suppkey + 3000000 AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, s_suppkey) - 1 AS INT) AS page_index,
  CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE n_regionkey END AS BIGINT) AS media_box FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey""")
def page_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    flat = graph.flatten(_tree(spark, sf_dir)).where("depth = 3")
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    # a nation whose key is a multiple of 3 has a box of its own, else its region's is inherited
    own = F.when(F.col("path")[1] % 3 == 0, F.col("path")[1])
    return flat.select("doc_id", "id", page.alias("page_index"), F.coalesce(own, F.col("path")[0]).cast("long").alias("media_box"))


@query("SELECT o_orderkey, o_custkey AS num, c_name AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 4 <> 0")
def object_ref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.lit(0).alias("doc_id"), F.col("o_custkey").alias("num"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0).alias("gen"), "o_orderkey")
    objects = table(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), F.col("c_custkey").alias("num"), F.lit(0).alias("gen"), F.col("c_name").alias("value"))
    return graph.resolve(refs, objects).select("o_orderkey", "num", "value")


@query("""WITH m AS (SELECT max(c_custkey) AS top FROM customer), s AS (SELECT max(s_suppkey) AS top FROM supplier)
  SELECT 0 AS part, c_custkey AS num, c_custkey AS new_num, CAST(c_nationkey AS BIGINT) AS ref FROM customer
  UNION ALL SELECT 1, s_suppkey, s_suppkey + m.top, s_nationkey + m.top FROM supplier, m
  UNION ALL SELECT 2, n_nationkey, n_nationkey + m.top + s.top, n_regionkey + m.top + s.top FROM nation, m, s""")
def merge_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k, name, num, ref: table(spark, sf_dir, name).select(F.lit(k).alias("part"), F.col(num).cast("long").alias("num"), F.array(F.col(ref).cast("long")).alias("refs"))
    docs = part(0, "customer", "c_custkey", "c_nationkey").union(part(1, "supplier", "s_suppkey", "s_nationkey")).union(part(2, "nation", "n_nationkey", "n_regionkey"))
    return graph.renumber(docs).select("part", "num", "new_num", F.col("refs")[0].alias("ref"))


@query("""SELECT source, lang, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM documents WHERE text IS NOT NULL GROUP BY ROLLUP (source, lang)""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.size(F.split("text", "\n", -1))).alias("n_lines"))
