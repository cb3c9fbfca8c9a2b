"""OCR and image operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import ocr, tags
from folioflow.plans import query, table

PAIR_SQL = """p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 3 THEN regexp_replace(text, '[aeiou]', chr(65533), 'g') ELSE text END AS s,
    CASE WHEN doc_id % 10 = 2 THEN '' WHEN doc_id % 5 = 4 THEN (SELECT text FROM benchmark ORDER BY item_id LIMIT 1) WHEN doc_id % 10 = 1 THEN '' ELSE text END AS o FROM documents WHERE text IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    one = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.col("text").alias("b"))  # one row
    s = F.when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 3, F.regexp_replace("text", "[aeiou]", "�")).otherwise(F.col("text"))
    o = F.when(F.col("doc_id") % 10 == 2, "").when(F.col("doc_id") % 5 == 4, F.col("b")).when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("text"))
    return docs.join(F.broadcast(one)).select("doc_id", s.alias("stream_text"), o.alias("ocr_text"))


GARBLED = r"(length({0}) > 0 AND (length({0}) - length(regexp_replace({0}, '[\x{{FFFD}}\x00]|[^\x01-\x7F\p{{L}}\p{{N}}\x{{00A0}}\x{{0085}}\x{{2000}}-\x{{200A}}\x{{3000}}]', '', 'g'))) / length({0}) > 0.2)"


@query(
    f"""WITH {PAIR_SQL}, c AS (SELECT doc_id, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(o, '\\s+', ' ', 'g')) AS o FROM p),
  w AS (SELECT *, list_distinct(list_filter(string_split(s, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(o, ' '), lambda x: x <> '')) AS b FROM c),
  m AS (SELECT *, CASE WHEN s = '' OR o = '' THEN 0.0 WHEN s = o THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS sim FROM w)
  SELECT doc_id, CASE WHEN s = '' AND o = '' THEN 'Neither' WHEN s = '' THEN 'Ocr' WHEN o = '' THEN 'ContentStream' WHEN sim > 0.8 THEN 'ContentStream' WHEN {GARBLED.format("s")} AND NOT {GARBLED.format("o")} THEN 'Ocr' ELSE 'Both' END AS source,
    round(CAST(sim AS DOUBLE), 6) AS similarity FROM m"""
)
def hybrid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.compare_sources(_pairs(spark, sf_dir)).select("doc_id", "source", F.round("similarity", 6).alias("similarity"))


PIXEL_SQL = "p AS (SELECT label, CAST(floor((x + 1) * 127) AS INT) AS v FROM (SELECT label, unnest(embedding) AS x FROM embeddings))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))
    # in single precision, as the numbers are: with an int Spark would go to double, and a value just under a whole number would fall to the one below
    one, scale = F.lit(1).cast("float"), F.lit(127).cast("float")
    return e.select("label", F.floor((F.col("x") + one) * scale).cast("int").alias("v"))


OTSU_SQL = """k AS (SELECT label, v, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT l.label, CAST(r.t AS INT) AS t, coalesce(k.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT label FROM p) l CROSS JOIN range(256) r(t) LEFT JOIN k ON k.label = l.label AND k.v = r.t),
  s AS (SELECT label, t, sum(n) OVER w AS wb, sum(n * t) OVER w AS sb, sum(n) OVER a AS total, sum(n * t) OVER a AS st FROM g WINDOW w AS (PARTITION BY label ORDER BY t), a AS (PARTITION BY label)),
  q AS (SELECT label, t, CASE WHEN wb > 0 AND total - wb > 0 THEN wb * (total - wb) * (sb / wb - (st - sb) / (total - wb)) * (sb / wb - (st - sb) / (total - wb)) END AS var FROM s WHERE t < 255),
  o AS (SELECT label, t AS threshold FROM q WHERE var IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY var DESC, t DESC) = 1)"""


@query(f"WITH {PIXEL_SQL}, {OTSU_SQL} SELECT label, threshold FROM o")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.otsu(_pixels(spark, sf_dir), ["label"])


@query(f"""WITH {PIXEL_SQL}, e AS (SELECT label, min(v) AS lo, max(v) AS hi FROM p GROUP BY label),
  z AS (SELECT label, CAST(CASE WHEN hi - lo < 1 THEN v ELSE round((v - lo) / (hi - lo) * 255) END AS INT) AS v FROM p JOIN e USING (label))
  SELECT label, count(*) AS pixels, min(v) AS lo, max(v) AS hi, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v > 127) AS white FROM z GROUP BY label""")
def contrast_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ocr.enhance_contrast(_pixels(spark, sf_dir), ["label"]).withColumn("v", F.col("stretched"))
    white = F.count_if(ocr.binarize(F.col("v"), F.lit(127)) == 255)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("pixels"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("total"), white.alias("white"))


WORD_SQL = "w AS (SELECT user_id, event_id AS word_index, event_type AS text, event_id * 13 % 700 AS y, 10 + event_id % 30 AS height FROM events WHERE user_id IS NOT NULL)"
PARA_SQL = """s AS (SELECT *, CASE WHEN lag(y + height) OVER o IS NULL OR greatest(y - lag(y + height) OVER o, 0) > 30 THEN 1 ELSE 0 END AS st FROM w WINDOW o AS (PARTITION BY user_id ORDER BY word_index)),
  q AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY word_index) AS paragraph FROM s)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null")
    return e.select("user_id", F.col("event_id").alias("word_index"), F.col("event_type").alias("text"), F.lit(0).alias("x"), (F.col("event_id") * 13 % 700).alias("y"), F.lit(5).alias("width"), (10 + F.col("event_id") % 30).alias("height"))


@query(f"WITH {WORD_SQL}, {PARA_SQL} SELECT user_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS n, min(word_index) AS first_word FROM q GROUP BY ALL")
def ocr_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tags.ocr_paragraphs(_words(spark, sf_dir), ["user_id"])
    return out.groupBy("user_id", "paragraph").agg(F.count(F.lit(1)).alias("n"), F.min("word_index").alias("first_word"))


@query(f"""WITH {WORD_SQL}, {PARA_SQL}, d AS (SELECT user_id, list_sort(list(height)) AS hs FROM w GROUP BY user_id),
  g AS (SELECT user_id, paragraph, list_sort(list(height)) AS hs FROM q GROUP BY ALL),
  h AS (SELECT g.user_id, paragraph, g.hs[len(g.hs) // 2 + 1] AS height, g.hs[len(g.hs) // 2 + 1] > floor(d.hs[len(d.hs) // 2 + 1] * 1.4) AS heading FROM g JOIN d USING (user_id))
  SELECT user_id, CAST(paragraph AS BIGINT) AS paragraph, height, CASE WHEN heading THEN CAST(least(dense_rank() OVER (PARTITION BY user_id ORDER BY CASE WHEN heading THEN height END DESC NULLS LAST), 6) AS INT) END AS level FROM h""")
def ocr_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.ocr_structure(_words(spark, sf_dir), ["user_id"]).select("user_id", "paragraph", "height", "level")


@query("""WITH i AS (SELECT o_custkey AS c, o_orderkey * 7 % 2000 AS s, o_orderkey * 7 % 2000 + CAST(floor(o_totalprice) AS BIGINT) % 50 AS e FROM orders),
  r AS (SELECT c, s, max(e) OVER (PARTITION BY c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
  SELECT c AS o_custkey, s - reach AS gap, reach AS gap_start FROM r WHERE s - reach > 0 QUALIFY row_number() OVER (PARTITION BY c ORDER BY s - reach DESC, reach) = 1""")
def xy_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") * 7 % 2000
    return ocr.widest_gap(o.select("o_custkey", start.alias("s"), (start + F.floor("o_totalprice") % 50).alias("e")), ["o_custkey"], "s", "e")


@query("""SELECT user_id, CAST(event_id AS INT) AS x, event_type AS text, round((value - 10) / 100, 6) AS confidence FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_id % 3 <> 0 AND event_type <> '' AND value >= 10""")
def tesseract_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    row = F.concat_ws("\t", F.when(F.col("event_id") % 3 == 0, "4").otherwise("5"), *[F.lit("1")] * 5, F.col("event_id").cast("string"), F.lit("200"), F.lit("150"), F.lit("30"), (F.col("value") - 10).cast("string"), F.col("event_type"))
    tsv = e.groupBy("user_id").agg(F.concat_ws("\n", F.lit("level\tpage"), F.concat_ws("\n", F.sort_array(F.collect_list(row)))).alias("tsv"))
    out = ocr.parse_tsv(tsv)
    return out.select("user_id", "x", "text", F.round("confidence", 6).alias("confidence"))
