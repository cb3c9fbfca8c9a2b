"""Accessibility, tagging and standards on structure made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.operators import standards, tags
from folioflow.plans import query, table

# headings: level 1 to 6 by value, in order of event_id, a document for each user
HEAD_SQL = "h AS (SELECT user_id AS doc_id, event_id, 1 + CAST(floor(value) AS BIGINT) % 6 AS level FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"
# elements: role by event_id, depth 1 to 4, order by event_id
ELEM_SQL = """e AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, 1 + event_id % 4 AS depth,
  CASE event_id % 13 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' WHEN 2 THEN 'TH' WHEN 3 THEN 'Note' WHEN 4 THEN 'Figure' WHEN 5 THEN 'Table' ELSE 'P' END AS role,
  CASE WHEN value < 40 OR value IS NULL THEN NULL ELSE 'alt' END AS alt FROM events WHERE user_id IS NOT NULL)"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    level = (1 + F.floor("value") % 6).cast("int")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("dfs_ord"), F.lit("H").alias("role"), level.alias("level"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null")
    role = F.expr("CASE event_id % 13 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' WHEN 2 THEN 'TH' WHEN 3 THEN 'Note' WHEN 4 THEN 'Figure' WHEN 5 THEN 'Table' ELSE 'P' END")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").alias("doc_id"), (F.row_number().over(order) - 1).alias("dfs_ord"), (1 + F.col("event_id") % 4).cast("int").alias("depth"), role.alias("struct_type"), role.alias("role"), F.lit(None).cast("int").alias("level"),
        F.when(F.col("value") >= 40, "alt").alias("alt_text"),
    )


@query(f"""WITH {HEAD_SQL} SELECT doc_id, event_id AS dfs_ord, CAST(level AS INT) AS level, CAST(seen AS INT) AS seen FROM
  (SELECT *, max(level) OVER (PARTITION BY doc_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM h) WHERE level > seen + 1""")
def heading_order_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.heading_skips(headings(spark, sf_dir))


@query(f"""WITH {HEAD_SQL} SELECT doc_id, event_id AS dfs_ord, CAST(level AS INT) AS level, CAST(previous AS INT) AS previous FROM
  (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY event_id) AS previous FROM h) WHERE level > previous + 1""")
def heading_skips_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.adjacent_skips(headings(spark, sf_dir))


@query(f"WITH {ELEM_SQL} SELECT doc_id, CAST(ord AS INT) AS dfs_ord, CAST(depth AS INT) AS depth FROM e WHERE role = 'Figure' AND alt IS NULL")
def figure_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.figures_without_alt(elements(spark, sf_dir)).select("doc_id", "dfs_ord", "depth")


TABLES_SQL = """t AS (SELECT t.doc_id, t.ord, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.ord) AS i, EXISTS (SELECT 1 FROM e x WHERE x.doc_id = t.doc_id AND x.ord > t.ord AND x.role = 'TH'
    AND NOT EXISTS (SELECT 1 FROM e y WHERE y.doc_id = t.doc_id AND y.ord > t.ord AND y.ord <= x.ord AND y.depth <= t.depth)) AS has FROM e t WHERE t.role = 'Table')"""


@query(f"WITH {ELEM_SQL}, {TABLES_SQL} SELECT doc_id, CAST(ord AS INT) AS dfs_ord, CAST(i AS INT) AS i FROM t WHERE NOT has")
def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tables_without_headers(elements(spark, sf_dir))


@query(f"WITH {ELEM_SQL} SELECT doc_id, CAST(count(*) FILTER (role = 'Note') AS BIGINT) AS notes, count(*) FILTER (role = 'Note') = 0 AS passed FROM e GROUP BY doc_id")
def fenote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("role") == "Note").alias("notes"), (F.count_if(F.col("role") == "Note") == 0).alias("passed"))


@query(f"""WITH {ELEM_SQL}, {TABLES_SQL}, d AS (SELECT doc_id, doc_id % 3 <> 0 AS lang, bool_or(role = 'Figure' AND alt IS NULL) AS fig, bool_or(role = 'Note') AS note FROM e GROUP BY doc_id),
  b AS (SELECT doc_id, bool_or(NOT has) AS bad FROM t GROUP BY doc_id)
  SELECT doc_id, lang AND NOT fig AND NOT note AND NOT coalesce(bad, false) AS compliant, CAST(6 AS BIGINT) AS total,
    CAST(2 + CAST(lang AS INT) + CAST(NOT fig AS INT) + CAST(NOT note AS INT) + CAST(NOT coalesce(bad, false) AS INT) AS BIGINT) AS passed_count FROM d LEFT JOIN b USING (doc_id)""")
def accessibility_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    elems = elements(spark, sf_dir)
    trees = elems.select("doc_id").distinct().select("doc_id", F.lit(True).alias("has_tree"), F.when(F.col("doc_id") % 3 != 0, "en").alias("tree_lang"))
    return tags.report(tags.validate_ua(elems, trees)).select("doc_id", "compliant", "total", "passed_count")


@query("SELECT page_id, nullif(regexp_extract(html, '<html[^>]* lang=\"?([A-Za-z-]+)', 1), '') AS lang, regexp_matches(html, '<html[^>]* lang=\"?[A-Za-z-]') AS passed FROM pages WHERE html IS NOT NULL")
def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.nullif(F.regexp_extract("html", '<html[^>]* lang="?([A-Za-z-]+)', 1), F.lit(""))
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", lang.alias("lang"), lang.isNotNull().alias("passed"))


@query(f"""WITH {ELEM_SQL}, d AS (SELECT DISTINCT doc_id FROM e), f AS (SELECT doc_id, count(*) AS n FROM e WHERE role = 'Figure' AND alt IS NULL GROUP BY doc_id)
  SELECT doc_id, 'Document has no structure tree (untagged)' AS description, 'error' AS severity FROM d WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'No /Lang attribute on structure tree', 'error' FROM d WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'Detected ' || (doc_id % 7) || ' headings but structure tree has none', 'warning' FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 > 0
  UNION ALL SELECT doc_id, n || ' Figure element(s) missing alt text', 'error' FROM f WHERE doc_id % 5 <> 0""")
def tag_issues_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    elems = elements(spark, sf_dir)
    docs = elems.select("doc_id").distinct()
    trees = docs.select("doc_id", (F.col("doc_id") % 5 != 0).alias("has_tree"), F.when(F.col("doc_id") % 3 != 0, "en").alias("tree_lang"))
    # two pages with as many headings each, so that issues repeat
    heads = docs.where("doc_id % 7 > 0").withColumn("page_index", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 7).cast("int"))))
    return tags.tag_issues(trees, elems, heads.select("doc_id", "page_index", F.lit("Heading").alias("role")))


FEATURE_SQL = """f AS (SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS encrypted, o_orderpriority LIKE '1%' AS xmp, o_orderkey % 11 = 0 AS js, coalesce(bool_or(l_returnflag = 'R'), false) AS lzw,
    coalesce(bool_and(l_discount < 0.09), true) AS fonts, o_orderkey % 4 AS intents, o_orderkey % 6 = 0 AS device, o_orderkey % 5 = 0 AS differ, o_orderkey % 9 = 0 AS transparent, coalesce(bool_and(l_tax < 0.07), true) AS boxes
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    # an order's lines as flags, which are grouped in place: an array of them would be sorted and held. What is embedded is one font, what isn't another
    embedded, box = F.col("l_discount") < 0.09, F.col("l_tax") < 0.07
    flags = {"embedded": embedded, "plain": ~embedded, "box": box, "no_box": ~box}
    per = li.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("lzw"), *[F.bool_or(c).alias(n) for n, c in flags.items()])
    there = lambda of: F.filter(F.array(*[F.when(F.col(n), v) for n, v in of.items()]), lambda v: v.isNotNull())
    fonts = there({n: F.struct(F.lit(n).alias("name"), F.lit(n == "embedded").alias("embedded")) for n in ("embedded", "plain")})
    per = per.select("l_orderkey", "lzw", fonts.alias("fonts"), there({"box": F.lit(True), "no_box": F.lit(False)}).alias("print_boxes"))
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    j = o.join(per, k == F.col("l_orderkey"), "left")
    return j.select(
        k.alias("doc_id"), (F.col("o_orderstatus") == "F").alias("encrypted"), F.when(F.col("o_orderpriority").startswith("1"), "<pdfaid:part>1</pdfaid:part>").alias("xmp"), F.coalesce("lzw", F.lit(False)).alias("lzw"),
        (k % 11 == 0).alias("open_action_js"), F.lit(False).alias("names_js"), F.lit(False).alias("aa"), F.coalesce("fonts", F.array().cast("array<struct<name: string, embedded: boolean>>")).alias("fonts"),
        F.when(k % 4 == 0, F.array(F.lit("GTS_PDFX"))).when(k % 4 == 1, F.array(F.lit("GTS_PDFA1"))).otherwise(none).alias("output_intents"), (k % 6 == 0).alias("device_spaces"),
        F.lit("a").alias("info_title"), F.when(k % 5 == 0, "b").when(k % 5 == 1, "a").alias("xmp_title"), F.lit(None).cast("string").alias("info_author"), F.lit("c").alias("xmp_author"),
        F.when(k % 9 == 0, F.array(F.lit("Transparency"))).otherwise(none).alias("page_groups"), F.coalesce("print_boxes", F.array().cast("array<boolean>")).alias("print_boxes"),
    )


@query(f"""WITH {FEATURE_SQL}, a AS (SELECT doc_id, 'A1b' AS standard, [NOT encrypted, fonts, xmp, NOT lzw, NOT js, NOT differ, intents < 2 OR NOT device, NOT transparent] AS p FROM f
  UNION ALL SELECT doc_id, 'A2b', [NOT encrypted, fonts, xmp, NOT lzw, NOT js, NOT differ, intents < 2 OR NOT device] FROM f
  UNION ALL SELECT doc_id, 'X1a', [intents = 0, fonts, boxes, NOT encrypted, NOT transparent] FROM f UNION ALL SELECT doc_id, 'X4', [intents = 0, fonts, boxes, NOT encrypted] FROM f)
  SELECT doc_id, standard, NOT list_contains(p, false) AS compliant, CAST(len(p) AS BIGINT) AS total, CAST(len(list_filter(p, lambda x: x)) AS BIGINT) AS passed_count FROM a""")
def standards_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.report(features(spark, sf_dir), ["A1b", "A2b", "X1a", "X4"])
