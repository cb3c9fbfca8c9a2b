"""Layout operators on text runs made from the driver's tables. Geometry lies on half points, so that sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import font_style, inline_role, is_garbled, is_page_number, list_marker, normalize_for_repeat
from folioflow.operators import layout
from folioflow.plans import query, table

LINES_SQL = """lines AS (
  SELECT doc_id, source, line, i - 1 AS i FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL))"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


def runs_of(lines: DataFrame, text="line", size=None, font=None, mono=None, bold=None) -> DataFrame:
    """A run for each line that isn't empty: 46 lines a page, 14 points apart from y 720 down, at x 72."""
    size = F.lit(12.0) if size is None else size
    return lines.where("line <> ''").select(
        "doc_id", F.floor(F.col("i") / 46).cast("int").alias("page_index"), (F.col("i") % 46).cast("int").alias("run_index"), (F.col(text) if isinstance(text, str) else text).alias("text"),
        (F.lit("Helvetica") if font is None else font).alias("font_name"), size.alias("font_size"), F.lit(72.0).alias("x"), (720.0 - 14 * (F.col("i") % 46)).alias("y"),
        (F.length(F.col(text) if isinstance(text, str) else text) * size * 0.5).alias("width"), size.alias("height"), (F.lit(False) if bold is None else bold).alias("is_bold"), F.lit(False).alias("is_italic"),
        (F.lit(False) if mono is None else mono).alias("is_monospaced"), F.lit(0).alias("rendering_mode"),
    )


@query(f"""WITH {LINES_SQL} SELECT doc_id, CAST(i // 46 AS INT) AS page_index, CAST(i % 46 AS INT) AS run_index, line AS text,
  CAST(72 AS DOUBLE) AS x, CAST(720 - 14 * (i % 46) AS DOUBLE) AS y, CAST(12 AS DOUBLE) AS font_size, CAST(length(line) * 6 AS DOUBLE) AS width
  FROM lines WHERE line <> ''""")
def text_runs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(document_lines(spark, sf_dir)).select("doc_id", "page_index", "run_index", "text", "x", "y", "font_size", "width")


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null and user_id is not null")
    return e.select("user_id", F.col("event_id").alias("run_index"), F.col("value").alias("y"), F.col("event_id").cast("double").alias("x"))


FOLD_SQL = """WITH RECURSIVE o AS (
    SELECT {page} AS page, {x} AS x, {y} AS y, row_number() OVER (PARTITION BY {page} ORDER BY {y} DESC, {x}) AS rn FROM {table}),
  f AS (SELECT page, rn, x, y, y AS anchor, 1 AS line_no FROM o WHERE rn = 1
    UNION ALL SELECT o.page, o.rn, o.x, o.y, CASE WHEN abs(f.anchor - o.y) <= 2.0 THEN f.anchor ELSE o.y END,
      CASE WHEN abs(f.anchor - o.y) <= 2.0 THEN f.line_no ELSE f.line_no + 1 END FROM f JOIN o ON o.page = f.page AND o.rn = f.rn + 1)"""


@query(
    FOLD_SQL.format(page="user_id", x="event_id", y="value", table="events WHERE value IS NOT NULL AND user_id IS NOT NULL")
    + " SELECT page AS user_id, CAST(line_no AS INT) AS line_no, count(*) AS n_runs, max(anchor) AS line_y, CAST(min(x) AS DOUBLE) AS min_x FROM f GROUP BY page, line_no"
)
def lines_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.group_lines(_event_runs(spark, sf_dir), ["user_id"])
    return rows.groupBy("user_id", "line_no").agg(F.count(F.lit(1)).alias("n_runs"), F.max("line_y").alias("line_y"), F.min("x").alias("min_x"))


def _item_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_orderkey").alias("run_index"), F.lit("").alias("text"), F.concat("l_returnflag", "l_linestatus").alias("font_name"),
        (F.col("l_quantity") / 2).alias("font_size"), F.lit(72.0).alias("x"), F.round("l_extendedprice").alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), (F.col("l_discount") > 0.045).alias("is_bold"),
        F.lit(False).alias("is_italic"), F.lit(False).alias("is_monospaced"), F.lit(0).alias("rendering_mode"),
    )


@query(
    FOLD_SQL.format(page="l_suppkey", x="l_orderkey", y="round(l_extendedprice)", table="lineitem")
    + """, n AS (SELECT l_suppkey AS page, round(l_quantity) AS k, l_returnflag || l_linestatus AS font, count(*) AS n, count(*) FILTER (l_discount > 0.045) AS bold FROM lineitem GROUP BY ALL),
  s AS (SELECT page, k, sum(n) AS total, sum(bold) AS bold, row_number() OVER (PARTITION BY page ORDER BY sum(n) DESC, k) AS r FROM n GROUP BY page, k),
  b AS (SELECT s.page, s.k / 2 AS size, s.bold > s.total // 2 AS bold, (SELECT font FROM n WHERE n.page = s.page AND n.k = s.k ORDER BY n DESC, font LIMIT 1) AS font FROM s WHERE r = 1),
  a AS (SELECT DISTINCT page, line_no, anchor FROM f),
  g AS (SELECT page, lag(anchor) OVER (PARTITION BY page ORDER BY line_no) - anchor AS gap FROM a),
  m AS (SELECT b.page, list_sort(list(gap)) AS gaps FROM b JOIN g ON g.page = b.page AND gap > 0.1 AND gap < size * 5 GROUP BY b.page)
  SELECT b.page AS l_suppkey, size AS body_size, b.font AS body_font, b.bold AS body_bold, coalesce(gaps[len(gaps) // 2 + 1], size * 1.2) AS median_spacing FROM b LEFT JOIN m ON m.page = b.page"""
)
def font_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.font_stats(_item_runs(spark, sf_dir))
    return out.select(F.col("doc_id").alias("l_suppkey"), "body_size", "body_font", "body_bold", "median_spacing")


@query("""WITH r AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS size, p_partkey % 7 = 0 AS bold, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS no,
    10.0 * (p_partkey - lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS gap FROM part),
  n AS (SELECT p_brand, size, count(*) AS total, count(*) FILTER (bold) AS bolds, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, size) AS k FROM r GROUP BY p_brand, size),
  b AS (SELECT p_brand, size AS body, bolds > total // 2 AS body_bold FROM n WHERE k = 1),
  m AS (SELECT b.p_brand, list_sort(list(gap)) AS gaps FROM b JOIN r ON r.p_brand = b.p_brand AND gap > 0.1 AND gap < body * 5 GROUP BY b.p_brand),
  h AS (SELECT r.*, size > body * 1.2 OR (bold AND NOT body_bold AND (coalesce(gap > coalesce(gaps[len(gaps) // 2 + 1], body * 1.2) * 1.5, false) OR size > body)) AS heading
    FROM r JOIN b USING (p_brand) LEFT JOIN m USING (p_brand)),
  d AS (SELECT p_brand, size, least(dense_rank() OVER (PARTITION BY p_brand ORDER BY size DESC), 6) AS level FROM (SELECT DISTINCT p_brand, size FROM h WHERE heading))
  SELECT h.p_brand, CAST(no AS INT) AS block_no, CASE WHEN heading THEN 'Heading' ELSE 'Paragraph' END AS role, CASE WHEN heading THEN CAST(level AS INT) END AS level
  FROM h LEFT JOIN d ON heading AND d.p_brand = h.p_brand AND d.size = h.size""")
def headings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    runs = p.select(
        F.col("p_brand").alias("doc_id"), F.lit(0).alias("page_index"), F.col("p_partkey").alias("run_index"), F.lit("x y").alias("text"), F.col("p_type").alias("font_name"), F.col("p_size").cast("double").alias("font_size"),
        F.lit(72.0).alias("x"), (-10.0 * F.col("p_partkey")).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), (F.col("p_partkey") % 7 == 0).alias("is_bold"), F.lit(False).alias("is_italic"),
        F.lit(False).alias("is_monospaced"), F.lit(0).alias("rendering_mode"),
    )
    return layout.blocks(runs).select(F.col("doc_id").alias("p_brand"), "block_no", "role", F.col("level").cast("int").alias("level"))


MARK_SQL = "CASE doc_id % 6 WHEN 0 THEN '1. ' WHEN 1 THEN ' a) ' WHEN 2 THEN '(iv) ' WHEN 3 THEN '• ' WHEN 4 THEN 'A. ' ELSE '' END"
MARKER_SQL = r"""CASE WHEN regexp_matches(t, '^[•‣●○■▪–—*-]') THEN left(t, 1)
  ELSE coalesce(nullif(regexp_extract(t, '^(\((?:[0-9]{1,4}|[A-Za-z]|(?i:i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii))\))', 1), ''),
    nullif(regexp_extract(t, '^((?:[0-9]+|[a-z]|i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)[.):])', 1), '')) END"""


@query(f"WITH {LINES_SQL} SELECT doc_id, CAST(i AS INT) AS line_no, {MARKER_SQL} AS marker FROM (SELECT doc_id, i, ltrim({MARK_SQL} || line) AS t FROM lines)")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(spark, sf_dir)
    return rows.select("doc_id", F.col("i").cast("int").alias("line_no"), list_marker(F.concat(F.expr(MARK_SQL), "line")).alias("marker"))


FONT_SQL = """CASE p_partkey % 9 WHEN 0 THEN 'Helvetica-Bold' WHEN 1 THEN 'ABCDEF+CourierNew,Bold' WHEN 2 THEN 'Cambria-Italic' WHEN 3 THEN 'Arial,BoldItalic' WHEN 4 THEN 'Consolas'
  WHEN 5 THEN 'XYZ+Foo-Bd' WHEN 6 THEN 'Menlo-Oblique' WHEN 7 THEN 'abc+Demi' ELSE p_type END"""
STYLE_SQL = f"""SELECT p_partkey, font, regexp_matches(low, 'bold|-bd|heavy|black|demi') AS bold, regexp_matches(low, 'italic|oblique|slant|-it') AS italic,
  regexp_matches(low, 'courier|consolas|mono|menlo|code|fixed|typewriter') AS monospaced
  FROM (SELECT p_partkey, font, lower(regexp_replace(font, '^[A-Z]{{0,6}}\\+', '')) AS low FROM (SELECT p_partkey, {FONT_SQL} AS font FROM part))"""


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(FONT_SQL).alias("font"))
    return p.select("p_partkey", "font", font_style(F.col("font")).alias("s")).select("p_partkey", "font", "s.*")


@query(STYLE_SQL)
def font_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _styled(spark, sf_dir)


@query(f"SELECT p_partkey, CASE WHEN monospaced THEN 'Code' WHEN bold AND italic THEN 'StrongEmphasis' WHEN bold THEN 'Strong' WHEN italic THEN 'Emphasis' ELSE 'Normal' END AS role FROM ({STYLE_SQL})")
def inline_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _styled(spark, sf_dir).select("p_partkey", inline_role(F.col("bold"), F.col("italic"), F.col("monospaced")).alias("role"))


@query(f"""WITH {LINES_SQL}, p AS (SELECT DISTINCT doc_id, i // 46 AS page FROM lines),
  t AS (SELECT doc_id, page, CASE doc_id % 5 WHEN 0 THEN CAST(page + 1 AS VARCHAR) WHEN 1 THEN '- ' || (page + 1) || ' -' WHEN 2 THEN 'Hello' WHEN 3 THEN ' 12. ' ELSE '1234567' END AS text,
    CASE WHEN doc_id % 3 = 0 THEN 400.0 WHEN doc_id % 3 = 1 THEN 30.0 ELSE 770.0 END AS y FROM p)
  SELECT doc_id, CAST(page AS INT) AS page_index, strlen(trim(text)) <= 6 AND regexp_matches(trim(text), '^[-. ]*[0-9]+[-. ]*$') AND (y > 712.8 OR y < 79.2) AS is_number FROM t""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = document_lines(spark, sf_dir).select("doc_id", F.floor(F.col("i") / 46).alias("page")).distinct()
    text = F.expr("CASE doc_id % 5 WHEN 0 THEN CAST(page + 1 AS STRING) WHEN 1 THEN '- ' || (page + 1) || ' -' WHEN 2 THEN 'Hello' WHEN 3 THEN ' 12. ' ELSE '1234567' END")
    y = F.expr("CASE WHEN doc_id % 3 = 0 THEN 400.0D WHEN doc_id % 3 = 1 THEN 30.0D ELSE 770.0D END")
    return p.select("doc_id", F.col("page").cast("int").alias("page_index"), is_page_number(text, y, F.lit(792.0)).alias("is_number"))


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id, i // 46 AS page, CASE WHEN i % 10 = 0 THEN 24 ELSE 12 END AS size, CASE WHEN i % 11 = 5 THEN 'Courier' ELSE 'Helvetica' END AS font,
    ltrim(CASE WHEN i % 7 = 3 THEN '1. ' ELSE '' END || line) AS t FROM lines WHERE line <> ''),
  b AS (SELECT doc_id, page, CASE WHEN count(*) FILTER (size = 24) > count(*) FILTER (size = 12) THEN 24 ELSE 12 END AS body FROM r GROUP BY ALL),
  n AS (SELECT doc_id, page, body, CASE WHEN count(*) FILTER (font = 'Courier' AND size = body) >= count(*) FILTER (font = 'Helvetica' AND size = body) THEN 'Courier' ELSE 'Helvetica' END AS body_font
    FROM r JOIN b USING (doc_id, page) GROUP BY ALL)
  SELECT doc_id, CASE WHEN size > body * 1.2 THEN 'Heading' WHEN ({MARKER_SQL}) IS NOT NULL THEN 'ListItem' WHEN font = 'Courier' AND body_font <> 'Courier' THEN 'Code' ELSE 'Paragraph' END AS role, count(*) AS n
  FROM r JOIN n USING (doc_id, page) GROUP BY ALL""")
def block_roles_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    text = F.concat(F.when(i % 7 == 3, "1. ").otherwise(""), "line")
    font = F.when(i % 11 == 5, "Courier").otherwise("Helvetica")
    runs = runs_of(document_lines(spark, sf_dir), text, F.when(i % 10 == 0, 24.0).otherwise(12.0), font, font == "Courier")
    return layout.blocks(runs).groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE o AS (SELECT user_id AS u, event_id AS e, CAST(event_id % 3 + 1 AS INT) AS n, event_id // 3 % 5 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE user_id IS NOT NULL),
  f AS (SELECT u, rn, n, s, n AS an, s AS anchor, 1 AS no, n >= 2 AS able FROM o WHERE rn = 1
    UNION ALL SELECT u, rn, n, s, CASE WHEN fits THEN an ELSE n END, CASE WHEN fits THEN anchor ELSE s END, CASE WHEN fits THEN no ELSE no + 1 END, n >= 2
    FROM (SELECT o.u, o.rn, o.n, o.s, f.an, f.anchor, f.no, f.able AND o.n >= 2 AND o.n = f.an AND abs(o.s - f.anchor) < 3 AS fits FROM f JOIN o ON o.u = f.u AND o.rn = f.rn + 1))
  SELECT u AS user_id, CAST(min(rn) AS INT) AS first_block, CAST(count(*) AS INT) AS n_rows, CAST(max(n) AS INT) AS n_columns FROM f WHERE able GROUP BY u, no HAVING count(*) >= 2""")
def tables_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null")
    shift = F.expr("event_id div 3 % 5").cast("double")
    xs = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), lambda k: F.struct((100.0 + 200 * k + shift).alias("x")))
    box = F.struct(F.lit(100.0).alias("x"), (-F.col("event_id")).cast("double").alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    blocks = e.select("user_id", F.col("event_id").alias("block_no"), F.lit("Paragraph").alias("role"), xs.alias("runs"), box.alias("bbox"))
    from pyspark.sql.window import Window

    blocks = blocks.withColumn("block_no", F.row_number().over(Window.partitionBy("user_id").orderBy("block_no")))
    return layout.tables(blocks, ["user_id"]).select("user_id", "first_block", "n_rows", "n_columns")


@query(f"""WITH {LINES_SQL}, e AS (SELECT source, doc_id, max(i) AS last FROM lines GROUP BY ALL),
  m AS (SELECT l.source, l.doc_id, trim(line) AS t, i = 0 AS head, i = last AND last > 0 AS foot FROM lines l JOIN e ON e.doc_id = l.doc_id AND e.source = l.source WHERE (i = 0 OR i = last) AND trim(line) <> ''),
  z AS (SELECT source, 'header' AS zone, regexp_replace(t, '[0-9]', '#', 'g') AS text FROM m WHERE head UNION ALL SELECT source, 'footer', regexp_replace(t, '[0-9]', '#', 'g') FROM m WHERE foot)
  SELECT source, zone, text, count(*) AS n, CASE zone WHEN 'header' THEN 770.0::DOUBLE ELSE 30.0::DOUBLE END AS y FROM z
  WHERE source IN (SELECT source FROM m GROUP BY source HAVING count(DISTINCT doc_id) > 1) GROUP BY ALL HAVING count(*) >= 2""")
def headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    ls = F.split("text", "\n", -1)
    both = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), ls.alias("ls"))
    ends = F.filter(F.array(F.struct(F.lit(1).alias("line_no"), F.lit(770.0).alias("y"), F.col("ls")[0].alias("t")), F.when(F.size("ls") > 1, F.struct(F.lit(2).alias("line_no"), F.lit(30.0).alias("y"), F.element_at("ls", -1).alias("t")))), lambda s: s.isNotNull() & (F.trim(s["t"]) != ""))
    lined = both.select("doc_id", "page_index", F.explode(ends).alias("z")).select("doc_id", "page_index", "z.line_no", "z.y", F.array(F.struct(F.col("z.t").alias("text"))).alias("runs"))
    return layout.headers_footers(lined, 792.0).select(F.col("doc_id").alias("source"), "zone", "text", "n", "y")


@query("""WITH r AS (SELECT c_nationkey AS p, c_custkey AS o, c_name AS t, CAST(c_custkey * 37 % 500 AS DOUBLE) AS x, CAST(c_custkey * 53 % 700 AS DOUBLE) AS y FROM customer),
  f AS (SELECT s_nationkey AS p, s_name AS field_name, CAST(s_suppkey * 71 % 500 + 60 AS DOUBLE) AS fx, CAST(s_suppkey * 29 % 700 AS DOUBLE) AS fy FROM supplier),
  d AS (SELECT f.p, field_name, o, t, least(CASE WHEN abs(y + 5 - (fy + 10)) < 15 AND x + 40 < fx + 5 AND fx - x - 40 >= 0 THEN fx - x - 40 END, CASE WHEN y > fy AND abs(x - fx) < 100 AND y - fy < 30 THEN y - fy END) AS distance FROM f JOIN r ON r.p = f.p)
  SELECT p AS nation, field_name, t AS label, distance FROM d WHERE distance IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p, field_name ORDER BY distance, o) = 1""")
def field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    runs = c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("run_index"), F.col("c_name").alias("text"), (F.col("c_custkey") * 37 % 500).cast("double").alias("x"), (F.col("c_custkey") * 53 % 700).cast("double").alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"))
    fields = s.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("field_name"), (F.col("s_suppkey") * 71 % 500 + 60).cast("double").alias("x"), (F.col("s_suppkey") * 29 % 700).cast("double").alias("y"), F.lit(100.0).alias("width"), F.lit(20.0).alias("height"))
    return layout.field_labels(runs, fields, ["nation"])


CAPTION_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'Figure ' || c_custkey WHEN 1 THEN c_name WHEN 2 THEN 'table of ' || c_custkey ELSE c_custkey || ' things' END"


@query(f"""WITH l AS (SELECT c_nationkey AS p, c_custkey AS o, {CAPTION_SQL} AS t, CAST(c_custkey * 37 % 500 AS DOUBLE) AS x, CAST(c_custkey * 53 % 700 AS DOUBLE) AS y FROM customer),
  i AS (SELECT s_nationkey AS p, s_name AS image_name, CAST(s_suppkey * 71 % 300 AS DOUBLE) AS ix, CAST(s_suppkey * 29 % 600 AS DOUBLE) AS iy FROM supplier),
  d AS (SELECT i.p, image_name, o, t, y, least(abs(iy - y), abs(y - (iy + 80))) AS d FROM i JOIN l ON l.p = i.p WHERE regexp_matches(lower(t), '^(figure|fig\\.|fig |image|photo|table|chart|diagram|illustration)|^[0-9]..') AND x < ix + 200 AND x + 100 > ix)
  SELECT p AS nation, image_name, t AS caption, y AS caption_y FROM d WHERE d < 24 QUALIFY row_number() OVER (PARTITION BY p, image_name ORDER BY d, o) = 1""")
def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    x, y = (F.col("c_custkey") * 37 % 500).cast("double"), (F.col("c_custkey") * 53 % 700).cast("double")
    lined = c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("line_no"), y.alias("y"), x.alias("min_x"), (x + 100).alias("max_x"), F.array(F.struct(F.expr(CAPTION_SQL.replace("'Figure ' || c_custkey", "concat('Figure ', c_custkey)").replace("'table of ' || c_custkey", "concat('table of ', c_custkey)").replace("c_custkey || ' things'", "concat(c_custkey, ' things')")).alias("text"))).alias("runs"))
    images = s.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("image_name"), (F.col("s_suppkey") * 71 % 300).cast("double").alias("x"), (F.col("s_suppkey") * 29 % 600).cast("double").alias("y"), F.lit(200.0).alias("width"), F.lit(80.0).alias("height"))
    stats = images.select("nation", F.lit(12.0).alias("body_size")).distinct()
    return layout.figure_captions(lined, images, stats, ["nation"])


GOOD_SQL = r"regexp_replace(t, '[\x{FFFD}\x00]|[^\x01-\x7F\p{L}\p{N}\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')"


@query(f"SELECT doc_id, length(t) > 0 AND (length(t) - length({GOOD_SQL})) / length(t) > 0.2 AS garbled FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '[aeiou]', chr(65533), 'g') ELSE text END AS t FROM documents WHERE text IS NOT NULL)")
def garbled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", is_garbled(F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", "[aeiou]", "�")).otherwise(F.col("text"))).alias("garbled"))


@query(f"WITH {LINES_SQL} SELECT regexp_replace(line, '[0-9]', '#', 'g') AS text, count(*) AS n FROM lines WHERE line <> '' GROUP BY ALL")
def repeat_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(spark, sf_dir).where("line <> ''")
    return rows.groupBy(normalize_for_repeat(F.col("line")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
