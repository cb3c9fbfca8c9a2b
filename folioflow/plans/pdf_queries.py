"""Round trips: the driver's rows are written as PDF files, parsed again, and held against SQL on the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.pdf import writer
from folioflow.pdf.document import Document
from folioflow.pdf.syntax import Name, Text
from folioflow.plans import query, table
from folioflow.plans.layout_queries import LINES_SQL
from folioflow.plans.report import structure_report
from folioflow.sources import pdf

#: A page's text: blank lines collapse, and white space at both ends goes.
PAGE_TEXT_SQL = r"regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\n+', chr(10), 'g'), '^[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+|[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+$', '', 'g')"
PAGES_SQL = f"{LINES_SQL}, pages AS (SELECT doc_id, i // 46 AS page, {PAGE_TEXT_SQL} AS text FROM lines GROUP BY ALL)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.text_documents(table(spark, sf_dir, "documents").where("text is not null"))


@query(f"WITH {PAGES_SQL} SELECT doc_id, string_agg(text, chr(12) ORDER BY page) AS text FROM pages GROUP BY doc_id")
def pdf_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.document_text(pdf.parse(_files(spark, sf_dir), ["pages"]))


@query(f"WITH {PAGES_SQL} SELECT doc_id, CAST(count(*) AS INT) AS page_count, '1.7' AS version FROM pages GROUP BY doc_id")
def pdf_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.parse(_files(spark, sf_dir), []).select("doc_id", "page_count", "version")


@query(f"""WITH {LINES_SQL} SELECT doc_id, CAST(i // 46 AS INT) AS page_index, CAST(row_number() OVER (PARTITION BY doc_id, i // 46 ORDER BY i) - 1 AS INT) AS run_index, line AS text,
  CAST(72 AS DOUBLE) AS x, CAST(720 - 14 * (i % 46) AS DOUBLE) AS y, CAST(12 AS DOUBLE) AS font_size, CAST(length(line) * 6 AS DOUBLE) AS width, 'Helvetica' AS font_name FROM lines WHERE line <> ''""")
def pdf_runs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.text_runs(pdf.parse(_files(spark, sf_dir), ["runs"])).select("doc_id", "page_index", "run_index", "text", "x", "y", "font_size", "width", "font_name")


@query(rf"""WITH {PAGES_SQL}, r AS (SELECT doc_id, i // 46 AS page, ltrim(line) AS t FROM lines WHERE line <> ''),
  k AS (SELECT doc_id, page, regexp_matches(t, '^[•‣●○■▪–—*-]') OR regexp_matches(t, '^\((?:[0-9]{{1,4}}|[A-Za-z]|(?i:i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii))\)')
    OR regexp_matches(t, '^(?:[0-9]+|[a-z]|i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)[.):]') AS item FROM r),
  c AS (SELECT doc_id, count(*) FILTER (page = 0) AS blocks, count(*) FILTER (page = 0 AND NOT item) AS paragraphs, count(*) FILTER (page = 0 AND item) AS list_items, count(*) AS tags_made FROM k GROUP BY doc_id)
  SELECT p.doc_id, CAST(count(*) AS INT) AS page_count, CAST(coalesce(sum(strlen(text)) FILTER (page < 3), 0) AS BIGINT) AS text_bytes, false AS tagged, coalesce(any_value(blocks), 0) AS blocks, CAST(0 AS BIGINT) AS headings,
    coalesce(any_value(paragraphs), 0) AS paragraphs, coalesce(any_value(list_items), 0) AS list_items, CAST(0 AS BIGINT) AS code_blocks, coalesce(any_value(tags_made), 0) AS tags_made
  FROM pages p LEFT JOIN c ON c.doc_id = p.doc_id GROUP BY p.doc_id""")
def pdf_structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_report(_files(spark, sf_dir))


def _with_metadata(row: dict) -> bytes:
    b = writer.Builder()
    b.page()
    b.metadata(Title=f"Document {row['doc_id']}", Author=row["source"] or "", Subject=row["lang"] or "", CreationDate="D:20240101000000Z")
    return b.to_bytes()


@query("SELECT doc_id, 'Document ' || doc_id AS title, coalesce(source, '') AS author, coalesce(lang, '') AS subject, 'D:20240101000000Z' AS creation_date FROM documents")
def pdf_metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pdf.built(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), _with_metadata)
    return pdf.parse(files, ["metadata"]).select("doc_id", "metadata.title", "metadata.author", "metadata.subject", "metadata.creation_date")


def _with_notes(row: dict) -> bytes:
    b = writer.Builder()
    notes = [{"Subtype": Name("Link"), "Rect": [x, 10, x + 50, 20], "A": {"S": Name("URI"), "URI": Text(f"http://host/{x}".encode())}, "F": x % 8} for x in row["keys"]] + [{"Subtype": Name("Text"), "Contents": writer.text_object("nöte")}]
    b.page(Annots=notes)
    return b.to_bytes()


@query("SELECT s_nationkey AS doc_id, CAST(s_suppkey AS DOUBLE) AS x, 'http://host/' || s_suppkey AS uri, s_suppkey & 2 > 0 AS hidden, s_suppkey & 4 > 0 AS printable FROM supplier")
def pdf_annotations_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("keys"))
    notes = pdf.unnest(pdf.parse(pdf.built(keys, _with_notes), ["annotations"]), "annotations")
    return notes.select("doc_id", F.col("rect")[0].alias("x"), "uri", (F.getbit("flags", F.lit(1)) == 1).alias("hidden"), (F.getbit("flags", F.lit(2)) == 1).alias("printable"))


def _with_fields(row: dict) -> bytes:
    b = writer.Builder()
    b.page()
    b.fields([(f"n{row['doc_id']}", None, [(f"s{k}", name, []) for k, name in zip(row["keys"], row["names"], strict=True)])])
    b.set_field(f"n{row['doc_id']}.s{row['keys'][0]}", "changed")
    return b.to_bytes()


@query("SELECT s_nationkey AS doc_id, 'n' || s_nationkey || '.s' || s_suppkey AS name, CASE WHEN s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) THEN 'changed' ELSE s_name END AS value, 'Tx' AS field_type FROM supplier")
def pdf_forms_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("p"))
    files = pdf.built(pairs.select("doc_id", F.col("p.s_suppkey").alias("keys"), F.col("p.s_name").alias("names")), _with_fields)
    return pdf.unnest(pdf.parse(files, ["fields"]), "fields").select("doc_id", "name", "value", "field_type")


def _with_outline(row: dict) -> bytes:
    b = writer.Builder()
    b.page()
    b.outline([(n["name"], 0, [(s, 0, []) for s in n["suppliers"]]) for n in row["nations"]])
    return b.to_bytes()


@query("""WITH n AS (SELECT n_regionkey AS doc_id, trim(n_name) AS title, n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS k FROM nation),
  s AS (SELECT n.doc_id, trim(s_name) AS title, k, CAST(row_number() OVER (PARTITION BY n.n_nationkey ORDER BY s_name) - 1 AS INT) AS j FROM supplier JOIN n ON s_nationkey = n_nationkey)
  SELECT doc_id, 1 AS depth, title, CAST(k AS VARCHAR) AS path, 0 AS page FROM n UNION ALL SELECT doc_id, 2, title, k || '.' || j, 0 FROM s""")
def pdf_outlines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.trim("s_name"))).alias("suppliers"))
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    one = F.struct("n_nationkey", F.trim("n_name").alias("name"), F.coalesce("suppliers", F.array().cast("array<string>")).alias("suppliers"))
    rows = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.sort_array(F.collect_list(one)).alias("nations"))
    out = pdf.unnest(pdf.parse(pdf.built(rows, _with_outline), ["outlines"]), "outlines")
    return out.select("doc_id", "depth", "title", F.array_join("path", ".").alias("path"), "page")


def _edited(row: dict) -> bytes:
    """Two documents merged, the pages turned round, one rotated, one removed; encrypted for odd ids."""
    a, b = (writer.text_document(t) for t in (row["text"] or "", "second\ndocument"))
    out = writer.Builder(Document(a))
    out.merge(Document(b))
    n = out.page_root["Count"]
    out.reorder_pages(list(range(n))[::-1])
    out.rotate_page(0, 90)
    if n > 2:
        out.remove_page(1)
    return out.to_encrypted("", aes=row["doc_id"] % 4 == 1) if row["doc_id"] % 2 else out.to_incremental(a) if row["doc_id"] % 4 == 0 else out.to_linearized()


@query(f"""WITH {PAGES_SQL}, n AS (SELECT doc_id, count(*) AS n FROM pages GROUP BY doc_id)
  SELECT doc_id, CAST(CASE WHEN n + 1 > 2 THEN n ELSE n + 1 END AS INT) AS page_count, 'second' || chr(10) || 'document' AS first_text, 90 AS rotate, p.text AS last_text FROM n JOIN pages p USING (doc_id) WHERE p.page = 0""")
def pdf_edits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pdf.built(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), _edited)
    out = pdf.parse(files, ["pages"])
    return out.select("doc_id", "page_count", F.col("pages")[0]["text"].alias("first_text"), F.col("pages")[0]["rotate"].alias("rotate"), F.element_at("pages", -1)["text"].alias("last_text"))




@query(rf"""WITH {LINES_SQL}, r AS (SELECT doc_id, ltrim(line) AS t FROM lines WHERE line <> '')
  SELECT doc_id, count(*) + 1 AS elements, count(*) FILTER (regexp_matches(t, '^[•‣●○■▪–—*-]') OR regexp_matches(t, '^\((?:[0-9]{{1,4}}|[A-Za-z]|(?i:i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii))\)')
    OR regexp_matches(t, '^(?:[0-9]+|[a-z]|i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)[.):]')) AS items, CAST(sum(strlen(t)) AS BIGINT) > 0 AS has_text, 'en-US' AS lang FROM r GROUP BY doc_id""")
def pdf_auto_tag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.sources import raster

    parsed = pdf.parse(raster.auto_tagged(_files(spark, sf_dir)), ["tree"])
    elems = F.col("tree.elements")
    size = F.aggregate(elems, F.lit(0).cast("long"), lambda a, e: a + F.coalesce(F.octet_length(e["actual_text"]), F.lit(0)))
    items = F.size(F.filter(elems, lambda e: e["struct_type"] == "LI"))
    return parsed.where(F.size(elems) > 0).select("doc_id", F.size(elems).cast("long").alias("elements"), items.cast("long").alias("items"), (size > 0).alias("has_text"), F.col("tree.lang").alias("lang"))


@query("""SELECT doc_id, standard, CASE standard WHEN 'A1b' THEN 8 WHEN 'A2b' THEN 7 ELSE 4 END AS total, false AS compliant,
    CASE WHEN standard = 'X4' THEN 1 ELSE 4 + CAST(standard = 'A1b' AS INT) + CAST(doc_id % 2 = 1 AS INT) + CAST(doc_id % 3 > 0 AS INT) END AS passed_count
  FROM (SELECT doc_id, unnest(['A1b', 'A2b', 'X4']) AS standard FROM documents)""")
def pdf_standards_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with unembedded fonts and no intent; odd ids have XMP data, those not divisible by 3 no script."""
    from folioflow.operators import standards

    def make(row: dict) -> bytes:
        from folioflow.pdf.syntax import Stream

        b = writer.Builder()
        b.page(writer.Content().text("F1", 12, 72, 720, b"x").bytes(), {"F1": b.font()})
        if row["doc_id"] % 2:
            b.catalog["Metadata"] = b.add(Stream({}, b"<pdfaid:part>1</pdfaid:part>"))
        if row["doc_id"] % 3 == 0:
            b.catalog["OpenAction"] = {"S": Name("JavaScript")}
        return b.to_bytes()

    features = pdf.parse(pdf.built(table(spark, sf_dir, "documents").select("doc_id"), make), ["features"]).select("doc_id", "features.*")
    checks = standards.report(features, ["A1b", "A2b", "X4"])
    return checks.select("doc_id", "standard", F.col("total").cast("int").alias("total"), "compliant", F.col("passed_count").cast("int").alias("passed_count"))
