"""Structure trees: accessibility checks, tag quality, and tags made from blocks or from OCR words.

Structure elements are rows: doc_id, dfs_ord (place in preorder), parent_ord, depth, struct_type, role, level, title, lang, alt_text,
actual_text. Tree facts are rows too: doc_id, has_tree, tree_lang. Each check gives (doc_id, id, description, passed, details).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import block_standard_role, standard_role_of
from folioflow.operators import layout

# Fixed values
BLOCK_ROLES = ["Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "P", "H", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot"]
INLINE_ROLES = ["Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Ruby", "Warichu"]
DESCRIPTIONS = {
    "tagged-pdf": "Document must be tagged (have a structure tree)",
    "document-language": "Document must specify a language",
    "figure-alt-text": "Figures must have alternate text",
    "heading-order": "Headings must be properly nested without skipping levels",
    "table-headers": "Tables must contain header cells (TH)",
    "pdfua2-fenote": "Notes must use FENote instead of Note",
}


def is_block(role: Column) -> Column:
    return role.isin(*BLOCK_ROLES) | role.rlike("^H[1-6]$")


def is_inline(role: Column) -> Column:
    return role.isin(*INLINE_ROLES)


def _check(df: DataFrame, name: str, details: Column) -> DataFrame:
    out = df.select("doc_id", F.lit(name).alias("id"), F.lit(DESCRIPTIONS[name]).alias("description"), details.alias("details"))
    return out.select("doc_id", "id", "description", (F.size("details") == 0).alias("passed"), "details")


def _listed(rows: DataFrame, docs: DataFrame, name: str, order: str, text: Column) -> DataFrame:
    """A check whose details are texts of rows in order; documents without any pass."""
    found = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("f"))
    return _check(docs.select("doc_id").join(found, "doc_id", "left"), name, F.coalesce(F.col("f.t"), F.array().cast("array<string>")))


def figures_without_alt(elems: DataFrame) -> DataFrame:
    return elems.where("role = 'Figure' and alt_text is null")


def heading_skips(elems: DataFrame) -> DataFrame:
    """Headings more than one level below the deepest before them in their document: dfs_ord, level and that maximum."""
    before = Window.partitionBy("doc_id").orderBy("dfs_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = elems.where("role = 'H' and level > 0").withColumn("seen", F.max("level").over(before))
    return rows.where("level > seen + 1").select("doc_id", "dfs_ord", "level", "seen")


def adjacent_skips(elems: DataFrame) -> DataFrame:
    """Headings more than one level below the heading right before them."""
    rows = elems.where("role = 'H' and level > 0").withColumn("previous", F.lag("level").over(Window.partitionBy("doc_id").orderBy("dfs_ord")))
    return rows.where("level > previous + 1").select("doc_id", "dfs_ord", "level", "previous")


def tables_without_headers(elems: DataFrame) -> DataFrame:
    """Table elements with no TH below them, numbered in preorder.

    The next TH after a table is below it if all rows from the table up to that TH are deeper than the table; if that one isn't, no later one
    is. So rows are cut in stretches that end with a TH, and each table looks at what is left of its own.
    """
    order = Window.partitionBy("doc_id").orderBy("dfs_ord")
    head = (F.col("role") == "TH").cast("int")
    rows = elems.select("doc_id", "dfs_ord", "depth", "role").withColumn("stretch", F.coalesce(F.sum(head).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("doc_id", "stretch")
    rows = rows.withColumn("ends", F.max(head).over(own) == 1).withColumn("least", F.min("depth").over(own.orderBy("dfs_ord").rowsBetween(1, Window.unboundedFollowing)))
    tables_ = rows.where("role = 'Table'").withColumn("i", F.row_number().over(order))
    return tables_.where("not (ends and coalesce(least > depth, false))").select("doc_id", "dfs_ord", "i")


def validate_ua(elems: DataFrame, trees: DataFrame) -> DataFrame:
    """The six checks of a document's structure tree."""
    size = elems.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    docs = trees.join(size, "doc_id", "left")
    none = F.array().cast("array<string>")
    tagged = _check(docs, "tagged-pdf", F.when(F.coalesce("n", F.lit(0)) > 0, none).otherwise(F.array(F.lit("Structure tree is empty"))))
    lang = _check(docs, "document-language", F.when(F.col("tree_lang").isNotNull(), none).otherwise(F.array(F.lit("No language on the structure tree"))))
    figures = figures_without_alt(elems).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("dfs_ord")))
    notes = elems.where("role = 'Note'")
    return (
        tagged.unionByName(lang)
        .unionByName(_listed(figures, trees, "figure-alt-text", "dfs_ord", F.concat(F.lit("Figure #"), F.col("i").cast("string"), F.lit(" has no alternate text"))))
        .unionByName(_listed(heading_skips(elems), trees, "heading-order", "dfs_ord", F.format_string("H%d follows H%d (skips level %d)", F.col("level"), F.col("seen"), F.col("seen") + 1)))
        .unionByName(_listed(tables_without_headers(elems), trees, "table-headers", "dfs_ord", F.concat(F.lit("Table #"), F.col("i").cast("string"), F.lit(" has no header cells"))))
        .unionByName(_listed(notes, trees, "pdfua2-fenote", "dfs_ord", F.concat(F.lit("Element #"), (F.col("dfs_ord") + 1).cast("string"), F.lit(" is a Note"))))
    )


def report(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether all checks of a document pass, and how many of how many do."""
    return checks.groupBy(*(by or ["doc_id"])).agg(F.bool_and("passed").alias("compliant"), F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed_count"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("id")))).alias("failures"))


def tag_issues(trees: DataFrame, elems: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, description, severity of the issues of a document, each once. An untagged document has that one issue only."""
    untagged = trees.where("not has_tree").select("doc_id", F.lit("Document has no structure tree (untagged)").alias("description"), F.lit("error").alias("severity"))
    tagged = trees.where("has_tree")
    no_lang = tagged.where("tree_lang is null").select("doc_id", F.lit("No /Lang attribute on structure tree").alias("description"), F.lit("error").alias("severity"))
    has_heads = elems.where(F.col("struct_type").rlike("^H[0-9]$")).select("doc_id").distinct()
    found = blocks.where("role = 'Heading'").groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))
    heads = tagged.join(found, "doc_id").join(has_heads, "doc_id", "left_anti").select("doc_id", F.format_string("Detected %d headings but structure tree has none", F.col("n")).alias("description"), F.lit("warning").alias("severity"))
    own = elems.join(tagged.select("doc_id"), "doc_id", "left_semi")
    alts = own.where("struct_type = 'Figure' and alt_text is null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    alts = alts.select("doc_id", F.format_string("%d Figure element(s) missing alt text", F.col("n")).alias("description"), F.lit("error").alias("severity"))
    raw = own.withColumn("level", F.when(F.col("struct_type").rlike("^H[0-9]$"), F.substring("struct_type", 2, 1).cast("int"))).withColumn("role", F.when(F.col("level").isNotNull(), "H"))
    skips = adjacent_skips(raw).select("doc_id", F.format_string("Heading level skip: H%d followed by H%d", F.col("previous"), F.col("level")).alias("description"), F.lit("warning").alias("severity"))
    return untagged.unionByName(no_lang).unionByName(heads).unionByName(alts).unionByName(skips).dropDuplicates(["doc_id", "description"])


def auto_tag(blocks: DataFrame, trees: DataFrame) -> DataFrame:
    """Structure elements for documents without a tree: one for each block, in page order."""
    text = F.array_join(F.transform("runs", lambda r: r["text"]), " ")
    free = blocks.join(trees.where("has_tree").select("doc_id"), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy("page_index", "block_no")
    kind = F.when(F.col("role") == "Code", "Code").otherwise(F.coalesce(block_standard_role(F.col("role"), F.col("level")), F.lit("P")))
    return free.select("doc_id", F.row_number().over(order).alias("dfs_ord"), F.lit(0).alias("parent_ord"), F.lit(1).alias("depth"), kind.alias("struct_type"), text.alias("actual_text"))


def elements_of(pages: list[list[dict]]) -> list[tuple[str, str]]:
    """(type, text) of the elements that auto_tag makes of one document, from the runs of its pages."""
    return [("Code" if role == "Code" else standard_role_of(role, level) or "P", " ".join(r["text"] for r in rs)) for runs in pages for role, level, rs in layout.page_blocks(runs)]


def ocr_paragraphs(words: DataFrame, page: list[str], gap: int = 30) -> DataFrame:
    """words (page, word_index, text, x, y, width, height) with the number of each one's paragraph: a new one starts more than gap below the last word."""
    w = Window.partitionBy(*page).orderBy("word_index")
    bottom = F.lag(F.col("y") + F.col("height")).over(w)
    starts = bottom.isNull() | (F.greatest(F.col("y") - bottom, F.lit(0)) > gap)
    return words.withColumn("__s", starts.cast("int")).withColumn("paragraph", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def ocr_structure(words: DataFrame, page: list[str], gap: int = 30) -> DataFrame:
    """Paragraphs of OCR words with their median height, and the heading level of those higher than 1.4 times the page's median."""
    mid = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int"))
    whole = words.groupBy(*page).agg(mid("height").alias("body"))
    para = ocr_paragraphs(words, page, gap).groupBy(*page, "paragraph").agg(mid("height").alias("height"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda s: s["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words"))
    rows = para.join(whole, page).withColumn("heading", F.col("height") > F.floor(F.col("body") * 1.4))
    rank = F.dense_rank().over(Window.partitionBy(*page).orderBy(F.when(F.col("heading"), F.col("height")).desc_nulls_last()))
    return rows.select(*page, "paragraph", "text", "n_words", "height", F.when(F.col("heading"), F.least(rank, F.lit(6))).alias("level"))
