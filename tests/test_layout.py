"""Layout operators on small pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import decode_utf16be, font_style, is_garbled, list_marker, normalize_for_repeat, normalize_whitespace, pdfdoc_decode, text_similarity
from folioflow.operators import layout, tags

SCHEMA = "doc_id string, page_index int, run_index int, text string, font_name string, font_size double, x double, y double, width double, height double, is_bold boolean, is_italic boolean, is_monospaced boolean, rendering_mode int"


def page(spark, *runs, doc="d", index=0):
    rows = []
    for k, r in enumerate(runs):
        text, x, y, size, bold = (*r, *(12.0, False)[len(r) - 3 :])[:5] if len(r) < 5 else r
        rows.append((doc, index, k, text, "Helvetica-Bold" if bold else "Helvetica", float(size), float(x), float(y), len(text) * size * 0.5, float(size), bold, False, False, 0))
    return spark.createDataFrame(rows, SCHEMA)


def numbers(df):
    return [r["line_no"] for r in df.orderBy("run_index").collect()]


@pytest.mark.parametrize(("ys", "expected"), [((700, 700), [1, 1]), ((700, 680), [1, 2]), ((700, 701.5), [1, 1]), ((10, 9, 8.5, 7.9, 6), [1, 1, 1, 2, 2])])
def test_lines_keep_their_anchor(spark, ys, expected):
    assert numbers(layout.group_lines(page(spark, *[("a", 10 * k, y) for k, y in enumerate(ys)]))) == expected


def test_runs_of_a_line_are_ordered_by_x(spark):
    row = layout.lines(page(spark, ("b", 200, 700), ("a", 100, 700.5))).first()
    assert [r["text"] for r in row["runs"]] == ["a", "b"] and row["y"] == 700.5


def test_font_stats(spark):
    s = layout.font_stats(page(spark, *[("t", 72, 700 - 14 * k, 12.0, False) for k in range(4)], ("T", 72, 740, 24.0, True))).first()
    assert (s["body_size"], s["body_font"], s["body_bold"], s["median_spacing"]) == (12.0, "Helvetica", False, 14.0)


def roles(spark, *runs):
    return [(r["role"], r["level"]) for r in layout.blocks(page(spark, *runs)).orderBy("block_no").collect()]


def test_heading_ranks(spark):
    assert roles(spark, ("Chapter", 72, 700, 24.0, True), ("Section", 72, 660, 18.0, False), ("x y", 72, 640, 12.0, False), ("x z", 72, 626, 12.0, False))[:2] == [("Heading", 1), ("Heading", 2)]
    assert all(r == ("Paragraph", None) for r in roles(spark, *[("x y", 72, 700 - 14 * k, 12.0, False) for k in range(3)]))
    sizes = [36, 30, 24, 20, 17, 15]
    got = roles(spark, *[("h h", 72, 780 - 40 * k, float(s), False) for k, s in enumerate(sizes)], *[("b b", 72, 400 - 14 * k, 12.0, False) for k in range(10)])
    assert [level for role, level in got if role == "Heading"] == [1, 2, 3, 4, 5, 6]


def test_bold_line_over_a_gap_is_a_heading(spark):
    assert roles(spark, ("t t", 72, 700, 12.0, False), ("t t", 72, 686, 12.0, False), ("t t", 72, 672, 12.0, False), ("Bold", 72, 640, 12.0, True))[-1] == ("Heading", 1)


def test_lists_and_code(spark):
    assert [r for r, _ in roles(spark, ("1. First", 72, 700, 12.0, False), ("2) Second", 72, 686, 12.0, False), ("body", 72, 672, 12.0, False))] == ["ListItem", "ListItem", "Paragraph"]
    runs = page(spark, ("code()", 72, 700, 12.0, False), ("body one", 72, 686, 12.0, False), ("body two", 72, 672, 12.0, False))
    mono = F.col("run_index") == 0
    runs = runs.withColumn("is_monospaced", mono).withColumn("font_name", F.when(mono, "Courier").otherwise("Helvetica"))
    assert [r["role"] for r in layout.blocks(runs).orderBy("block_no").collect()] == ["Code", "Paragraph", "Paragraph"]


def test_tables(spark):
    rows = [(t, x, y, 12.0, False) for y in (700, 686, 672) for t, x in (("a a", 100), ("b b", 300))]
    t = layout.tables(layout.blocks(page(spark, *rows))).first()
    assert (t["n_rows"], t["n_columns"], list(t["column_xs"])) == (3, 2, [100.0, 300.0])
    off = [(t, x + 20 * k, 700 - 14 * k, 12.0, False) for k in range(3) for t, x in (("a a", 100), ("b b", 300))]
    assert layout.tables(layout.blocks(page(spark, *off))).count() == 0


def test_headers_and_footers(spark):
    pages = page(spark, ("Company Name", 72, 770), ("Page 1", 72, 30)).union(page(spark, ("Company Name", 72, 770), ("Page 2", 72, 30), index=1))
    got = {(r["zone"], r["text"], r["n"]) for r in layout.headers_footers(layout.lines(pages), 792.0).collect()}
    assert got == {("header", "Company Name", 2), ("footer", "Page #", 2)}
    assert layout.headers_footers(layout.lines(page(spark, ("A", 72, 770), ("A", 90, 760))), 792.0).count() == 0


def test_field_labels(spark):
    fields = spark.createDataFrame([("d", 0, "name", 150.0, 494.0, 200.0, 20.0), ("d", 0, "mail", 150.0, 464.0, 200.0, 20.0)], "doc_id string, page_index int, field_name string, x double, y double, width double, height double")
    got = {r["field_name"]: r["label"] for r in layout.field_labels(page(spark, ("Name:", 50, 500), ("Email:", 50, 470), ("far", 50, 100)), fields).collect()}
    assert got == {"name": "Name:", "mail": "Email:"}


def test_figure_captions(spark):
    runs = page(spark, ("Figure 1: A nice chart", 120, 380, 10.0, False), ("text", 72, 700), ("text", 72, 686))
    images = spark.createDataFrame([("d", 0, "im", 100.0, 400.0, 400.0, 180.0)], "doc_id string, page_index int, image_name string, x double, y double, width double, height double")
    lined = layout.lines(runs)
    assert layout.figure_captions(lined, images, layout.font_stats(runs)).first()["caption"] == "Figure 1: A nice chart"


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "marker"), [("1. First", "1."), ("2) Second", "2)"), ("12. Twelfth", "12."), ("a. Item", "a."), ("iv. Item", "iv."), ("(1) Item", "(1)"), ("(a) Item", "(a)"), ("• x", "•"), ("-5", "-"), ("* x", "*"), ("(A) x", "(A)"), ("e.g. x", "e."), ("A. x", None), ("Hello world", None), ("", None)])
def test_list_markers(spark, text, marker):
    assert one(spark, list_marker(F.col("t")), t=text) == marker


@pytest.mark.parametrize(("name", "style"), [("CourierNew,Bold", (True, False, True)), ("Cambria-Italic", (False, True, False)), ("ABCDEF+Helvetica-Bold", (True, False, False)), ("", (False, False, False))])
def test_font_styles(spark, name, style):
    assert tuple(one(spark, font_style(F.col("t")), t=name)) == style


def test_text_functions(spark):
    assert one(spark, normalize_whitespace(F.col("t")), t=" a \n\t b ") == "a b"
    assert one(spark, normalize_for_repeat(F.col("t")), t="Page 12") == "Page ##"
    assert one(spark, is_garbled(F.col("t")), t="���abc") and not one(spark, is_garbled(F.col("t")), t="Hello Wörld") and not one(spark, is_garbled(F.col("t")), t="")
    assert one(spark, text_similarity(F.col("a"), F.col("b")), a="the quick brown fox", b="the quick red fox") == pytest.approx(0.6)
    assert one(spark, decode_utf16be(F.col("b")), b=bytearray("aé😀".encode("utf-16-be") + b"\0")) == "aé😀"
    assert one(spark, decode_utf16be(F.col("b")), b=bytearray(b"\xd8\x00\x00a")) is None
    assert one(spark, pdfdoc_decode(F.col("b")), b=bytearray(b"a\x80\xa0\xe9")) == "a•€é"


def test_blocks_of_a_page_in_python_are_those_of_the_table(spark):
    rnd = random.Random(3)
    texts = ["plain", "• item", "(iv) x", "(\u0130) no", "1. one", "\xa0ix) y", "\x1c- no", "\u3000- yes", "12345) z", "(12345) no", "A. no"]
    fonts = ["Helvetica", "ABC+Arial-BoldMT", "Courier", "abc+Mono", "CourierNew-Bold", ""]
    rows = []
    for page in range(120):
        used, sizes = rnd.sample(fonts, rnd.randint(1, 4)), rnd.choices([8.0, 10.25, 10.2, 12.0, 14.4, 20.0, 1e19, 0.0, -3.0, math.nan, math.inf], k=rnd.randint(1, 4))
        for n in range(rnd.randint(1, 25)):
            y = rnd.choice([700.0 - 14 * rnd.randint(0, 20), 700 - rnd.random() * 60, rnd.choice([math.nan, math.inf, 5.0])])
            rows.append((page // 3, page % 3, n, rnd.choice(texts), rnd.choice(used), rnd.choice(sizes), rnd.choice([72.0, 10.0, 300.0, math.nan]), y))
    names = ["doc_id", "page_index", "run_index", "text", "font_name", "font_size", "x", "y"]
    runs = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(names, ["int", "int", "int", "string", "string", "double", "double", "double"], strict=True)))
    runs = runs.withColumn("width", F.lit(1.0)).withColumn("height", F.lit(1.0)).withColumn("s", font_style(F.col("font_name")))
    runs = runs.select(*names, "width", "height", F.col("s.bold").alias("is_bold"), F.col("s.italic").alias("is_italic"), F.col("s.monospaced").alias("is_monospaced"))
    found = layout.blocks(runs).select("doc_id", "page_index", "block_no", "role", "level", F.col("runs.run_index").alias("o")).collect()
    own: dict = {}
    for r in rows:
        own.setdefault(r[:2], []).append(dict(zip(names, r, strict=True)))
    made = {(*page, k, role, level, tuple(r["run_index"] for r in rs)) for page, own_ in own.items() for k, (role, level, rs) in enumerate(layout.page_blocks(own_), 1)}
    assert {(*r[:5], tuple(r["o"])) for r in found} == made and {m[3] for m in made} == {"Heading", "ListItem", "Code", "Paragraph"}
    trees = spark.createDataFrame([(0, False)], "doc_id int, has_tree boolean")
    elems = sorted((r["doc_id"], r["dfs_ord"], r["struct_type"], r["actual_text"]) for r in tags.auto_tag(layout.blocks(runs), trees).collect())
    assert elems == [(d, n, *e) for d in range(40) for n, e in enumerate(tags.elements_of([own[d, p] for p in range(3)]), 1)]
