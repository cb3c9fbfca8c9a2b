"""Tagging, standards, OCR, graph and source operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import cmyk_to_rgb, exponential, matrix_apply, matrix_concat, sampled, stitching
from folioflow.operators import graph, ocr, signatures, standards, tags
from folioflow.pdf import writer
from folioflow.pdf.syntax import HexText, Name, Ref, Stream
from folioflow.plans.report import structure_report
from folioflow.sources import pdf
from folioflow.streaming import stream_parsed

ELEMS = "doc_id string, dfs_ord int, depth int, struct_type string, role string, level int, alt_text string"


def tree(spark, *rows):
    return spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], ELEMS)


def trees(spark, lang="en", has=True):
    return spark.createDataFrame([("d", has, lang)], "doc_id string, has_tree boolean, tree_lang string")


def passed(spark, elems, facts):
    return {r["id"]: (r["passed"], r["details"]) for r in tags.validate_ua(elems, facts).collect()}


def head(level):
    return (1, f"H{level}", "H", level, None)


def test_sound_tree_passes(spark):
    e = tree(spark, head(1), head(2), (1, "Figure", "Figure", None, "alt"), (1, "Table", "Table", None, None), (2, "TR", "TR", None, None), (3, "TH", "TH", None, None), (1, "FENote", "FENote", None, None))
    got = passed(spark, e, trees(spark))
    assert len(got) == 6 and all(ok for ok, _ in got.values())
    assert tags.report(tags.validate_ua(e, trees(spark))).first()["compliant"]


def test_faulty_tree(spark):
    e = tree(spark, head(1), head(3), (1, "Figure", "Figure", None, None), (1, "Table", "Table", None, None), (2, "TD", "TD", None, None), (1, "TH", "TH", None, None), (1, "Note", "Note", None, None))
    got = passed(spark, e, trees(spark, None))
    assert [k for k, (ok, _) in got.items() if ok] == ["tagged-pdf"] and got["heading-order"][1] == ["H3 follows H1 (skips level 2)"] and len(got["figure-alt-text"][1]) == 1


def test_running_maximum_and_neighbours_differ(spark):
    e = tree(spark, head(1), head(2), head(1), head(3))
    assert tags.heading_skips(e).count() == 0 and [(r["previous"], r["level"]) for r in tags.adjacent_skips(e).collect()] == [(1, 3)]


def test_issues(spark):
    blocks = spark.createDataFrame([("d", 0, "Heading"), ("d", 1, "Heading")], "doc_id string, page_index int, role string")
    e = tree(spark, (1, "P", "P", None, None), (1, "Figure", "Figure", None, None))
    got = sorted(r["description"] for r in tags.tag_issues(trees(spark, None), e, blocks).collect())
    assert got == ["1 Figure element(s) missing alt text", "Detected 1 headings but structure tree has none", "No /Lang attribute on structure tree"]
    assert [r["severity"] for r in tags.tag_issues(trees(spark, None, False), e, blocks).collect()] == ["error"]


def test_ocr_paragraphs_and_headings(spark):
    words = spark.createDataFrame([("p", k, t, x, y, 50, h) for k, (t, x, y, h) in enumerate([("Chapter", 0, 100, 60), ("One", 60, 100, 60), ("This", 0, 300, 20), ("is", 60, 300, 20), ("body", 90, 300, 20), ("text.", 130, 300, 20)])], "page string, word_index int, text string, x int, y int, width int, height int")
    got = [(r["text"], r["level"]) for r in tags.ocr_structure(words, ["page"]).orderBy("paragraph").collect()]
    assert got == [("Chapter One", 1), ("This is body text.", None)]


def test_standards(spark):
    b = writer.Builder()
    b.page(Group={"S": Name("Transparency")})
    b.catalog["OutputIntents"] = [{"S": Name("GTS_PDFX")}]
    b.catalog["Metadata"] = b.add(Stream({}, b'<x xmlns:p="q"><pdfaid:part>1</pdfaid:part></x>'))
    b.catalog["OpenAction"] = {"S": Name("JavaScript")}
    b.add(Stream({"Filter": Name("LZWDecode")}, b""))
    files = spark.createDataFrame([("d", bytearray(b.to_bytes()))], "doc_id string, content binary")
    f = pdf.parse(files, ["features"]).select("doc_id", "features.*")
    got = {r["id"]: r["passed"] for r in standards.validate(f, "A1b").union(standards.validate(f, "X1a")).collect()}
    assert got == {"no-encryption": True, "fonts-embedded": True, "xmp-metadata": True, "no-lzw-filters": False, "no-javascript": False, "metadata-consistency": True, "color-spaces": True, "no-transparency": False, "output-intent-pdfx": True, "trim-or-art-box": False}
    with pytest.raises(ValueError):
        standards.checks_of("Z9")


@pytest.mark.parametrize(("stream", "seen", "source"), [("Hello World", "Hello  World", "ContentStream"), ("", "x", "Ocr"), ("x", " ", "ContentStream"), ("", "", "Neither"), ("�����", "Hello World", "Ocr"), ("one two", "three four", "Both")])
def test_text_sources(spark, stream, seen, source):
    r = ocr.compare_sources(spark.createDataFrame([(stream, seen)], "stream_text string, ocr_text string")).first()
    assert r["source"] == source and (source != "Both" or r["accessible_text"] == "OCR reading: three four. Original text: one two.")


def test_tsv_and_json(spark):
    tsv = "level\tpage\n5\t1\t1\t1\t1\t1\t100\t200\t150\t30\t95.5\tHello\n4\t1\t1\t1\t1\t1\t1\t1\t1\t1\t90\tx\n5\t1\t1\t1\t1\t1\t1\t1\t1\t1\t-1\ty\n5\tshort"
    r = ocr.parse_tsv(spark.createDataFrame([(1, tsv)], "p int, tsv string")).collect()
    assert [(x["text"], x["x"], x["width"], x["confidence"]) for x in r] == [("Hello", 100, 150, 0.955)]
    j = ocr.parse_windows_words(spark.createDataFrame([(1, '{"words": [{"text": "a", "x": 1, "y": 2, "width": 3, "height": 4}]}')], "p int, json string")).first()
    assert (j["text"], j["height"]) == ("a", 4)


def test_rasters(spark):
    two = np.array([[0] * 50 + [255] * 50], np.uint8)
    assert 0 <= ocr.otsu_of(two) < 255 and set(ocr.preprocess(np.arange(100, 150, dtype=np.uint8)[None]).ravel()) == {0, 255}
    assert ocr.rotate(np.array([[1, 2], [3, 4]]), 90).ravel().tolist() == [3, 1, 4, 2]
    assert ocr.to_gray(np.array([[[0, 0, 0, 0], [255, 255, 255, 255], [0, 0, 0, 255]]], np.uint8)).tolist() == [[255, 255, 0]]
    values = np.random.default_rng(1).integers(0, 256, 500)
    px = spark.createDataFrame([("i", int(v)) for v in values], "i string, v int")
    assert ocr.otsu(px, ["i"]).first()["threshold"] == ocr.otsu_of(values)


def test_reading_order(spark):
    make = lambda *w: spark.createDataFrame([("p", k, *x) for k, x in enumerate(w)], "page string, word_index int, text string, x int, y int, width int, height int")
    got = ocr.reading_order(make(("C", 120, 100, 20, 20), ("A", 50, 100, 20, 20), ("B", 92, 100, 20, 20), ("D", 50, 130, 20, 20)), ["page"]).orderBy("region", "position").collect()
    assert [r["text"] for r in got] == ["A", "B", "C", "D"]
    got = ocr.reading_order(make(("R", 450, 10, 50, 20), ("L", 50, 10, 50, 20), ("r", 450, 40, 50, 20), ("l", 50, 40, 50, 20)), ["page"]).orderBy("region", "position").collect()
    assert [(r["region"], r["text"]) for r in got] == [(0, "L"), (0, "l"), (1, "R"), (1, "r")]
    words = ocr.recognize(spark.createDataFrame([("p", 2, 1, bytearray(b"\x00\xff"))], "page string, width int, height int, pixels binary"), lambda a: [(f"{a.shape}", 1, 2, 3, 4, 0.5)], ["page"])
    assert words.first()["text"] == "(1, 2)"


def test_functions(spark):
    row = spark.range(1).select(
        cmyk_to_rgb(*[F.lit(v) for v in (0.0, 0.5, 1.0, 0.5)]).alias("c"), matrix_apply(matrix_concat([F.lit(float(v)) for v in (2, 0, 0, 2, 1, 1)], [F.lit(float(v)) for v in (1, 0, 0, 1, 5, 5)]), F.lit(1.0), F.lit(1.0)).alias("m"),
        exponential(F.lit(0.5), 0, 1, 2).alias("e"), sampled(F.lit(0.25), [0.0, 1.0, 0.0]).alias("s"), stitching(F.lit(0.75), [lambda x: x, lambda x: x * 10], [0.5], [(0, 1), (0, 1)]).alias("t"),
    ).first()
    assert (row["c"]["r"], row["c"]["g"], row["c"]["b"]) == (0.5, 0.25, 0.0) and (row["m"]["x"], row["m"]["y"]) == (8, 8) and (row["e"], row["s"], row["t"]) == (0.25, 0.5, 5.0)


def test_signed_ranges(spark):
    df = spark.createDataFrame([(bytearray(b"abcdefgh"),)], "raw binary")
    lit = F.lit
    assert bytes(df.select(signatures.signed_bytes(F.col("raw"), lit(0), lit(2), lit(6), lit(2)).alias("s")).first()["s"]) == b"abgh"
    assert df.select(signatures.signed_bytes(F.col("raw"), lit(0), lit(7), lit(6), lit(2)).alias("s")).first()["s"] is None


def test_trees_and_merges(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0, "a"), (1, 2, 1, 0, "b"), (1, 3, 2, 1, "c"), (1, 9, 9, 0, "loop")], "doc_id int, id int, parent int, ord int, name string")
    assert sorted(r["name"] for r in graph.flatten(nodes).collect()) == ["a", "a.b", "a.b.c"]
    m = graph.renumber(spark.createDataFrame([(0, 1, [2]), (0, 2, []), (1, 1, [1])], "part int, num int, refs array<int>"))
    assert {(r["part"], r["new_num"], tuple(r["refs"])) for r in m.collect()} == {(0, 1, (2,)), (0, 2, ()), (1, 3, (3,))}


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [("a", "Title line\nbody one\nbody two"), ("b", "x"), ("c", None)]
    pdf.save_files(pdf.text_documents(spark.createDataFrame(rows, "doc_id string, text string")), str(tmp_path / "in"))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "in" / "no.pdf").write_bytes(b"no")
    return tmp_path


def test_files_with_faults_are_rows(spark, folder):
    parsed = pdf.parse(pdf.read_files(spark, str(folder / "in")), list(pdf.OUTPUTS))
    assert parsed.count() == 5 and {r["kind"] for r in pdf.parse_errors(parsed).collect()} == {"Xref", "Header"}
    assert sorted(r["text"] for r in pdf.document_text(parsed).collect()) == ["", "Title line\nbody one\nbody two", "x"]
    assert pdf.text_runs(parsed).count() == 4 and pdf.struct_elements(parsed)[1].count() == 5


def test_report(spark, folder):
    rows = structure_report(pdf.read_files(spark, str(folder / "in"))).collect()
    assert len(rows) == 3 and sum(r["paragraphs"] for r in rows) == 4 and not any(r["tagged"] for r in rows)


def test_stream(spark, folder):
    q = stream_parsed(spark, str(folder / "in"), ["pages"]).select("doc_id", "page_count").writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("parsed").count() == 5


def test_signatures_images_and_annotations(spark):
    b = writer.Builder()
    image = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"\x07"))
    page = b.page(b"BI /W 1 /H 1 /BPC 8 /CS /G ID \x01 EI", Annots=[{"Subtype": Name("Link"), "Rect": [0, 0, 1, 1], "A": {"URI": writer.text_object("u")}}, {"Subtype": Name("Text")}])
    b.objects[page]["Resources"]["XObject"] = {"Im": image}
    sig = b.add({"SubFilter": Name("adbe.pkcs7.detached"), "ByteRange": [0, 1, 2, 3], "Contents": HexText(b"0\x01"), "Reason": writer.text_object("r")})
    b.catalog["AcroForm"] = {"Fields": [b.add({"T": writer.text_object("s"), "FT": Name("Sig"), "V": sig})]}
    parsed = pdf.parse(spark.createDataFrame([(1, bytearray(b.to_bytes()))], "doc_id int, content binary"), ["signatures", "images", "annotations"])
    assert [(r["name"], bytes(r["data"])) for r in pdf.unnest(parsed, "images").collect()] == [("Im", b"\x07"), ("Inline0", b"\x01")]
    assert pdf.unnest(parsed, "signatures").first()["reason"] == "r" and [r["uri"] for r in pdf.unnest(parsed, "annotations").collect()] == ["u"]
    assert Ref(1, 0) in b.objects


def test_flatten_of_odd_trees(spark):
    from folioflow.operators import graph

    chain = [(2, k, k - 1 if k else None, 7, f"d{k}") for k in range(40)]
    rows = [(1, 1, None, 0, "a"), (1, 2, 1, 1, "b"), (1, 3, 2, 0, None), (1, 4, 99, 0, "lost"), (1, 5, 6, 0, "c"), (1, 6, 5, 0, "c"), (1, 7, 7, 0, "self"), *chain]
    got = {(r["doc_id"], r["id"]): (r["name"], r["path"], r["depth"]) for r in graph.flatten(spark.createDataFrame(rows, "doc_id long, id long, parent long, ord int, name string")).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): ("a", [0], 1), (1, 2): ("a.b", [0, 1], 2), (1, 3): (None, [0, 1, 0], 3)}
    assert sorted(i for d, i in got if d == 2) == list(range(32)) and got[2, 31][2] == 32
    few = graph.flatten(spark.createDataFrame(rows, "doc_id long, id long, parent long, ord int, name string"), 3)
    assert {r["depth"] for r in few.collect()} == {1, 2, 3}


def test_flatten_of_more_than_a_million_nodes(spark):
    from pyspark.sql import functions as F

    from folioflow.operators import graph

    nodes = spark.range(1, 1_100_001).select(F.lit(1).alias("doc_id"), "id", F.when(F.col("id") >= 10, F.floor(F.col("id") / 10)).alias("parent"), (F.col("id") % 10).cast("int").alias("ord"), F.lit("n").alias("name"))
    got = {r["depth"]: r["count"] for r in graph.flatten(nodes, 8).groupBy("depth").count().collect()}
    assert got == {1: 9, 2: 90, 3: 900, 4: 9000, 5: 90000, 6: 900000, 7: 100001}


def test_renumber_over_blocks(spark, monkeypatch):
    from folioflow.operators import graph

    monkeypatch.setattr(graph, "BLOCK", 3)
    rows = [(p, n, [n]) for p in range(10) for n in range(1, p + 2)]
    got = {(r["part"], r["num"]): (r["new_num"], r["refs"]) for r in graph.renumber(spark.createDataFrame(rows, "part int, num long, refs array<long>")).collect()}
    shift = {p: sum(q + 1 for q in range(p)) for p in range(10)}
    assert got == {(p, n): (n + shift[p], [n + shift[p]]) for p, n, _ in rows}
