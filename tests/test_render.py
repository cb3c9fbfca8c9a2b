"""Rasters, colours, images, text layers and tagging of files."""

import zlib

import numpy as np
import pytest

from folioflow.operators import ocr
from folioflow.pdf import colors, images, ocr_layer, writer
from folioflow.pdf.document import Document
from folioflow.pdf.render import coverage, render_page
from folioflow.pdf.syntax import Name, PdfError, Stream, Text
from folioflow.sources import pdf, raster

same = lambda v: v


def drawn(data: bytes, size=20, resources=None, **page):
    b = writer.Builder()
    ref = b.page(data, width=size, height=size, **page)
    b.objects[ref]["Resources"] |= {k: {n: b.add(v) for n, v in d.items()} for k, d in (resources or {}).items()}
    d = Document(b.to_bytes())
    return render_page(d, d.pages()[0])


def test_paths():
    assert (drawn(b"") == 255).all()
    px = drawn(b"1 0 0 rg 0 0 10 10 re f")
    assert (px[10:, :10, :3] == [255, 0, 0]).all() and (px[:10] == 255).all()
    assert (drawn(b"0 0 20 20 re 5 5 10 10 re f*")[10, 10] == 255).all() and (drawn(b"0 0 20 20 re 5 5 10 10 re f")[10, 10, :3] == 0).all()
    assert (drawn(b"4 w 0 10 m 20 10 l S")[8:12, 2:18, :3] == 0).all()
    assert coverage([[(0.5, 0), (1.5, 0), (1.5, 1), (0.5, 1)]], 2, 1).tolist() == [[0.5, 0.5]]
    circle = drawn(b"20 10 m 20 15.5 15.5 20 10 20 c 4.5 20 0 15.5 0 10 c 0 4.5 4.5 0 10 0 c 15.5 0 20 4.5 20 10 c f")
    assert (circle[10, 10, :3] == 0).all() and (circle[0, 0] == 255).all() and abs((255 - circle[..., 0].astype(float)).sum() / 255 - np.pi * 100) < 4
    assert (drawn(b"[4 4] 0 d 2 w 0 10 m 20 10 l S")[10, ::4, 0] == [0, 255, 0, 255, 0]).all()


def test_clips_intersect_and_are_restored():
    px = drawn(b"q 0 0 10 20 re W n 0 0 20 10 re W n 0 0 20 20 re f Q 0.5 g 15 15 5 5 re f")
    assert (px[15, 5, :3] == 0).all() and (px[5, 5] == 255).all() and (px[15, 15] == 255).all() and px[2, 17, 0] == 128


def test_states_forms_and_masks():
    px = drawn(b"/G gs 1 0 0 rg 0 0 20 20 re f", resources={"ExtGState": {"G": {"ca": 0.5}}})
    assert px[5, 5].tolist() == [255, 128, 128, 255]
    px = drawn(b"1 1 0 rg 0 0 20 20 re f /G gs 0 1 1 rg 0 0 20 20 re f", resources={"ExtGState": {"G": {"BM": Name("Multiply")}}})
    assert px[5, 5].tolist() == [0, 255, 0, 255]
    form = Stream({"Subtype": Name("Form"), "BBox": [0, 0, 5, 5], "Matrix": [1, 0, 0, 1, 5, 5], "Group": {"S": Name("Transparency")}}, b"0 0 20 20 re f")
    px = drawn(b"/F Do", resources={"XObject": {"F": form}})
    assert (px[10:15, 5:10, :3] == 0).all() and (px[:9] == 255).all()
    mask = Stream({"Subtype": Name("Form"), "BBox": [0, 0, 20, 20]}, b"1 g 0 0 10 20 re f")
    b = writer.Builder()
    ref = b.page(b"/G gs 0 0 20 20 re f", width=20, height=20)
    b.objects[ref]["Resources"]["ExtGState"] = {"G": {"SMask": {"S": Name("Luminosity"), "G": b.add(mask)}}}
    d = Document(b.to_bytes())
    px = render_page(d, d.pages()[0])
    assert (px[:, :9, :3] == 0).all() and (px[:, 11:] == 255).all()
    itself = Stream({"Subtype": Name("Form")}, b"/F Do")
    assert (drawn(b"/F Do", resources={"XObject": {"F": itself}}) == 255).all()


def test_shadings_and_patterns():
    f = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0], "C1": [1, 1, 1], "N": 1}
    px = drawn(b"/S sh", resources={"Shading": {"S": {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, 20, 0], "Function": f}}})
    assert px[5, 0, 0] < 10 and px[5, 19, 0] > 245 and (np.diff(px[5, :, 0].astype(int)) > 0).all()
    px = drawn(b"/S sh", resources={"Shading": {"S": {"ShadingType": 3, "ColorSpace": Name("DeviceRGB"), "Coords": [10, 10, 0, 10, 10, 10], "Function": f}}})
    assert px[10, 10, 0] < 25 and px[10, 18, 0] > 200
    tile = Stream({"PatternType": 1, "XStep": 10, "YStep": 10, "BBox": [0, 0, 10, 10]}, b"1 0 0 rg 0 0 5 10 re f")
    px = drawn(b"/Pattern cs /P scn 0 0 20 20 re f", resources={"Pattern": {"P": tile}})
    assert (px[5, 2, :3] == [255, 0, 0]).all() and (px[5, 7] == 255).all() and (px[5, 12, :3] == [255, 0, 0]).all()


def test_patterns_of_many_cells():
    def painted(page, steps=(10, 10), size=600, matrix=None, cell=b"1 0 0 rg 0 0 5 10 re f", box=(0, 0, 10, 10)):
        head = {"PatternType": 1, "XStep": steps[0], "YStep": steps[1], "BBox": list(box)} | ({"Matrix": matrix} if matrix else {})
        return drawn(b"/Pattern cs /P scn " + page, size=size, resources={"Pattern": {"P": Stream(head, cell)}})[..., :3]

    red, at = [255, 0, 0], np.arange(800)
    assert (painted(b"0 0 80 80 re f", steps=(1, 1), size=80, cell=b"1 0 0 rg 0 0 1 1 re f", box=(0, 0, 1, 1)) == red).all()
    px = painted(b"0 0 800 800 re f", size=800)  # 6400 cells
    assert (px[:, at % 10 < 5] == red).all() and (px[:, at % 10 >= 5] == 255).all()
    px = painted(b"750 20 20 20 re f", size=800)  # a few of them, far right
    assert (px[760:780, 750:755] == red).all() and (px[760:780, 755:760] == 255).all() and (px[760:780, 760:765] == red).all() and (px[:, :750] == 255).all()
    px = painted(b"0 0 800 800 re f", steps=(2, 2), size=800, cell=b"1 0 0 rg 0 0 1 2 re f", box=(0, 0, 2, 2))  # 160000 cells
    assert (px[:, ::2] == red).all() and (px[:, 1::2] == 255).all()
    # the grid is that of the matrix, whatever the number of cells: one pixel of a turned, uneven grid against the formula
    turned = [0.8, 0.6, -0.6, 0.8, 3, 4]
    px = painted(b"0 0 300 300 re f", steps=(12, 9), size=300, matrix=turned, cell=b"1 0 0 rg 0 0 6 9 re f", box=(0, 0, 12, 9))
    yy, xx = np.mgrid[0:300, 0:300] + 0.5
    u = ((xx - 3) * 0.8 + (300 - yy - 4) * 0.6) % 12
    assert (px[(u > 1) & (u < 5)] == red).all() and (px[(u > 7) & (u < 11)] == 255).all()
    # cells wider than the step lie over each other, and what stands out of the box is cut
    px = painted(b"0 0 200 200 re f", size=200, cell=b"1 0 0 rg 0 0 12 3 re f 0 0 1 rg 0 5 40 3 re f", box=(0, 0, 12, 6))
    assert (px[::-1][:, 20:][at[:200] % 10 < 3] == red).all() and (px[::-1][:, 20:][at[:200] % 10 == 5] == [0, 0, 255]).all() and (px[::-1][at[:200] % 10 > 5] == 255).all()


def test_text_images_and_rotation():
    assert (drawn(b"BT /F1 20 Tf 2 2 Td (A) Tj ET")[10, 6, :3] == 0).all() and (drawn(b"BT 3 Tr /F1 20 Tf 2 2 Td (A) Tj ET") == 255).all()
    im = Stream({"Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"\x00\xc8")
    px = drawn(b"q 20 0 0 20 0 0 cm /I Do Q", resources={"XObject": {"I": im}})
    assert px[5, 5, 0] == 0 and px[5, 15, 0] == 200
    px = drawn(b"1 0 0 rg 0 0 10 10 re f", Rotate=90)
    assert (px[2, 2, :3] == [255, 0, 0]).all() and (px[15, 15] == 255).all()


def test_color_spaces():
    rgb = lambda v, *c: np.round(colors.Space(v, same).rgb(np.array(c, float)), 3).tolist()
    assert rgb(Name("DeviceCMYK"), 0, 0.5, 1, 0.5) == [0.5, 0.25, 0.0] and rgb([Name("Indexed"), Name("DeviceRGB"), 1, Text(b"\0\0\0\xff\0\0")], 1) == [1, 0, 0]
    f = {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [0, 0, 1], "N": 1}
    assert rgb([Name("Separation"), Name("Blue"), Name("DeviceRGB"), f], 1) == [0, 0, 1] and rgb([Name("ICCBased"), Stream({"N": 1}, b"")], 0.5) == [0.5] * 3
    white = rgb([Name("Lab"), {"WhitePoint": [0.9505, 1, 1.089]}], 100, 0, 0)
    assert all(v > 0.99 for v in white) and rgb([Name("CalGray"), {"Gamma": 2}], 0.5) == [0.25] * 3
    s = Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}, b"\x00\xff\x00")
    assert colors.Function(s, same)(np.array([0.25, 0.5])).ravel().tolist() == [0.5, 1.0]
    st = {"FunctionType": 3, "Domain": [0, 1], "Functions": [f, f], "Bounds": [0.5], "Encode": [0, 1, 1, 0]}
    assert colors.Function(st, same)(np.array([0.25, 0.75]))[:, 0].tolist() == [0.5, 0.5]
    with pytest.raises(PdfError):
        colors.Function({"FunctionType": 4}, same)
    b, s_ = np.full((1, 3), 0.25), np.full((1, 3), 0.5)
    assert {m: round(float(f(b, s_)[0, 0]), 4) for m, f in colors.BLEND.items() if m in ("Multiply", "Screen", "Difference", "HardLight")} == {"Multiply": 0.125, "Screen": 0.625, "Difference": 0.25, "HardLight": 0.25} and len(colors.BLEND) == 16


def test_images():
    rgba = np.random.default_rng(1).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    s, mask = images.from_png(images.png_of(rgba))
    assert (images.to_rgba(s.dict, zlib.decompress(s.data))[..., :3] == rgba[..., :3]).all() and zlib.decompress(mask.data) == rgba[..., 3].tobytes()
    head = {"Width": 3, "Height": 1, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray")}
    assert images.to_rgba(head, b"\xa0")[0, :, 0].tolist() == [255, 0, 255] and images.to_rgba(head | {"Decode": [1, 0]}, b"\xa0")[0, :, 0].tolist() == [0, 255, 0]
    assert images.to_rgba({"Width": 2, "Height": 2}, b"\x09")[..., 0].tolist() == [[9, 0], [0, 0]]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + bytes(9)
    assert images.jpeg_size(jpeg) == (32, 16, 3) and images.from_jpeg(jpeg)[0].dict["ColorSpace"] == "DeviceRGB"
    with pytest.raises(PdfError):
        images.from_png(b"no")


def test_images_in_documents():
    rgba = np.zeros((2, 2, 4), np.uint8)
    rgba[:, 0] = [255, 0, 0, 255]
    b = writer.Builder()
    im = b.image(images.png_of(rgba))
    inner = writer.Content().image("I", 0, 0, 20, 20)
    ref = b.page(writer.Content().op("g", 0.5).rect(0, 0, 20, 20).marked("Figure", 0, inner).line(0, 0, 20, 0).bytes(), width=20, height=20)
    b.objects[ref]["Resources"]["XObject"] = {"I": im}
    d = Document(b.to_bytes())
    px = render_page(d, d.pages()[0])
    assert (px[5, 5, :3] == [255, 0, 0]).all() and px[5, 15, 0] == 128 and d.images(d.pages()[0])[0]["width"] == 2


WORDS = [("Chapter", 10, 100, 300, 60, 0.9), ("One", 320, 100, 100, 60, 0.9), ("Bödy", 10, 300, 60, 20, 0.9), ("text.", 80, 300, 60, 20, 0.9), ("漢字", 150, 300, 60, 20, 0.9)]


def test_recognition_pipeline(spark):
    blank = writer.Builder()
    blank.page()
    files = spark.createDataFrame([("scan", bytearray(blank.to_bytes())), ("text", bytearray(writer.text_document("here"))), ("bad", bytearray(b"x"))], "doc_id string, content binary")
    words = raster.recognize_pages(files, lambda px: WORDS, dpi=72)
    assert {r["doc_id"] for r in words.collect()} == {"scan"}
    out = raster.with_text_layers(files.where("doc_id <> 'bad'"), words)
    data = {r["doc_id"]: bytes(r["content"]) for r in out.collect()}
    d = Document(data["scan"])
    assert d.text().split() == ["Chapter", "One", "Bödy", "text.", "漢字"] and [(e["struct_type"], e["actual_text"]) for e in d.struct_elements()[0]][1:] == [("H1", "Chapter One"), ("P", "Bödy text. 漢字")]
    assert all(r["rendering_mode"] == 3 for r in d.runs(d.pages()[0])) and (render_page(d, d.pages()[0]) == 255).all()
    assert {r["doc_id"]: r["source"] for r in raster.hybrid_pages(files, words).collect()} == {"scan": "Ocr", "text": "ContentStream"}
    b = writer.Builder(d)
    assert ocr_layer.strip_text_layers(b, 0) == 1 and not Document(b.to_bytes()).text()


def test_many_characters_take_two_bytes():
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    b = writer.Builder()
    b.page()
    ocr_layer.add_text_layer(b, 0, [{"text": text, "x": 0, "y": 0, "width": 10, "height": 10}], (100, 100))
    assert Document(b.to_bytes()).text() == text


def test_auto_tagging_and_rendering_of_files(spark):
    files = spark.createDataFrame([(1, bytearray(writer.text_document("one line\n1. item")))], "doc_id int, content binary")
    tagged = raster.auto_tagged(files)
    elems, trees = pdf.struct_elements(pdf.parse(tagged, ["tree"]))
    assert [r["struct_type"] for r in elems.orderBy("dfs_ord").collect()] == ["Document", "P", "LI"] and trees.first()["tree_lang"] == "en-US"
    assert bytes(raster.auto_tagged(tagged).first()["content"]) == bytes(tagged.first()["content"])
    r = raster.render_pages(files, dpi=36).first()
    assert (r["width"], r["height"]) == (306, 396) and len(r["pixels"]) == 306 * 396 * 4
    assert ocr.to_gray(np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(396, 306, 4)).min() < 100


def test_auto_tagging_is_one_python_stage_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, "one line\n1. item"), (2, ""), (3, "\n" * 60 + "last")], "doc_id int, text string")
    files = pdf.text_documents(texts)
    parsed = pdf.parse(raster.auto_tagged(files), ["tree"])
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
    kinds = {r["doc_id"]: r["tree"] and [(e["struct_type"], e["actual_text"]) for e in r["tree"]["elements"]] for r in parsed.collect()}
    assert kinds == {1: [("Document", None), ("P", "one line"), ("LI", "1. item")], 2: None, 3: [("Document", None), ("P", "last")]}
    broken = spark.createDataFrame([("bad", bytearray(b"x")), ("none", None)], "doc_id string, content binary")
    assert {r["doc_id"]: r["content"] and bytes(r["content"]) for r in raster.auto_tagged(broken).collect()} == {"bad": b"x", "none": None}
