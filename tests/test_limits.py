"""Results at the edges of types and sizes that the small tables don't reach."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.operators import layout
from folioflow.pdf import crypto, filters, writer
from folioflow.pdf.syntax import Ref
from folioflow.plans import file_queries, load, ocr_queries
from folioflow.sources import pdf

DATA = "/root/testdata/sf0.001"
QUERIES = load()[0]


def test_pixels_are_computed_in_single_precision(spark, tmp_path):
    x = np.float32(115 / 127 - 1)
    xs = [float(v) for v in np.concatenate([x + np.arange(-40, 40, dtype=np.float32) * np.float32(6e-9), np.linspace(-1, 1, 999).astype(np.float32)])]
    spark.createDataFrame([(0, xs)], "label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r["v"] for r in ocr_queries._pixels(spark, str(tmp_path)).collect()]
    single = np.floor((np.array(xs, np.float32) + np.float32(1)) * np.float32(127)).astype(int).tolist()
    assert got == single and single != np.floor((np.array(xs) + 1) * 127).astype(int).tolist()


class Counted(dict):
    """A dictionary that counts how often it is gone through."""

    passes = 0

    def __iter__(self):
        self.passes += 1
        return super().__iter__()


def test_objects_are_added_without_going_through_all():
    b = writer.Builder()
    b.objects = Counted(b.objects)
    refs = [b.add(k) for k in range(50)]
    assert [r.num for r in refs] == list(range(3, 53)) and b.objects.passes == 1
    b.objects[Ref(99, 0)] = None
    assert b.add(0).num == 100


def test_aes_of_many_blocks_and_of_few():
    key = bytes.fromhex("000102030405060708090a0b0c0d0e0f")
    assert crypto.Aes(key).encrypt_block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    for k in (16, 32):
        for n in (0, 1, crypto.MANY_BLOCKS - 1, crypto.MANY_BLOCKS, 100):
            data = bytes(x * 7 & 255 for x in range(16 * n))
            assert crypto.cbc_decrypt(bytes(range(k)), key, crypto.cbc_encrypt(bytes(range(k)), key, data)) == data


def test_files_are_made_and_parsed_in_one_stage(spark):
    files = pdf.built(spark.range(3).withColumnRenamed("id", "doc_id"), lambda r: writer.text_document(f"text {r['doc_id']}"))
    parsed = pdf.document_text(pdf.parse(files, ["pages"]))
    assert parsed._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    # what was changed in between is parsed as it is
    again = pdf.document_text(pdf.parse(files.where("doc_id > 0"), ["pages"]))
    assert sorted(map(tuple, parsed.collect())) == [(0, "text 0"), (1, "text 1"), (2, "text 2")] and again.count() == 2


def test_passwords_read_their_rows_twice(spark):
    plan = file_queries.pdf_passwords(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_lzw_takes_many_codes_at_once(monkeypatch):
    calls, codes = [], filters._codes
    monkeypatch.setattr(filters, "_codes", lambda *a: calls.append(a) or codes(*a))
    data = bytes(k * k & 255 for k in range(20_000))
    assert filters.lzw(file_queries.lzw_encoded(data)) == data and len(calls) < 200


def test_filters_are_checked_a_few_rows_at_a_time():
    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run([pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": ["a\0b" * k for k in range(200)]})]))

    out = pdf.filter_roundtrips(Rows())
    assert [b.num_rows for b in out] == [64, 64, 64, 8] and all(all(r[c] for c in ("flate", "hex", "a85", "run_length", "predictor")) for b in out for r in b.to_pylist())


def test_labels_of_crowded_pages(spark):
    rng = np.random.default_rng(1)
    number = lambda n, top: [float(v) for v in rng.integers(0, top, n)]
    n = 400
    runs = list(zip(["d"] * n, [0] * n, range(n), [f"t{k}" for k in range(n)], number(n, 500), number(n, 700), number(n, 40), [float(v) for v in rng.choice([0.5, 8, 10, 30], n)], strict=True))
    fields = list(zip(["d"] * n, [0] * n, [f"f{k // 2}" for k in range(n)], number(n, 500), number(n, 700), number(n, 100), number(n, 30), strict=True))
    place = "x double, y double, width double, height double"
    r, f = spark.createDataFrame(runs, f"doc_id string, page_index int, run_index int, text string, {place}"), spark.createDataFrame(fields, f"doc_id string, page_index int, field_name string, {place}")
    expected: dict = {}
    for _, _, name, fx, fy, fw, fh in fields:
        for _, _, o, t, x, y, w, h in runs:
            left = fx - x - w if abs(y + h / 2 - fy - fh / 2) < h * 1.5 and x + w < fx + 5 and fx - x - w >= 0 else None
            above = y - fy if y > fy and abs(x - fx) < fw and y - fy < h * 3 else None
            for d in (left, above):
                if d is not None:
                    expected[name] = min(expected.get(name, (d, o, t)), (d, o, t))
    got = {x["field_name"]: (x["distance"], x["label"]) for x in layout.field_labels(r, f).collect()}
    assert got == {k: (d, t) for k, (d, _, t) in expected.items()} and len(got) > 100
    spans = [(F.col("y") - F.col("height") * 3, F.col("y"))]
    pairs = layout._banded(r, spans, f.select("doc_id", "page_index", F.col("y").alias("f_y")), [F.col("f_y")], layout.PAGE).count()
    assert pairs < n * n / 6


def test_long_pages_are_folded_in_pieces(spark):
    n = 3 * layout.PIECE + 1
    got = spark.range(1).select(layout.anchored(F.expr(f"transform(sequence(0, {n - 1}), k -> -1.0D * k)"), 2.0).alias("v")).first()["v"]
    assert got == [k // 3 + 1 for k in range(n)]
    most = lambda *v: spark.createDataFrame([(list(v),)], "v array<string>").select(layout.most_frequent(F.col("v"), "string")).first()[0]
    assert (most("b", "a", "b", "a", "c"), most(None, "a", None), most("a", None), most()) == ("a", None, None, None)


def test_standards_are_reported_in_one_pass(spark):
    plan = QUERIES["standards_report"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "collect_list" not in plan
