"""PDF files as tables, and tables as PDF files.

Files are read by Spark's binaryFile source and parsed in one Python stage, which gives a row of nested columns for each file; only the asked
ones are made. A file that can't be parsed is a row with its error, never a failed task. The table functions unnest that row; from there on
everything is a DataFrame expression. The parsed row drops the content, so it isn't carried through later shuffles.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from folioflow.functions.text import font_style
from folioflow.pdf import filters, writer
from folioflow.pdf.document import Document
from folioflow.pdf.syntax import Name, PdfError, Stream

RUN = "text: string, font_name: string, font_size: double, x: double, y: double, width: double, height: double, color: array<double>, rendering_mode: int"
META = "title: string, author: string, subject: string, keywords: string, creator: string, producer: string, creation_date: string, modification_date: string"
ELEM = "dfs_ord: int, parent_ord: int, depth: int, struct_type: string, role: string, level: int, title: string, lang: string, alt_text: string, actual_text: string"
FEATURES = "encrypted: boolean, xmp: string, lzw: boolean, open_action_js: boolean, names_js: boolean, aa: boolean, fonts: array<struct<name: string, embedded: boolean>>, output_intents: array<string>, device_spaces: boolean, info_title: string, xmp_title: string, info_author: string, xmp_author: string, page_groups: array<string>, print_boxes: array<boolean>"
#: Nested columns by name: their type, and how a document gives them.
OUTPUTS: dict[str, tuple[str, Callable[[Document], object]]] = {
    "pages": ("array<struct<page_index: int, media_box: array<double>, rotate: int, text: string>>", lambda d: [{"page_index": k, "media_box": d.media_box(p), "rotate": r if isinstance(r := d.inherited(p, "Rotate"), int) else 0, "text": _or_none(d.page_text, p)} for k, p in enumerate(d.pages())]),
    "runs": (f"array<struct<page_index: int, run_index: int, {RUN}>>", lambda d: [{"page_index": k, "run_index": n} | r for k, p in enumerate(d.pages()) for n, r in enumerate(runs_of_page(d, p))]),
    "metadata": (f"struct<{META}>", lambda d: d.metadata()),
    "outlines": ("array<struct<path: array<int>, depth: int, title: string, page: int, uri: string, action_type: string, color: array<double>, flags: int>>", lambda d: d.outlines()),
    "annotations": ("array<struct<page_index: int, subtype: string, rect: array<double>, contents: string, flags: int, color: array<double>, author: string, modified_date: string, uri: string, quad_points: array<double>>>", lambda d: [{"page_index": k} | a for k, p in enumerate(d.pages()) for a in d.annotations(p)]),
    "fields": ("array<struct<name: string, field_type: string, value: string, default_value: string, flags: int, options: array<string>>>", lambda d: [{k: v for k, v in f.items() if k not in ("ref", "head")} for f in d.form_fields()]),
    "signatures": ("array<struct<field: string, sub_filter: string, byte_range: array<bigint>, contents: binary, name: string, reason: string, location: string, date: string, contact: string>>", lambda d: d.signatures()),
    "images": ("array<struct<page_index: int, name: string, width: int, height: int, bpc: int, color_space: string, encoding: string, is_mask: boolean, data: binary>>", lambda d: [{"page_index": k} | i for k, p in enumerate(d.pages()) for i in d.images(p)]),
    "tree": (f"struct<lang: string, elements: array<struct<{ELEM}>>>", lambda d: None if (t := d.struct_elements()) is None else {"lang": t[1], "elements": t[0]}),
    "features": (f"struct<{FEATURES}>", lambda d: d.features()),
}


def _or_none(f, *args):
    try:
        return f(*args)
    except PdfError:
        return None


def runs_of_page(d: Document, page: dict) -> list[dict]:
    """The runs of a page; none of one whose content can't be read."""
    return _or_none(d.runs, page) or []


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (the path), modificationTime, length, content of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumnRenamed("path", "doc_id")


#: Rows that are made or parsed at a time.
AT_ONCE = 64


def parse(files: DataFrame, outputs: list[str], password: str | Callable[[object], str] | None = None) -> DataFrame:
    """doc_id, version, object_count, page_count, error and the asked nested columns for each row of files (doc_id, content).

    password may be a function of the doc_id. Files that come straight from built() are made in the same Python stage, so no content is moved.
    """
    rows, make = getattr(files, "made", (files.select("doc_id", "content"), None))
    kind = files.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{c} {OUTPUTS[c][0]}" for c in outputs)
    schema = f"doc_id {kind}, version string, object_count int, page_count int, error struct<kind: string, message: string>" + (f", {columns}" if columns else "")
    parsed: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(parsed)

    def row(doc_id, data: bytes | None) -> dict:
        out = dict.fromkeys(target.names) | {"doc_id": doc_id}
        try:
            d = Document(data or b"", password(doc_id) if callable(password) else password)
            out |= {"version": d.version, "object_count": len(d.objects), "page_count": _or_none(lambda: d.page_count)}
            for c in outputs:
                out[c] = OUTPUTS[c][1](d)
        except PdfError as e:
            out["error"] = {"kind": e.kind, "message": str(e)}
        except Exception as e:  # a file may be broken in any way; it is a row all the same
            out["error"] = {"kind": type(e).__name__, "message": str(e)[:500]}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE).to_pylist()
                out = [row(r["doc_id"], make(r) if make else r["content"]) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in target], schema=target)

    return rows.mapInArrow(run, parsed)


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("doc_id", "error.kind", "error.message")


def text_runs(parsed: DataFrame) -> DataFrame:
    """The runs of parsed documents, with styles by their fonts' names."""
    rows = parsed.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*").withColumn("__s", font_style(F.col("font_name")))
    return rows.select("*", F.col("__s.bold").alias("is_bold"), F.col("__s.italic").alias("is_italic"), F.col("__s.monospaced").alias("is_monospaced")).drop("__s")


def unnest(parsed: DataFrame, column: str) -> DataFrame:
    """A row for each element of a nested column."""
    return parsed.select("doc_id", F.explode(column).alias("__e")).select("doc_id", "__e.*")


def document_text(parsed: DataFrame) -> DataFrame:
    """doc_id and the text of all pages, joined by form feeds; a page without text is empty."""
    pages = F.transform(F.array_sort("pages"), lambda p: F.coalesce(p["text"], F.lit("")))
    return parsed.where("error is null").select("doc_id", F.array_join(pages, "\f").alias("text"))


def struct_elements(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements of structure trees, and (doc_id, has_tree, tree_lang) of all documents."""
    elems = parsed.select("doc_id", F.explode("tree.elements").alias("e")).select("doc_id", "e.*")
    return elems, parsed.select("doc_id", F.col("tree").isNotNull().alias("has_tree"), F.col("tree.lang").alias("tree_lang"))


def built(rows: DataFrame, make: Callable[[dict], bytes]) -> DataFrame:
    """doc_id and content: a file for each row (with doc_id), made by a function of the row as a dictionary."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = to_arrow_schema(_parse_datatype_string(f"doc_id {kind}, content binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in part], schema.field(0).type), pa.array([make(r) for r in part], pa.binary())], schema=schema)

    out = rows.mapInArrow(run, f"doc_id {kind}, content binary")
    out.made = rows, make
    return out


def text_documents(docs: DataFrame) -> DataFrame:
    """A file for each text."""
    return built(docs.select("doc_id", "text"), lambda r: writer.text_document(r["text"] or ""))


def save_files(files: DataFrame, folder: str) -> None:
    """Each content as a file in a folder that all executors can write to, under a name by doc_id; a repeated task writes the same again."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = hashlib.sha256(str(r["doc_id"]).encode()).hexdigest()[:16]
            part = f"{folder}/.{name}.{os.getpid()}"
            with open(part, "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(part, f"{folder}/{name}.pdf")

    files.select("doc_id", "content").foreachPartition(run)


def filter_roundtrips(docs: DataFrame) -> DataFrame:
    """For each text, whether every filter gives its bytes back."""
    columns = ["flate", "hex", "a85", "run_length", "predictor"]
    schema = to_arrow_schema(_parse_datatype_string("doc_id long, digest string, n_bytes long, " + ", ".join(f"{c} boolean" for c in columns)))

    def back(data: bytes, name: str, coded: bytes, parms: dict | None = None) -> bool:
        return filters.decode(Stream({"Filter": Name(name)} | ({"DecodeParms": parms} if parms else {}), coded)) == data

    def check(data: bytes) -> list[bool]:
        import zlib

        whole = data[: len(data) // 8 * 8]
        grid = np.frombuffer(whole, np.uint8).reshape(-1, 8)
        rows = np.insert(np.diff(grid, axis=0, prepend=np.zeros((1, 8), np.uint8)), 0, 2, axis=1).tobytes()
        return [
            filters.decode(filters.encode_flate(data)) == data, back(data, "AHx", filters.encode_ascii_hex(data)), back(data, "A85", filters.encode_ascii_85(data)), back(data, "RL", filters.encode_run_length(data)),
            back(whole, "Fl", zlib.compress(rows), {"Predictor": 12, "Columns": 8}),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, AT_ONCE).to_pydict() for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            raw = [t.encode("utf-8", "surrogatepass") for t in part["text"]]
            checks = [check(b) for b in raw]
            cols = [part["doc_id"], [hashlib.sha256(b).hexdigest() for b in raw], [len(b) for b in raw], *[[c[k] for c in checks] for k in range(len(columns))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest string, n_bytes long, " + ", ".join(f"{c} boolean" for c in columns))
