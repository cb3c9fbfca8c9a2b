"""File-level operators on files made of the driver's documents: what is read back is held against the rows that went in."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.pdf import filters, writer
from folioflow.pdf.syntax import Name, Stream
from folioflow.plans import query, table
from folioflow.plans.pdf_queries import PAGES_SQL
from folioflow.sources import pdf

#: Fixed values of the LZW filter: the code that clears the table, the one that ends the data, and the bits of the first codes.
LZW_CLEAR, LZW_END, LZW_BITS = 256, 257, 9


def lzw_encoded(data: bytes) -> bytes:
    """LZW with a clear code before each run of 250 bytes, so that the table never outgrows the first width."""
    codes: list[int] = []
    for k in range(0, len(data), 250):
        codes += [LZW_CLEAR, *data[k : k + 250]]
    bits = (np.array([*codes, LZW_END], np.uint16)[:, None] >> np.arange(LZW_BITS - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def tiff_rows(data: bytes, columns: int) -> bytes:
    """Whole rows of bytes as differences to the left neighbour."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, columns).astype(np.int16)
    return np.diff(rows, axis=1, prepend=np.int16(0)).astype(np.uint8).tobytes()


def _digests(rows: DataFrame, back: Callable[[bytes], dict[str, bytes]], names: list[str]) -> DataFrame:
    """doc_id and a digest for each name; back gives the bytes by name from those of the text."""

    def run(batches):
        for batch in (b.slice(k, pdf.AT_ONCE) for b in batches for k in range(0, b.num_rows, pdf.AT_ONCE)):
            ids, texts = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("doc_id", "text"))
            found = [back((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            digests = [pa.array([hashlib.sha256(f[n]).hexdigest() for f in found], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *digests], names=["doc_id", *names])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} string" for n in names))


SHA = "sha256(coalesce(text, ''))"


@query(f"SELECT doc_id, {SHA} AS lzw, {SHA} AS chained FROM documents")
def filter_lzw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LZW alone, and behind Flate in a chain of filters."""

    def back(data: bytes) -> dict[str, bytes]:
        coded = lzw_encoded(data)
        chain = Stream({"Filter": [Name("FlateDecode"), Name("LZWDecode")]}, zlib.compress(coded, 1))
        return {"lzw": filters.decode(Stream({"Filter": Name("LZWDecode")}, coded)), "chained": filters.decode(chain)}

    return _digests(table(spark, sf_dir, "documents"), back, ["lzw", "chained"])


@query("SELECT doc_id, sha256(repeat(chr(CAST(65 + doc_id % 26 AS INT)), 8) || repeat('abcdefgh', CAST(1 + doc_id % 7 AS INT))) AS tiff FROM documents")
def filter_tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TIFF predictor over rows of eight bytes."""
    text = F.concat(F.repeat(F.char(65 + F.col("doc_id") % 26), F.lit(8)), F.repeat(F.lit("abcdefgh"), (1 + F.col("doc_id") % 7).cast("int")))

    def back(data: bytes) -> dict[str, bytes]:
        parms = {"Predictor": 2, "Columns": 8}
        return {"tiff": filters.decode(Stream({"Filter": Name("FlateDecode"), "DecodeParms": parms}, zlib.compress(tiff_rows(data, 8))))}

    return _digests(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), back, ["tiff"])


def _without_table(row: dict) -> bytes:
    """A file whose table of objects can't be found, so only a scan gives them."""
    data = writer.text_document(row["text"] or "")
    at = data.rindex(b"startxref")
    table_at = int(data[at:].split()[1])
    return data[:table_at] + b"lost" + data[table_at + 4 : at] + b"startxref\n99999999\n%%EOF\n"


@query(f"WITH {PAGES_SQL} SELECT doc_id, string_agg(text, chr(12) ORDER BY page) AS text FROM pages GROUP BY doc_id")
def pdf_rebuilt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pdf.built(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), _without_table)
    return pdf.document_text(pdf.parse(files, ["pages"]))


def _packed(row: dict) -> bytes:
    """A file whose objects lie in a compressed stream of objects, found by a stream of cross-references."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 0 >>", f"<< /Title (Document {row['doc_id']}) /Author ({row['source'] or ''}) >>".encode()]
    places = np.cumsum([0, *(len(o) + 1 for o in objects)])
    head = b" ".join(b"%d %d" % (k + 1, places[k]) for k in range(len(objects))) + b" "
    body = zlib.compress(head + b" ".join(objects))
    out = bytearray(b"%PDF-1.5\n")
    fourth = len(out)
    out += b"4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(body)) + body + b"\nendstream\nendobj\n"
    fifth = len(out)
    entries = [(0, 0, 255), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, fourth, 0), (1, fifth, 0)]
    refs = b"".join(bytes([kind]) + at.to_bytes(4, "big") + bytes([last]) for kind, at, last in entries)
    out += b"5 0 obj\n<< /Type /XRef /Size 6 /W [1 4 1] /Root 1 0 R /Info 3 0 R /Length %d >>\nstream\n" % len(refs) + refs + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % fifth)


@query("SELECT doc_id, '1.5' AS version, CAST(0 AS INT) AS page_count, 'Document ' || doc_id AS title, coalesce(source, '') AS author FROM documents")
def pdf_object_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pdf.built(table(spark, sf_dir, "documents").select("doc_id", "source"), _packed)
    return pdf.parse(files, ["metadata"]).select("doc_id", "version", "page_count", "metadata.title", "metadata.author")


def _sealed(row: dict) -> bytes:
    b = writer.Builder()
    b.page()
    b.metadata(Title=f"Document {row['doc_id']}")
    return b.to_encrypted(f"u{row['doc_id'] % 5}", "owner", aes=row["doc_id"] % 2 == 0)


@query("SELECT doc_id, 'Document ' || doc_id AS by_user, TRUE AS refused FROM documents")
def pdf_passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RC4 and AES files opened by the user's password, and not by a wrong one."""
    files = pdf.built(table(spark, sf_dir, "documents").select("doc_id").where("doc_id is not null"), _sealed)
    parsed = lambda password, name: pdf.parse(files, ["metadata"], password).select("doc_id", F.col("metadata.title").alias(name), F.col("error.kind").alias(f"{name}_error"))
    opened = parsed(lambda doc_id: f"u{doc_id % 5}", "by_user").join(parsed("wrong", "by_none"), "doc_id")
    return opened.select("doc_id", "by_user", (F.col("by_none").isNull() & F.col("by_none_error").isNotNull()).alias("refused"))
