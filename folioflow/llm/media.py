"""Operator 4. Media columns: baseline JPEG parsed, Huffman-decoded and reduced to DC-only luminance thumbnails, in numpy.

`read_images` takes a column of files and gives dimensions, thumbnails and their hashes. `media_of_documents` stores each text in such a file
and reads it back from the stored bytes.

Defined cases: a null or empty text is 192 spaces; a null, damaged or foreign file has null dimensions and its error; equal files have equal
results; a text of any length is one file, coded in groups of bounded size; repeated rows are rows; further columns are left out; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from folioflow.llm import jpeg
from folioflow.llm.common import arrow_map, column


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 filled up with spaces to a positive multiple of 192, and the bytes before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // jpeg.UNIT)) * jpeg.UNIT
    return raw + b" " * (size - len(raw)), len(raw)


def feature(image: jpeg.Image) -> str:
    """Dimensions, and two hashes of the thumbnail: of its looks and of its bytes."""
    small = jpeg.thumbnail(image)
    return f"{image.width}x{image.height} {small.shape[1]}x{small.shape[0]} {jpeg.difference_hash(small)} {xxhash.xxh3_64_hexdigest(np.ascontiguousarray(small).tobytes())}"


def stored(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and media: each text as a file."""

    def f(part: pa.RecordBatch) -> dict:
        return {"media": jpeg.encode([payload_of(t)[0] for t in column(part, text)])}

    return arrow_map(df.select(key, text), f, f"{key} {df.schema[key].dataType.simpleString()}, media binary", [key])


def read_images(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, width, height, thumbnail (its bytes, row by row), thumb_width, dhash, error for a column of files."""

    def f(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("width", "height", "thumbnail", "thumb_width", "dhash", "error")}
        for image in jpeg.decode([x or b"" for x in column(part, media)]):
            if isinstance(image, ValueError):
                row = (None, None, None, None, None, str(image))
            else:
                small = jpeg.thumbnail(image)
                row = (image.width, image.height, np.ascontiguousarray(small).tobytes(), small.shape[1], jpeg.difference_hash(small), None)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    schema = f"{key} {df.schema[key].dataType.simpleString()}, width int, height int, thumbnail binary, thumb_width int, dhash string, error string"
    return arrow_map(df.select(key, media), f, schema, [key])


def media_of_documents(docs: DataFrame) -> DataFrame:
    """What each text is stored as, and what is read back from it."""

    def f(part: pa.RecordBatch) -> dict:
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        out: dict[str, list] = {k: [] for k in names}
        payloads = [payload_of(t) for t in column(part, "text")]
        files = jpeg.encode([p for p, _ in payloads])
        for (_, n), data, image in zip(payloads, files, jpeg.decode(files), strict=True):
            if isinstance(image, ValueError):
                raise image
            back = jpeg.stored_bytes(image)
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(image))
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(docs.select("doc_id", "text"), f, schema, ["doc_id"])
