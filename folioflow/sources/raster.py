"""Pages as rasters, recognised words, and documents that carry them: one Python stage from file to result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import ocr, tags
from folioflow.pdf import ocr_layer
from folioflow.pdf.document import Document
from folioflow.pdf.render import render_page
from folioflow.pdf.syntax import PdfError
from folioflow.pdf.writer import Builder
from folioflow.sources import pdf

#: From a grey raster to (text, x, y, width, height, confidence), in pixels from the top left.
Engine = Callable[[np.ndarray], list[tuple[str, int, int, int, int, float]]]


def _pages(content: bytes) -> list[tuple[Document, int, dict]]:
    try:
        doc = Document(bytes(content))
        return [(doc, k, p) for k, p in enumerate(doc.pages())]
    except (PdfError, RecursionError, ValueError):
        return []


def _kind(files: DataFrame) -> str:
    return files.schema["doc_id"].dataType.simpleString()


def render_pages(files: DataFrame, dpi: float = 72) -> DataFrame:
    """doc_id, page_index, width, height and RGBA pixels of each page of files (doc_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            for doc_id, content in zip(pdf_["doc_id"], pdf_["content"], strict=True):
                for doc, k, page in _pages(content):
                    px = render_page(doc, page, dpi)
                    yield pd.DataFrame([(doc_id, k, px.shape[1], px.shape[0], px.tobytes())], columns=["doc_id", "page_index", "width", "height", "pixels"])

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {_kind(files)}, page_index int, width int, height int, pixels binary")


def recognize_pages(files: DataFrame, engine: Engine, dpi: float = 150, redo: bool = False) -> DataFrame:
    """Words of pages without text (or of all, to redo them): rendered, made grey, black and white, and recognised."""
    fields = "word_index int, text string, x int, y int, width int, height int, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            for doc_id, content in zip(pdf_["doc_id"], pdf_["content"], strict=True):
                rows = []
                for doc, k, page in _pages(content):
                    if not redo and (doc.page_text(page) or "").strip():
                        continue
                    px = ocr.preprocess(ocr.to_gray(render_page(doc, page, dpi)))
                    rows += [(doc_id, k, px.shape[1], px.shape[0], n, *w) for n, w in enumerate(engine(px))]
                yield pd.DataFrame(rows, columns=["doc_id", "page_index", "image_width", "image_height", *[f.split()[0] for f in fields.split(", ")]])

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {_kind(files)}, page_index int, image_width int, image_height int, {fields}")


def with_text_layers(files: DataFrame, words: DataFrame, tags: bool = True, redo: bool = False) -> DataFrame:
    """files with an invisible text layer on each page that has words, and one structure tree of all of them."""
    word = F.struct("page_index", "word_index", "image_width", "image_height", "text", "x", "y", "width", "height")
    per = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(word)).alias("words"))
    joined = files.select("doc_id", "content").join(per, "doc_id", "left")

    def make(row: dict) -> bytes:
        data, found = bytes(row["content"]), row["words"] or []
        if not found:
            return data
        b = Builder(Document(data))
        for k in sorted({w["page_index"] for w in found}):
            own = [w for w in found if w["page_index"] == k]
            if redo:
                ocr_layer.strip_text_layers(b, k)
            ocr_layer.add_text_layer(b, k, own, (own[0]["image_width"], own[0]["image_height"]))
        if tags:
            b.structure([e for k in sorted({w["page_index"] for w in found}) for e in ocr_layer.structure_of([w for w in found if w["page_index"] == k])])
        return b.to_bytes()

    return pdf.built(joined, make)


def hybrid_pages(files: DataFrame, words: DataFrame) -> DataFrame:
    """For each page the choice between its visible embedded text and the recognised words."""
    parsed = pdf.parse(files, ["pages", "runs"])
    pages = parsed.select("doc_id", F.explode("pages.page_index").alias("page_index"))
    seen = pdf.text_runs(parsed).where("rendering_mode <> 3").groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_index", "text"))), lambda r: r["text"]), " ").alias("stream_text"))
    read = words.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"]), " ").alias("ocr_text"))
    joined = pages.join(seen, ["doc_id", "page_index"], "left").join(read, ["doc_id", "page_index"], "left").fillna("", ["stream_text", "ocr_text"])
    return ocr.compare_sources(joined)


def auto_tagged(files: DataFrame, lang: str = "en-US") -> DataFrame:
    """files with a structure tree from their blocks, where they have none; content streams stay as they are, and so do files that can't be parsed.

    A file is parsed once, and written, in one Python stage; files that come straight from pdf.built are made in it too.
    """
    rows, make = getattr(files, "made", (files.select("doc_id", "content"), lambda row: row["content"]))

    def tagged(row: dict) -> bytes | None:
        data = make(row)
        try:
            return ocr_layer.auto_tagged(bytes(data), lambda doc: tags.elements_of([pdf.runs_of_page(doc, p) for p in doc.pages()]), lang)
        except Exception:  # a file may be broken in any way
            return data

    return pdf.built(rows, tagged)
