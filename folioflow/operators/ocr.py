"""OCR words, rasters and the choice between embedded and recognised text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import is_garbled, normalize_whitespace, text_similarity

V_GAP, H_GAP, DEPTH = 40, 40, 10


def compare_sources(df: DataFrame, stream: str = "stream_text", ocr: str = "ocr_text", alike: float = 0.8) -> DataFrame:
    """df with source (Neither, Ocr, ContentStream, Both), similarity and accessible_text."""
    s, o = normalize_whitespace(F.col(stream)), normalize_whitespace(F.col(ocr))
    out = df.withColumn("__s", s).withColumn("__o", o)
    sim = F.when((F.col("__s") == "") | (F.col("__o") == ""), F.lit(0.0)).otherwise(text_similarity(F.col("__s"), F.col("__o")))
    out = out.withColumn("similarity", sim)
    source = (
        F.when((F.col("__s") == "") & (F.col("__o") == ""), "Neither").when(F.col("__s") == "", "Ocr").when(F.col("__o") == "", "ContentStream")
        .when(F.col("similarity") > alike, "ContentStream").when(is_garbled(F.col("__s")) & ~is_garbled(F.col("__o")), "Ocr").otherwise("Both")
    )
    out = out.withColumn("source", source)
    both = F.concat(F.lit("OCR reading: "), F.col("__o"), F.lit(". Original text: "), F.col("__s"), F.lit("."))
    text = F.when(F.col("source") == "Neither", "").when(F.col("source") == "Ocr", F.col(ocr)).when(F.col("source") == "ContentStream", F.col(stream)).otherwise(both)
    return out.withColumn("accessible_text", text).drop("__s", "__o")


def parse_tsv(df: DataFrame, tsv: str = "tsv") -> DataFrame:
    """Words of a recogniser's table: rows of level 5 with at least 12 fields, a text and a confidence of 0 or more, which is divided by 100."""
    keep = [c for c in df.columns if c != tsv]
    rows = df.select(*keep, F.posexplode(F.split(F.col(tsv), "\n")).alias("line_no", "line")).where("line_no > 0")
    f = rows.withColumn("f", F.split("line", "\t")).where(F.size("f") >= 12)
    num = lambda k, t: F.col("f")[k].try_cast(t)
    f = f.select(*keep, "line_no", num(0, "int").alias("level"), F.trim(F.col("f")[11]).alias("text"), num(6, "int").alias("x"), num(7, "int").alias("y"), num(8, "int").alias("width"), num(9, "int").alias("height"), num(10, "double").alias("conf"))
    f = f.where("level = 5 and text <> '' and conf >= 0")
    return f.select(*keep, "line_no", "text", "x", "y", "width", "height", (F.col("conf") / 100).alias("confidence"))


def parse_windows_words(df: DataFrame, json: str = "json") -> DataFrame:
    """Words of a recogniser's JSON: {"words": [{"text", "x", "y", "width", "height"}]}."""
    keep = [c for c in df.columns if c != json]
    words = F.from_json(F.col(json), "struct<words: array<struct<text: string, x: double, y: double, width: double, height: double>>>")
    return df.select(*keep, F.posexplode(words["words"]).alias("word_index", "w")).select(*keep, "word_index", "w.*")


def otsu(pixels: DataFrame, image: list[str], value: str = "v") -> DataFrame:
    """image and threshold: the last t from 0 to 254 with the largest variance between the values up to t and those above."""
    counts = pixels.groupBy(*image, F.col(value).cast("int").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    # every t has a row, so that the last of equal variances is found
    all_t = counts.select(*image).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(255))))
    full = all_t.join(counts, [*image, "t"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    w = Window.partitionBy(*image).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*image)
    full = full.withColumn("wb", F.sum("n").over(w)).withColumn("sb", F.sum(F.col("n") * F.col("t")).over(w)).withColumn("total", F.sum("n").over(whole)).withColumn("st", F.sum(F.col("n") * F.col("t")).over(whole))
    wf = F.col("total") - F.col("wb")
    d = F.col("sb") / F.col("wb") - (F.col("st") - F.col("sb")) / wf
    var = F.when((F.col("wb") > 0) & (wf > 0), F.col("wb") * wf * d * d)
    rows = full.where("t < 255").withColumn("var", var)
    best = rows.groupBy(*image).agg(F.max(F.when(F.col("var").isNotNull(), F.struct("var", "t"))).alias("b"))
    return best.select(*image, F.coalesce(F.col("b.t"), F.lit(0)).alias("threshold"))


def enhance_contrast(pixels: DataFrame, image: list[str], value: str = "v") -> DataFrame:
    """pixels with column stretched: values spread from 0 to 255; an image of one value stays."""
    ext = pixels.groupBy(*image).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    out = pixels.join(ext, image)
    spread = F.round((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 255)
    return out.withColumn("stretched", F.when(F.col("__hi") - F.col("__lo") < 1, F.col(value)).otherwise(spread).cast("int")).drop("__lo", "__hi")


def binarize(value: Column, threshold: Column) -> Column:
    return F.when(value > threshold, 255).otherwise(0)


def widest_gap(words: DataFrame, page: list[str], start: str, end: str) -> DataFrame:
    """The widest gap of intervals along an axis: where the running maximum of ends is left behind. One step of the XY cut."""
    w = Window.partitionBy(*page).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = words.withColumn("__reach", F.max(end).over(w)).withColumn("gap", F.col(start) - F.col("__reach")).where("gap > 0")
    best = rows.groupBy(*page).agg(F.max(F.struct("gap", (-F.col("__reach")).alias("m"))).alias("b"))
    return best.select(*page, F.col("b.gap").alias("gap"), (-F.col("b.m")).alias("gap_start"))


def _cut(boxes: np.ndarray, depth: int) -> list[np.ndarray]:
    """Indices of the words of each region, in reading order. Regions at the depth limit stay whole."""

    def gap(lo: np.ndarray, hi: np.ndarray) -> tuple[int, int]:
        order = np.argsort(lo, kind="stable")
        reach = np.maximum.accumulate(hi[order])
        g = lo[order][1:] - reach[:-1]
        k = int(np.argmax(g)) if len(g) else -1
        return (int(g[k]), int(reach[k] + g[k] / 2)) if k >= 0 and g[k] > 0 else (0, 0)

    if not len(boxes):
        return []
    index = np.arange(len(boxes))
    if depth < DEPTH:
        v, at_x = gap(boxes[:, 0], boxes[:, 0] + boxes[:, 2])
        h, at_y = gap(boxes[:, 1], boxes[:, 1] + boxes[:, 3])
        if v >= V_GAP and v >= h:
            first = boxes[:, 0] + boxes[:, 2] / 2 < at_x
        elif h >= H_GAP:
            first = boxes[:, 1] + boxes[:, 3] / 2 < at_y
        else:
            first = None
        if first is not None and first.any() and not first.all():
            return [part[k] for part in (index[first], index[~first]) for k in _cut(boxes[part], depth + 1)]
    # rows of words, by anchor, then by x
    order = index[np.lexsort((boxes[:, 0], boxes[:, 1]))]
    rows, out = [], []
    for i in order:
        if rows and abs(boxes[i, 1] - boxes[rows[0], 1]) <= boxes[rows[0], 3] / 2:
            rows.append(i)
        else:
            out += sorted(rows, key=lambda k: boxes[k, 0])
            rows = [i]
    return [np.array(out + sorted(rows, key=lambda k: boxes[k, 0]))]


def reading_order(words: DataFrame, page: list[str]) -> DataFrame:
    """words (page, word_index, text, x, y, width, height) as regions: region number, reading order in it. A page is one group."""
    fields = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in page)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_index").reset_index(drop=True)
        regions = _cut(pdf[["x", "y", "width", "height"]].to_numpy(), 0)
        rows = [(r, k, i) for r, words_ in enumerate(regions) for k, i in enumerate(words_)]
        out = pdf.iloc[[i for _, _, i in rows]][[*page, "word_index", "text"]].copy()
        out["region"], out["position"] = [r for r, _, _ in rows], [k for _, k, _ in rows]
        return out

    index = words.schema["word_index"].dataType.simpleString()
    return words.groupBy(*page).applyInPandas(one, f"{fields}, word_index {index}, text string, region int, position int")


def to_gray(rgba: np.ndarray) -> np.ndarray:
    """8-bit luma (Rec. 709) of premultiplied RGBA; what is fully transparent is white."""
    a = rgba[..., 3].astype(float)
    rgb = np.where(a[..., None] > 0, rgba[..., :3] * 255.0 / np.maximum(a, 1)[..., None], 255.0).clip(0, 255)
    luma = rgb @ np.array([0.2126, 0.7152, 0.0722])
    return np.where(a > 0, np.round(luma), 255).astype(np.uint8)


def otsu_of(values: np.ndarray) -> int:
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    if not n.sum():
        return 128
    t = np.arange(256)
    wb, sb = np.cumsum(n), np.cumsum(n * t)
    wf = n.sum() - wb
    ok = (wb > 0) & (wf > 0) & (t < 255)
    if not ok.any():
        return 0
    var = np.full(256, -1.0)
    var[ok] = wb[ok] * wf[ok] * (sb[ok] / wb[ok] - (sb[-1] - sb[ok]) / wf[ok]) ** 2
    return int(np.flatnonzero(var == var.max())[-1])


def preprocess(gray: np.ndarray) -> np.ndarray:
    """Contrast stretched, then black and white."""
    lo, hi = (int(gray.min()), int(gray.max())) if gray.size else (0, 0)
    if hi - lo >= 1:
        gray = np.floor((gray.astype(float) - lo) / (hi - lo) * 255 + 0.5).astype(np.uint8)
    return np.where(gray > otsu_of(gray), 255, 0).astype(np.uint8)


def rotate(gray: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise, by a multiple of 90 degrees."""
    return np.rot90(gray, -(degrees // 90) % 4)


def recognize(images: DataFrame, engine: Callable[[np.ndarray], list[tuple[str, int, int, int, int, float]]], page: list[str]) -> DataFrame:
    """Words of images (page, width, height, pixels) by an engine: a function from a grey raster to (text, x, y, width, height, confidence)."""
    fields = ", ".join(f"{c} {images.schema[c].dataType.simpleString()}" for c in page)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                raster = np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)
                for k, word in enumerate(engine(raster)):
                    out.append([*[getattr(row, c) for c in page], k, *word])
            yield pd.DataFrame(out, columns=[*page, "word_index", "text", "x", "y", "width", "height", "confidence"])

    return images.mapInPandas(run, f"{fields}, word_index int, text string, x int, y int, width int, height int, confidence double")
