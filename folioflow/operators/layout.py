"""Page layout: lines, font statistics, headings, lists, code, tables, running headers, labels and captions.

The input is a table of text runs (doc_id, page_index, run_index, text, font_name, font_size, x, y, width, height, is_bold, is_italic,
is_monospaced, rendering_mode). Every operator works by page, so one exchange by (doc_id, page_index) serves them all; a page is a bounded
group. Steps whose result depends on an anchor (lines, tables) are folds over a page's sorted runs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import font_style, is_caption, list_marker, normalize_for_repeat, starts_list, strip, style_of

PAGE = ["doc_id", "page_index"]
#: Runs whose y is so near to that of a line's first run are on that line.
LINE_TOLERANCE = 2.0
HEADING_SIZE, HEADING_GAP = 1.2, 1.5
COLUMN_TOLERANCE = 3.0
MARGIN = 0.1


def anchored(values: Column, tolerance: float) -> Column:
    """For an array of falling numbers the group of each, from 1: a group goes on while values are within tolerance of its first one."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("no"), *_numbers())

    def step(acc: Column, v: Column) -> Column:
        same = acc["anchor"].isNotNull() & (F.abs(acc["anchor"] - v) <= tolerance)
        no = F.when(same, acc["no"]).otherwise(acc["no"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(v).alias("anchor"), no.alias("no"), *_numbers(acc, no))

    return F.aggregate(values, start, step, _all_numbers)


#: Numbers in one piece of a fold's result. An array is copied for each number that is added, so a long one grows by pieces.
PIECE = 128


def _numbers(acc: Column | None = None, no: Column | None = None) -> list[Column]:
    """Two fields of a fold's state, the whole pieces and the last one: empty, or those of acc and one number more."""
    if acc is None:
        return [F.array().cast("array<array<int>>").alias("whole"), F.array().cast("array<int>").alias("piece")]
    full = F.size(acc["piece"]) >= PIECE
    piece = F.when(full, F.array(no)).otherwise(F.array_append(acc["piece"], no))
    return [F.when(full, F.array_append(acc["whole"], acc["piece"])).otherwise(acc["whole"]).alias("whole"), piece.alias("piece")]


def _all_numbers(acc: Column) -> Column:
    return F.flatten(F.array_append(acc["whole"], acc["piece"]))


def _pages(runs: DataFrame, page: list[str], order: str, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """A row for each page: its runs from the top down (rs), and the number of each one's line (nos)."""
    kept = [c for c in runs.columns if c not in page]
    pages = runs.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("__down"), F.col("x").alias("__x"), F.col(order).alias("__o"), F.struct(*kept).alias("r")))).alias("rs"))
    return pages.withColumn("nos", anchored(F.transform("rs", lambda r: -r["__down"]), tolerance))


def _runs_of(pages: DataFrame, page: list[str], order: str, *more: str) -> DataFrame:
    """The runs of _pages, with line_no (from 1, top first) and line_y, the y of the line's first run."""
    rows = pages.select(*page, *more, F.explode(F.arrays_zip(F.col("rs.r").alias("r"), F.col("nos").alias("no"))).alias("z"))
    rows = rows.select(*page, *more, "z.r.*", F.col("z.no").alias("line_no"))
    first = F.first("y").over(Window.partitionBy(*page, "line_no").orderBy(F.col("y").desc(), "x", order))
    return rows.withColumn("line_y", first)


def group_lines(runs: DataFrame, page: list[str] = PAGE, order: str = "run_index", tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """runs with line_no (from 1, top first) and line_y, the y of the line's first run."""
    return _runs_of(_pages(runs, page, order, tolerance), page, order)


def lines(runs: DataFrame, page: list[str] = PAGE, order: str = "run_index") -> DataFrame:
    """A row for each line: its runs by x, its y, and its extent."""
    return _lines_of(_pages(runs, page, order), runs.columns, page, order)


def _lines_of(pages: DataFrame, columns: list[str], page: list[str], order: str, *more: str) -> DataFrame:
    with_lines = _runs_of(pages, page, order, *more)
    kept = [c for c in columns if c not in page]
    members = F.sort_array(F.collect_list(F.struct(F.col("x").alias("__x"), F.col(order).alias("__o"), F.struct(*kept).alias("r"))))
    out = with_lines.groupBy(*page, "line_no").agg(
        F.first("line_y").alias("y"), members.alias("ms"), F.min("x").alias("min_x"), F.max(F.col("x") + F.col("width")).alias("max_x"),
        F.min("y").alias("min_y"), F.max(F.col("y") + F.col("height")).alias("max_y"), *[F.first(c).alias(c) for c in more],
    )
    return out.select(*page, "line_no", "y", "min_x", "max_x", F.col("ms.r").alias("runs"), F.struct(F.col("min_x").alias("x"), F.col("min_y").alias("y"), (F.col("max_x") - F.col("min_x")).alias("width"), (F.col("max_y") - F.col("min_y")).alias("height")).alias("bbox"), *more)


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array, rounded down; null of an empty one."""
    s = F.sort_array(values)
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def most_frequent(values: Column, kind: str) -> Column:
    """The most frequent element of an array of a type, of several the least: one pass over the sorted array, however many differ."""
    none = F.lit(None).cast(kind)
    start = F.struct(none.alias("now"), F.lit(0).alias("n"), none.alias("best"), F.lit(0).alias("most"))

    def step(acc: Column, v: Column) -> Column:
        n = F.when((acc["n"] > 0) & acc["now"].eqNullSafe(v), acc["n"] + 1).otherwise(1)
        more = n > acc["most"]
        return F.struct(v.alias("now"), n.alias("n"), F.when(more, v).otherwise(acc["best"]).alias("best"), F.greatest(n, acc["most"]).alias("most"))

    return F.aggregate(F.sort_array(values), start, step, lambda acc: acc["best"])


STATS = ["body_size", "body_font", "body_bold", "median_spacing"]


def _with_stats(pages: DataFrame) -> DataFrame:
    """_pages with the font statistics of each, from its array of runs: a page is read once, and nothing is joined."""
    doubled = lambda r: F.greatest(F.round(r["r"]["font_size"] * 2), F.lit(0.0))
    pages = pages.withColumn("__size", most_frequent(F.transform("rs", doubled), "double"))
    pages = pages.withColumn("__body", F.filter("rs", lambda r: doubled(r).eqNullSafe(F.col("__size"))))
    bold = F.size(F.filter("__body", lambda r: r["r"]["is_bold"]))
    starts = F.filter(F.transform("rs", lambda r, i: F.when((i == 0) | (F.get("nos", i) != F.get("nos", i - 1)), -r["__down"])), lambda y: y.isNotNull())
    pages = pages.withColumn("__ys", F.sort_array(starts, asc=False)).withColumn("body_size", F.col("__size") / 2)
    gaps = F.zip_with(F.slice("__ys", F.lit(1), F.greatest(F.size("__ys") - 1, F.lit(0))), F.slice("__ys", F.lit(2), F.size("__ys")), lambda a, b: F.abs(a - b))
    spacing = upper_median(F.filter(gaps, lambda g: (g > 0.1) & (g < F.col("body_size") * 5)))
    pages = pages.withColumn("body_font", most_frequent(F.transform("__body", lambda r: r["r"]["font_name"]), "string")).withColumn("body_bold", bold > F.floor(F.size("__body") / 2))
    return pages.withColumn("median_spacing", F.coalesce(spacing, F.col("body_size") * 1.2)).drop("__size", "__body", "__ys")


def font_stats(runs: DataFrame, page: list[str] = PAGE, order: str = "run_index") -> DataFrame:
    """A row for each page: body_size, body_font, body_bold and median_spacing. Of equally frequent sizes or names the smaller is the body's."""
    return _with_stats(_pages(runs, page, order)).select(*page, *STATS)


def blocks(runs: DataFrame, page: list[str] = PAGE, order: str = "run_index") -> DataFrame:
    """A block for each line with its role (Heading, Paragraph, ListItem, Code), level and place."""
    return classify(_lines_of(_with_stats(_pages(runs, page, order)), runs.columns, page, order, *STATS), page)


def classify(joined: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Roles of lines (with runs) that carry their page's font statistics."""
    ordered = Window.partitionBy(*page).orderBy("line_no")
    gap = F.abs(F.lag("y").over(ordered) - F.col("y"))
    rows = joined.withColumn("top_size", F.greatest(F.array_max(F.transform("runs", lambda r: r["font_size"])), F.lit(0.0)))
    rows = rows.withColumn("any_bold", F.exists("runs", lambda r: r["is_bold"])).withColumn("far", F.coalesce(gap > F.col("median_spacing") * HEADING_GAP, F.lit(False)))
    heading = (F.col("top_size") > F.col("body_size") * HEADING_SIZE) | (F.col("any_bold") & ~F.col("body_bold") & (F.col("far") | (F.col("top_size") > F.col("body_size"))))
    rows = rows.withColumn("heading", heading).withColumn("tenths", F.when(heading, F.floor(F.col("top_size") * 10)))
    # headings come first in the ranking, so their dense rank is not moved by the others
    rank = F.dense_rank().over(Window.partitionBy(*page).orderBy(F.col("tenths").desc_nulls_last()))
    text = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    mono = F.forall("runs", lambda r: r["is_monospaced"]) & ~font_style(F.col("body_font"))["monospaced"]
    role = F.when(F.col("heading"), "Heading").when(list_marker(text).isNotNull(), "ListItem").when(mono, "Code").otherwise("Paragraph")
    rows = rows.withColumn("role", role).withColumn("level", F.when(F.col("heading"), F.least(rank, F.lit(6))))
    return rows.select(*page, F.col("line_no").alias("block_no"), "role", "level", F.col("min_x").alias("indent"), "bbox", "runs", "y")


def _above(a: float, b: float) -> bool:
    """a > b as Spark has it, with NaN above all numbers."""
    return a > b or (a != a and b == b)


def _rising(v: float) -> tuple[bool, float]:
    return (True, 0.0) if v != v else (False, v)


def _halves(size: float) -> float:
    """A font size in half points, rounded half up, 0 at least."""
    if size != size:
        return math.nan  # one object, so that counting finds it equal
    v = size * 2
    return v if math.isinf(v) and v > 0 else 0.0 if v <= 0 else math.floor(v) + float(v - math.floor(v) >= 0.5)


def page_blocks(runs: list[dict]) -> list[tuple[str, int | None, list[dict]]]:
    """(role, level, runs by x) of the lines of one page, top first: what blocks() gives, for a stage that runs in Python from file to result.

    runs are those of the page in their order, with text, font_name, font_size, x and y.
    """
    if not runs:
        return []
    found: list[list[dict]] = []
    anchor = math.nan
    numbers = all(r["y"] == r["y"] and r["x"] == r["x"] for r in runs)
    for r in sorted(runs, key=(lambda r: (-r["y"], r["x"])) if numbers else (lambda r: (*_rising(-r["y"]), *_rising(r["x"])))):
        if abs(anchor - r["y"]) <= LINE_TOLERANCE:
            found[-1].append(r)
        else:
            found.append([r])
            anchor = r["y"]
    ys = [rs[0]["y"] for rs in found]
    # font statistics
    each = [_halves(r["font_size"]) for r in runs]
    halves = Counter(each)
    size = min(halves, key=lambda h: (-halves[h], *_rising(h)))
    body_size = size / 2
    body = [r for r, h in zip(runs, each, strict=True) if h is size or h == size] if len(halves) > 1 else runs
    names = Counter(r["font_name"] for r in body)
    font = min(names, key=lambda f: (-names[f], f is not None, f or ""))
    body_bold = sum(style_of(r["font_name"])[0] for r in body) > len(body) // 2
    gaps = sorted(g for a, b in zip(ys, ys[1:], strict=False) if (g := abs(a - b)) > 0.1 and _above(body_size * 5, g))
    far = (gaps[len(gaps) // 2] if gaps else body_size * 1.2) * HEADING_GAP
    # roles
    out: list[tuple[str, int | None, list[dict]]] = []
    tops: list[int | None] = []
    for k, rs in enumerate(found):
        if len(rs) > 1:
            rs = [r for _, r in sorted(enumerate(rs), key=lambda p: (*_rising(p[1]["x"]), p[1]["run_index"] if "run_index" in p[1] else p[0]))]
        styles = [style_of(r["font_name"]) for r in rs]
        top = max((r["font_size"] for r in rs), key=_rising) if len(rs) > 1 else rs[0]["font_size"]
        top = top if _above(top, 0.0) else 0.0
        heading = _above(top, body_size * HEADING_SIZE) or (any(s[0] for s in styles) and not body_bold and ((k > 0 and _above(abs(ys[k - 1] - ys[k]), far)) or _above(top, body_size)))
        tops.append(min(math.floor(top * 10), 2**63 - 1) if heading and math.isfinite(top * 10) else (0 if top != top else 2**63 - 1) if heading else None)
        if heading:
            role = "Heading"
        elif starts_list("".join(r["text"] for r in rs)):
            role = "ListItem"
        else:
            role = "Code" if all(s[2] for s in styles) and not style_of(font)[2] else "Paragraph"
        out.append((role, None, rs))
    ranks = {t: min(k, 6) for k, t in enumerate(sorted({t for t in tops if t is not None}, reverse=True), 1)}
    return [(role, ranks[t], rs) if t is not None else (role, None, rs) for (role, _, rs), t in zip(out, tops, strict=True)] if ranks else out


def tables(blocks_: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """A row for each table: neighbouring paragraphs whose runs start at the x positions of the first one's, two or more of each."""
    rows = blocks_.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("block_no", F.col("role").alias("role"), F.transform("runs", lambda r: r["x"]).alias("xs"), "bbox"))).alias("bs"))
    start = F.struct(F.lit(0).alias("no"), F.lit(False).alias("open"), F.array().cast("array<double>").alias("xs"), *_numbers())

    def step(acc: Column, b: Column) -> Column:
        able = (b["role"] == "Paragraph") & (F.size(b["xs"]) >= 2)
        fits = acc["open"] & able & (F.size(acc["xs"]) == F.size(b["xs"])) & F.forall(F.zip_with(acc["xs"], b["xs"], lambda p, q: F.abs(p - q) < COLUMN_TOLERANCE), lambda z: z)
        no = F.when(fits, acc["no"]).otherwise(acc["no"] + 1)
        return F.struct(no.alias("no"), able.alias("open"), F.when(fits, acc["xs"]).otherwise(b["xs"]).alias("xs"), *_numbers(acc, F.when(able, no)))

    rows = rows.withColumn("nos", F.aggregate("bs", start, step, _all_numbers))
    each = rows.select(*page, F.explode(F.arrays_zip(F.col("bs"), F.col("nos").alias("no"))).alias("z")).where("z.no is not null")
    out = each.groupBy(*page, F.col("z.no").alias("group")).agg(
        F.min("z.bs.block_no").alias("first_block"), F.count(F.lit(1)).alias("n_rows"), F.min_by(F.col("z.bs.xs"), F.col("z.bs.block_no")).alias("column_xs"),
        F.min("z.bs.bbox.x").alias("x"), F.min("z.bs.bbox.y").alias("y"), F.max(F.col("z.bs.bbox.x") + F.col("z.bs.bbox.width")).alias("right"), F.max(F.col("z.bs.bbox.y") + F.col("z.bs.bbox.height")).alias("top"),
    )
    out = out.where("n_rows >= 2")
    return out.select(*page, "first_block", F.col("n_rows").cast("int").alias("n_rows"), F.size("column_xs").alias("n_columns"), "column_xs", F.struct("x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("top") - F.col("y")).alias("height")).alias("bbox"))


def headers_footers(lined: DataFrame, page_height: Column | float, doc: str = "doc_id", page_order: str = "page_index") -> DataFrame:
    """Texts that stand twice or more in the upper or lower tenth of a document's pages, digits as #. Counts are of lines, and y is the first's."""
    height = page_height if isinstance(page_height, Column) else F.lit(float(page_height))
    text = strip(F.array_join(F.transform("runs", lambda r: r["text"]), " "))
    rows = lined.withColumn("__t", text).where("__t <> ''").withColumn("text", normalize_for_repeat(F.col("__t")))
    zones = F.filter(F.array(F.when(F.col("y") > height - height * MARGIN, F.lit("header")), F.when(F.col("y") < height * MARGIN, F.lit("footer"))), lambda z: z.isNotNull())
    rows = rows.select(doc, page_order, "line_no", "y", "text", F.explode(zones).alias("zone"))
    out = rows.groupBy(doc, "zone", "text").agg(F.count(F.lit(1)).alias("n"), F.min_by("y", F.struct(page_order, "line_no")).alias("y"))
    # a document of one page has no running lines
    several = lined.groupBy(doc).agg((F.min(page_order) != F.max(page_order)).alias("several")).where("several").select(doc)
    return out.where("n >= 2").join(several, doc, "left_semi")


def _banded(owners: DataFrame, spans: list[tuple[Column, Column]], points: DataFrame, places: list[Column], page: list[str]) -> DataFrame:
    """Owners with the points of their page that may lie in a span of theirs: for each k the place places[k] of a point from the low to the high
    end of spans[k]. All such pairs are there, and few others.

    An axis is cut in bands, as high as the power of two from a span's length on: a span lies in two or three, a place in one for each of the
    heights that its page has. What has no finite span shares one band with all.
    """
    lo, hi = F.col("__s.lo"), F.col("__s.hi")
    o = owners.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), a.cast("double").alias("lo"), b.cast("double").alias("hi")) for k, (a, b) in enumerate(spans)]))).where(lo <= hi)
    size = F.greatest(hi - lo, F.abs(lo) * 1e-6, F.abs(hi) * 1e-6, F.lit(1e-3))
    finite = size < 1e300
    unit = F.pow(F.lit(2.0), F.col("__level"))
    o = o.withColumn("__kind", F.col("__s.kind")).withColumn("__level", F.when(finite, F.ceil(F.log2(size)).cast("int")).otherwise(9999))
    # wider than rounding can move an end
    bands = F.sequence(F.floor(lo / unit - 1e-5), F.floor(hi / unit + 1e-5))
    o = o.withColumn("__band", F.explode(F.when(F.col("__level") < 9999, bands).otherwise(F.array(F.lit(0).cast("long"))))).drop("__s")
    p = points.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), a.cast("double").alias("at")) for k, a in enumerate(places)]))).withColumn("__kind", F.col("__s.kind"))
    p = p.join(o.select(*page, "__kind", "__level").distinct(), [*page, "__kind"])
    p = p.withColumn("__band", F.when(F.col("__level") < 9999, F.floor(F.col("__s.at") / unit)).otherwise(F.lit(0).cast("long"))).drop("__s")
    return o.join(p, [*page, "__kind", "__level", "__band"]).drop("__kind", "__level", "__band")


def _nearest(of: DataFrame, named: list[str], pairs: Callable[[DataFrame], DataFrame], ties: list[str]) -> DataFrame:
    """of with b, the pair of least distance, then of least ties: places that occur several times are looked at once.

    named are the columns of `of` besides its place; pairs gives pairs with distance for a table of places. The least distance is found first,
    as a number, so that only pairs that have it are held with their texts.
    """
    place = [c for c in of.columns if c not in named]
    places = of.select(*place).distinct()
    least = pairs(places).groupBy(*place).agg(F.min("distance").alias("__least"))
    found = pairs(least).where("distance <= __least").groupBy(*place).agg(F.min(F.struct("distance", *ties)).alias("b"))
    return of.join(found, place)


def field_labels(runs: DataFrame, fields: DataFrame, page: list[str] = PAGE, order: str = "run_index") -> DataFrame:
    """The nearest text left of a field, on its line, or right above it. fields: page, field_name, x, y, width, height. Fields without one go."""
    f = fields.select(*page, "field_name", *[F.col(c).alias(f"f_{c}") for c in ("x", "y", "width", "height")])
    # of runs at one place the first
    r = runs.withColumn("label", strip(F.col("text"))).where("label <> ''").groupBy(*page, "x", "y", "width", "height").agg(F.min(F.struct(F.col(order).alias("o"), "label")).alias("__r"))
    r = r.select(*page, "x", "y", "width", "height", "__r.o", "__r.label")
    x, y, width, height, f_x, f_y, f_width, f_height = (F.col(c) for c in ("x", "y", "width", "height", "f_x", "f_y", "f_width", "f_height"))
    right, middle, f_middle = x + width, y + height / 2, f_y + f_height / 2
    left_dist = f_x - right
    is_left = (F.abs(middle - f_middle) < height * 1.5) & (right < f_x + 5) & (left_dist >= 0)
    above_dist = y - f_y
    is_above = (y > f_y) & (F.abs(x - f_x) < f_width) & (above_dist < height * 3)
    dist = F.least(F.when(is_left, left_dist), F.when(is_above, above_dist))
    spans = [(middle - height * 1.5, middle + height * 1.5), (y - height * 3, y)]

    def pairs(places: DataFrame) -> DataFrame:
        return _banded(r, spans, places, [f_middle, f_y], page).withColumn("distance", dist).where("distance is not null")

    best = _nearest(f, ["field_name"], pairs, ["o", "label"]).groupBy(*page, "field_name").agg(F.min("b").alias("b"))
    return best.select(*page, "field_name", "b.label", "b.distance")


def figure_captions(lined: DataFrame, images: DataFrame, stats: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """The nearest caption line under or over an image, within two body sizes and overlapping in x."""
    i = images.select(*page, "image_name", *[F.col(c).alias(f"i_{c}") for c in ("x", "y", "width", "height")]).join(stats.select(*page, "body_size"), page)
    text = strip(F.array_join(F.transform("runs", lambda r: r["text"]), " "))
    c = lined.withColumn("caption", text).where(is_caption(F.col("caption"))).groupBy(*page, F.col("y").alias("caption_y"), "min_x", "max_x").agg(F.min(F.struct("line_no", "caption")).alias("__c"))
    c = c.select(*page, "caption_y", "min_x", "max_x", "__c.line_no", "__c.caption")
    y, top, body, caption_y = F.col("i_y"), F.col("i_y") + F.col("i_height"), F.col("body_size"), F.col("caption_y")
    dist = F.least(F.abs(y - caption_y), F.abs(caption_y - top))
    near = (F.col("distance") < body * 2) & (F.col("min_x") < F.col("i_x") + F.col("i_width")) & (F.col("max_x") > F.col("i_x"))

    def pairs(places: DataFrame) -> DataFrame:
        return _banded(places, [(y - body * 2, y + body * 2), (top - body * 2, top + body * 2)], c, [caption_y, caption_y], page).withColumn("distance", dist).where(near)

    best = _nearest(i, ["image_name"], pairs, ["line_no", "caption", "caption_y"]).groupBy(*page, "image_name").agg(F.min("b").alias("b"))
    return best.select(*page, "image_name", "b.caption", "b.caption_y")
