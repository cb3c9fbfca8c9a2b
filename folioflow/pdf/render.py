"""Pages as rasters, in numpy: paths, strokes, clips, text boxes, images, shadings, patterns, groups, soft masks and blend modes.

Coverage is exact along x and sampled four times along y. Glyphs are boxes of the estimated advance, as no outlines are read. Clips intersect.
Forms are drawn to a depth limit.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np

from folioflow.pdf import content, filters
from folioflow.pdf.colors import BLEND, Function, Space, blend_mode, luminosity
from folioflow.pdf.content import IDENTITY, concat
from folioflow.pdf.document import Document
from folioflow.pdf.images import to_rgba
from folioflow.pdf.syntax import Name, PdfError, Stream, Text, number_of, rect_of

SAMPLES, CURVE, FORMS = 4, 12, 12
#: Cells of a tiling pattern that are drawn one by one; more are repeated from one period.
FEW_CELLS = 16


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def inverse(m: tuple) -> tuple | None:
    a, b, c, d, e, f = m
    det = a * d - b * c
    return None if abs(det) < 1e-12 else (d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)


def coverage(polygons: list[list[tuple[float, float]]], width: int, height: int, even_odd: bool = False) -> np.ndarray:
    """The share of each pixel that polygons cover."""
    out = np.zeros((height, width + 1))
    edges = [(x0, y0, x1, y1) for p in polygons for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1], strict=True) if y0 != y1]
    if not edges or not width or not height:
        return out[:, :width]
    e = np.array(edges)
    up = np.where(e[:, 3] > e[:, 1], 1, -1)
    lo, hi = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first, last = max(0, int(np.floor(lo.min() * SAMPLES))), min(height * SAMPLES, int(np.ceil(hi.max() * SAMPLES)))
    for k in range(first, last):
        y = (k + 0.5) / SAMPLES
        on = np.flatnonzero((lo <= y) & (hi > y))
        if len(on) < 2:
            continue
        xs = e[on, 0] + (y - e[on, 1]) * (e[on, 2] - e[on, 0]) / (e[on, 3] - e[on, 1])
        order = np.argsort(xs, kind="stable")
        xs, turns = np.clip(xs[order], 0, width), np.cumsum(up[on][order])
        inside = np.arange(1, len(xs) + 1) % 2 == 1 if even_odd else turns != 0
        row = out[k // SAMPLES]
        for j in np.flatnonzero(inside[:-1]):
            a, b = xs[j], xs[j + 1]
            if b <= a:
                continue
            i, n = int(a), int(b)
            if i == n:
                row[i] += b - a
            else:
                row[i] += i + 1 - a
                row[i + 1 : n] += 1
                row[n] += b - n
    return np.clip(out[:, :width] / SAMPLES, 0, 1)


def stroke_polygons(paths: list[tuple[list, bool]], width: float) -> list[list]:
    """A box along each segment, with square joins."""
    h, out = max(width, 0.7) / 2, []
    for points, closed in paths:
        pts = points + points[:1] if closed else points
        for (x0, y0), (x1, y1) in zip(pts, pts[1:], strict=False):
            n = float(np.hypot(x1 - x0, y1 - y0))
            if n < 1e-9:
                continue
            ux, uy = (x1 - x0) / n * h, (y1 - y0) / n * h
            box = [(x0 - uy - ux * closed, y0 + ux - uy * closed), (x1 - uy + ux * closed, y1 + ux + uy * closed), (x1 + uy + ux * closed, y1 - ux + uy * closed), (x0 + uy - ux * closed, y0 - ux - uy * closed)]
            out.append(box)
    return out


@dataclass
class State:
    ctm: tuple = IDENTITY
    fill: object = field(default_factory=lambda: np.zeros(3))
    stroke: object = field(default_factory=lambda: np.zeros(3))
    fill_space: object = None
    stroke_space: object = None
    width: float = 1.0
    dash: tuple = ((), 0.0)
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    mode: str = "Normal"
    clip: object = None
    mask: object = None
    font: str = ""
    size: float = 0.0
    tc: float = 0.0
    tw: float = 0.0
    tz: float = 1.0
    tl: float = 0.0
    rise: float = 0.0
    render: int = 0


class Canvas:
    """Premultiplied colour and alpha. zoom: pixels of this canvas along one of the page."""

    def __init__(self, width: int, height: int, background=None, zoom: int = 1):
        self.width, self.height, self.zoom = width, height, zoom
        self.rgb, self.alpha = np.zeros((height, width, 3)), np.zeros((height, width))
        if background is not None:
            self.rgb[:], self.alpha[:] = background, 1.0

    def paint(self, cover: np.ndarray, color: np.ndarray, s: State, alpha: float) -> None:
        """Colour (one, or one for each pixel) where there is coverage, through clip and mask."""
        a = cover * alpha
        for m in (s.clip, s.mask):
            if m is not None:
                a = a * m
        if not a.any():
            return
        back = np.where(self.alpha[..., None] > 0, self.rgb / np.maximum(self.alpha[..., None], 1e-9), 0)
        color = np.broadcast_to(color, self.rgb.shape)
        mixed = color if s.mode == "Normal" else (1 - self.alpha[..., None]) * color + self.alpha[..., None] * BLEND[s.mode](back, color)
        self.rgb = self.rgb * (1 - a[..., None]) + mixed * a[..., None]
        self.alpha = self.alpha + a - self.alpha * a


class Renderer:
    def __init__(self, doc: Document, canvas: Canvas, base: tuple):
        self.doc, self.canvas, self.s = doc, canvas, State(ctm=base)
        self.stack: list[State] = []

    def resource(self, res, kind: str, name):
        return self.doc.resolve((self.doc.get(res, kind) or {}).get(str(name)))

    def run(self, data: bytes, res, depth: int = 0) -> None:
        doc, paths, point, clip_next = self.doc, [], (0.0, 0.0), None
        tm = line = IDENTITY
        fonts = doc.fonts({"Resources": res}) if res else {}
        spaces = doc.get(res, "ColorSpace")

        def to(x: float, y: float) -> tuple[float, float]:
            return apply(self.s.ctm, x, y)

        def polygons() -> list:
            return [p for p, _ in paths if len(p) > 1]

        def fill(even_odd: bool) -> None:
            self.fill_area(coverage(polygons(), self.canvas.width, self.canvas.height, even_odd), self.s.fill, self.s.fill_alpha, depth)

        def stroke() -> None:
            scale = abs(self.s.ctm[0] * self.s.ctm[3] - self.s.ctm[1] * self.s.ctm[2]) ** 0.5
            parts = self.dashed(paths, scale) if self.s.dash[0] else paths
            self.fill_area(coverage(stroke_polygons(parts, max(self.s.width * scale, 0.7 * self.canvas.zoom)), self.canvas.width, self.canvas.height), self.s.stroke, self.s.stroke_alpha, depth)

        def show(b: bytes) -> None:
            nonlocal tm
            s, f = self.s, fonts.get(self.s.font)
            text = f.text(b) if f else b.decode("latin-1")
            boxes, x = [], 0.0
            for c in text:
                w = s.size * 0.5 * s.tz
                if not c.isspace():
                    m = concat(tm, s.ctm)
                    boxes.append([apply(m, px, py) for px, py in ((x + w * 0.1, s.rise), (x + w * 0.9, s.rise), (x + w * 0.9, s.rise + s.size * 0.7), (x + w * 0.1, s.rise + s.size * 0.7))])
                x += w + s.tc + (s.tw if c == " " else 0)
            if boxes and s.render not in (3, 7):
                self.fill_area(coverage(boxes, self.canvas.width, self.canvas.height), s.fill if s.render in (0, 2, 4, 6) else s.stroke, s.fill_alpha, depth)
            tm = concat((1, 0, 0, 1, x, 0), tm)

        for op, a in content.tokens(data):
            n = [number_of(v) or 0.0 for v in a]
            s = self.s
            if op == "q":
                self.stack.append(copy.copy(s))
            elif op == "Q":
                self.s = self.stack.pop() if self.stack else s
            elif op == "cm" and len(a) >= 6:
                s.ctm = concat(tuple(n[:6]), s.ctm)
            elif op == "w" and a:
                s.width = n[0]
            elif op == "d" and a and isinstance(a[0], list):
                s.dash = (tuple(number_of(v) or 0.0 for v in a[0]), n[1] if len(n) > 1 else 0.0)
            elif op == "gs" and a:
                self.ext_state(self.resource(res, "ExtGState", a[0]), depth)
            elif op == "m" and len(n) >= 2:
                point = (n[0], n[1])
                paths.append(([to(*point)], False))
            elif op == "l" and len(n) >= 2 and paths:
                point = (n[0], n[1])
                paths[-1][0].append(to(*point))
            elif op in ("c", "v", "y") and len(n) >= 4 and paths:
                p1, p2, p3 = {"c": lambda: (n[0:2], n[2:4], n[4:6]), "v": lambda: (point, n[0:2], n[2:4]), "y": lambda: (n[0:2], n[2:4], n[2:4])}[op]()
                if len(p3) < 2:
                    continue
                for t in np.linspace(0, 1, CURVE + 1)[1:]:
                    w = ((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3)
                    paths[-1][0].append(to(sum(k * p[0] for k, p in zip(w, (point, p1, p2, p3), strict=True)), sum(k * p[1] for k, p in zip(w, (point, p1, p2, p3), strict=True))))
                point = (p3[0], p3[1])
            elif op == "re" and len(n) >= 4:
                x, y, w, h = n[:4]
                paths.append(([to(x, y), to(x + w, y), to(x + w, y + h), to(x, y + h)], True))
                point = (x, y)
            elif op == "h" and paths:
                paths[-1] = (paths[-1][0], True)
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if op in ("s", "b", "b*") and paths:
                    paths[-1] = (paths[-1][0], True)
                if op in ("f", "F", "f*", "B", "B*", "b", "b*"):
                    fill(op.endswith("*"))
                if op in ("S", "s", "B", "B*", "b", "b*"):
                    stroke()
                if clip_next is not None:
                    c = coverage(polygons(), self.canvas.width, self.canvas.height, clip_next)
                    s.clip = c if s.clip is None else np.minimum(s.clip, c)
                paths, clip_next = [], None
            elif op in ("W", "W*"):
                clip_next = op == "W*"
            elif op in ("g", "G", "rg", "RG", "k", "K"):
                space = Space(Name({"g": "DeviceGray", "rg": "DeviceRGB", "k": "DeviceCMYK"}[op.lower()]), doc.resolve)
                if len(n) >= space.n:
                    self.set_color(op.isupper(), space, space.rgb(np.array(n[: space.n])))
            elif op in ("cs", "CS") and a:
                try:
                    space = None if a[0] == "Pattern" else Space(a[0], doc.resolve, spaces)
                except (PdfError, IndexError, TypeError):
                    space = None
                self.set_color(op == "CS", space, np.zeros(3))
            elif op in ("sc", "scn", "SC", "SCN") and a:
                up = op.isupper()
                if isinstance(a[-1], Name):
                    self.set_color(up, None, self.resource(res, "Pattern", a[-1]))
                else:
                    space = (s.stroke_space if up else s.fill_space) or Space(Name({1: "DeviceGray", 4: "DeviceCMYK"}.get(len(n), "DeviceRGB")), doc.resolve)
                    if len(n) >= space.n:
                        self.set_color(up, space, space.rgb(np.array(n[: space.n])))
            elif op == "BT":
                tm = line = IDENTITY
            elif op == "Tf" and len(a) >= 2:
                s.font, s.size = str(a[0]), n[1]
            elif op in ("Td", "TD") and len(n) >= 2:
                s.tl = -n[1] if op == "TD" else s.tl
                tm = line = concat((1, 0, 0, 1, n[0], n[1]), line)
            elif op == "Tm" and len(n) >= 6:
                tm = line = tuple(n[:6])
            elif op == "T*":
                tm = line = concat((1, 0, 0, 1, 0, -s.tl), line)
            elif op in ("Tc", "Tw", "TL", "Ts", "Tz", "Tr") and n:
                setattr(s, {"Tc": "tc", "Tw": "tw", "TL": "tl", "Ts": "rise", "Tz": "tz", "Tr": "render"}[op], n[0] / 100 if op == "Tz" else int(n[0]) if op == "Tr" else n[0])
            elif op in ("Tj", "'", '"') and a and isinstance(a[-1], Text):
                if op == '"' and len(a) >= 3:
                    s.tw, s.tc = n[0], n[1]
                if op != "Tj":
                    tm = line = concat((1, 0, 0, 1, 0, -s.tl), line)
                show(a[-1])
            elif op == "TJ" and a and isinstance(a[-1], list):
                for item in a[-1]:
                    if isinstance(item, Text):
                        show(item)
                    elif (v := number_of(item)) is not None:
                        tm = concat((1, 0, 0, 1, -v / 1000 * s.size * s.tz, 0), tm)
            elif op == "Do" and a:
                self.draw(self.resource(res, "XObject", a[0]), res, depth)
            elif op == "BI":
                long = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "IM": "ImageMask", "D": "Decode", "DP": "DecodeParms"}
                self.image(Stream({long.get(k, k): v for k, v in a[0].items()}, a[1]), spaces)
            elif op == "sh" and a:
                self.shade(self.resource(res, "Shading", a[0]), np.ones((self.canvas.height, self.canvas.width)), s.ctm, s.fill_alpha)

    def set_color(self, stroke: bool, space, color) -> None:
        if stroke:
            self.s.stroke_space, self.s.stroke = space, color
        else:
            self.s.fill_space, self.s.fill = space, color

    def dashed(self, paths: list, scale: float) -> list:
        """Paths cut by the dash pattern."""
        lengths, phase = [max(v * scale, 1e-3) for v in self.s.dash[0]], self.s.dash[1] * scale
        out = []
        for points, closed in paths:
            k, left = 0, lengths[0]
            skip = phase % max(sum(lengths), 1e-3)
            while skip >= left:
                skip -= left
                k += 1
                left = lengths[k % len(lengths)]
            left -= skip
            pts = points + points[:1] if closed else points
            for (x0, y0), (x1, y1) in zip(pts, pts[1:], strict=False):
                n, at = float(np.hypot(x1 - x0, y1 - y0)), 0.0
                while n - at > 1e-9:
                    step = min(left, n - at)
                    if k % 2 == 0:
                        out.append(([(x0 + (x1 - x0) * t / n, y0 + (y1 - y0) * t / n) for t in (at, at + step)], False))
                    at, left = at + step, left - step
                    if left <= 1e-9:
                        k += 1
                        left = lengths[k % len(lengths)]
        return out

    def ext_state(self, gs, depth: int) -> None:
        if not isinstance(gs, dict):
            return
        get, s = lambda k: self.doc.get(gs, k), self.s
        s.fill_alpha = number_of(get("ca")) if number_of(get("ca")) is not None else s.fill_alpha
        s.stroke_alpha = number_of(get("CA")) if number_of(get("CA")) is not None else s.stroke_alpha
        s.width = number_of(get("LW")) if number_of(get("LW")) is not None else s.width
        if "BM" in gs:
            s.mode = blend_mode(get("BM"))
        mask = get("SMask")
        if isinstance(mask, Name):
            s.mask = None
        elif isinstance(mask, dict) and isinstance(group := self.doc.get(mask, "G"), Stream) and depth < FORMS:
            lum = self.doc.get(mask, "S") == "Luminosity"
            canvas = Canvas(self.canvas.width, self.canvas.height, np.zeros(3) if lum else None, self.canvas.zoom)
            inner = Renderer(self.doc, canvas, s.ctm)
            inner.form(group, None, depth + 1)
            s.mask = luminosity(canvas.rgb) if lum else canvas.alpha

    def fill_area(self, cover: np.ndarray, color, alpha: float, depth: int) -> None:
        if isinstance(color, np.ndarray):
            self.canvas.paint(cover, color, self.s, alpha)
        elif isinstance(color, dict):
            m = self.doc.get(color, "Matrix")
            base = self.stack[0].ctm if self.stack else self.s.ctm
            self.shade(self.doc.get(color, "Shading"), cover, concat(tuple(map(float, m)), base) if m else base, alpha)
        elif isinstance(color, Stream) and depth < FORMS:
            self.tile(color, cover, alpha, depth)

    def tile(self, pattern: Stream, cover: np.ndarray, alpha: float, depth: int) -> None:
        """The pattern's cell, clipped to its box, at every step of its grid that meets the covered area.

        A few cells are drawn where they stand. Of more, one period of the grid is drawn at SAMPLES times the resolution, and each covered
        pixel takes the mean of its samples there, so the number of cells doesn't matter.
        """
        h, w = cover.shape
        m = self.doc.get(pattern.dict, "Matrix")
        base = self.stack[0].ctm if self.stack else self.s.ctm
        ctm = concat(tuple(map(float, m)), base) if m else base
        dx, dy = (abs(number_of(self.doc.get(pattern.dict, k)) or 0.0) for k in ("XStep", "YStep"))
        back = inverse(ctm)
        rows, cols = np.flatnonzero(cover.any(axis=1)), np.flatnonzero(cover.any(axis=0))
        if not dx or not dy or back is None or not len(rows):
            return
        top, bottom, left, right = int(rows[0]), int(rows[-1]) + 1, int(cols[0]), int(cols[-1]) + 1
        corners = [apply(back, x, y) for x in (left, right) for y in (top, bottom)]
        box = rect_of(self.doc.get(pattern.dict, "BBox")) or [0.0, 0.0, dx, dy]
        steps, lows, highs = (dx, dy), (min(box[0], box[2]), min(box[1], box[3])), (max(box[0], box[2]), max(box[1], box[3]))
        area = [(min(c[k] for c in corners), max(c[k] for c in corners)) for k in (0, 1)]

        def met(k: int, lo: float, hi: float) -> range:
            """Places along an axis whose cells meet a stretch of it."""
            return range(int(np.floor((lo - highs[k]) / steps[k] + 1e-9)) + 1, int(np.ceil((hi - lows[k]) / steps[k] - 1e-9)))

        data, res = filters.decode(pattern), self.doc.get(pattern.dict, "Resources")

        def draw(canvas: Canvas, ctm: tuple, across: range, along: range) -> None:
            for i in across:
                for j in along:
                    inner = Renderer(self.doc, canvas, concat((1, 0, 0, 1, i * dx, j * dy), ctm))
                    inner.s.clip = coverage([[apply(inner.s.ctm, *p) for p in (lows, (highs[0], lows[1]), highs, (lows[0], highs[1]))]], canvas.width, canvas.height)
                    inner.run(data, res, depth + 1)

        canvas, across, along = Canvas(w, h, zoom=self.canvas.zoom), met(0, *area[0]), met(1, *area[1])
        if len(across) * len(along) <= FEW_CELLS:
            draw(canvas, ctm, across, along)
        else:
            # a period starts at the edge of a cell; where less than a period is covered, only that is drawn
            parts = [(lows[k], steps[k]) if area[k][1] - area[k][0] >= steps[k] else (area[k][0], area[k][1] - area[k][0]) for k in (0, 1)]
            (ox, lx), (oy, ly) = parts
            nx, ny = (max(1, int(np.ceil(v * np.hypot(*side) - 1e-6))) * SAMPLES for v, side in ((lx, ctm[:2]), (ly, ctm[2:4])))
            one = Canvas(nx, ny, zoom=self.canvas.zoom * SAMPLES)
            draw(one, (nx / lx, 0, 0, ny / ly, -ox * nx / lx, -oy * ny / ly), met(0, ox, ox + lx), met(1, oy, oy + ly))
            rgb, seen = canvas.rgb[top:bottom, left:right], canvas.alpha[top:bottom, left:right]
            for k in range(SAMPLES * SAMPLES):
                yy, xx = np.mgrid[top:bottom, left:right] + (np.array([k // SAMPLES, k % SAMPLES]).reshape(2, 1, 1) + 0.5) / SAMPLES
                u, v = xx * back[0] + yy * back[2] + back[4], xx * back[1] + yy * back[3] + back[5]
                at = np.clip((((v - oy) % dy) * (ny / ly)).astype(int), 0, ny - 1), np.clip((((u - ox) % dx) * (nx / lx)).astype(int), 0, nx - 1)
                rgb += one.rgb[at] / SAMPLES**2
                seen += one.alpha[at] / SAMPLES**2
        self.canvas.paint(cover * canvas.alpha, np.where(canvas.alpha[..., None] > 0, canvas.rgb / np.maximum(canvas.alpha[..., None], 1e-9), 0), self.s, alpha)

    def shade(self, shading, cover: np.ndarray, ctm: tuple, alpha: float) -> None:
        """Shadings of types 1 (a function's first input), 2 and 3."""
        head = shading.dict if isinstance(shading, Stream) else shading
        back = inverse(ctm)
        if not isinstance(head, dict) or back is None or "Function" not in head:
            return
        doc, kind = self.doc, self.doc.get(head, "ShadingType")
        f, space = doc.get(head, "Function"), Space(head.get("ColorSpace", Name("DeviceRGB")), doc.resolve)
        fs = [Function(x, doc.resolve) for x in f] if isinstance(f, list) else [Function(head["Function"], doc.resolve)]
        yy, xx = np.mgrid[0 : cover.shape[0], 0 : cover.shape[1]] + 0.5
        x, y = xx * back[0] + yy * back[2] + back[4], xx * back[1] + yy * back[3] + back[5]
        c, domain = [float(v) for v in doc.get(head, "Coords") or []], [float(v) for v in doc.get(head, "Domain") or [0, 1]]
        extend = doc.get(head, "Extend") or [False, False]
        if kind == 1:
            t, ok = x, (x >= domain[0]) & (x <= domain[1])
            domain = [0, 1]
        elif kind == 2 and len(c) >= 4:
            d = (c[2] - c[0]) ** 2 + (c[3] - c[1]) ** 2
            t = ((x - c[0]) * (c[2] - c[0]) + (y - c[1]) * (c[3] - c[1])) / (d or 1)
            ok = ((t >= 0) | bool(extend[0])) & ((t <= 1) | bool(extend[1]))
        elif kind == 3 and len(c) >= 6:
            x0, y0, r0, x1, y1, r1 = c[:6]
            qa = (x1 - x0) ** 2 + (y1 - y0) ** 2 - (r1 - r0) ** 2
            qb = (x - x0) * (x1 - x0) + (y - y0) * (y1 - y0) + r0 * (r1 - r0)
            qc = (x - x0) ** 2 + (y - y0) ** 2 - r0 * r0
            root = np.sqrt(np.maximum(qb * qb - qa * qc, 0))
            both = [(qb + root) / qa, (qb - root) / qa] if abs(qa) > 1e-12 else [qc / np.where(qb == 0, 1e-12, 2 * qb)] * 2
            t, ok = np.zeros_like(x), np.zeros(x.shape, bool)
            for s in both[::-1]:  # the larger solution counts
                fits = (r0 + s * (r1 - r0) >= 0) & ((s >= 0) | bool(extend[0])) & ((s <= 1) | bool(extend[1])) & (qb * qb - qa * qc >= 0)
                t, ok = np.where(fits, s, t), ok | fits
        else:
            return
        v = domain[0] + np.clip(t, 0, 1) * (domain[1] - domain[0]) if kind != 1 else t
        out = np.concatenate([g(v) for g in fs], axis=-1)
        self.canvas.paint(cover * ok, space.rgb(out), self.s, alpha)

    def draw(self, x, res, depth: int) -> None:
        if not isinstance(x, Stream) or depth >= FORMS:
            return
        if self.doc.get(x.dict, "Subtype") == "Image":
            self.image(x, self.doc.get(res, "ColorSpace"))
        elif self.doc.get(x.dict, "Subtype") == "Form":
            group = self.doc.get(x.dict, "Group")
            if self.doc.get(group, "S") == "Transparency":
                canvas = Canvas(self.canvas.width, self.canvas.height, zoom=self.canvas.zoom)
                inner = Renderer(self.doc, canvas, self.s.ctm)
                inner.s.fill, inner.s.stroke, inner.s.width = self.s.fill, self.s.stroke, self.s.width
                inner.form(x, res, depth + 1)
                self.canvas.paint(canvas.alpha, np.where(canvas.alpha[..., None] > 0, canvas.rgb / np.maximum(canvas.alpha[..., None], 1e-9), 0), self.s, self.s.fill_alpha)
            else:
                self.form(x, res, depth + 1)

    def form(self, x: Stream, res, depth: int) -> None:
        saved, held = copy.copy(self.s), len(self.stack)
        m = self.doc.get(x.dict, "Matrix")
        if isinstance(m, list) and len(m) >= 6:
            self.s.ctm = concat(tuple(number_of(v) or 0.0 for v in m[:6]), self.s.ctm)
        box = rect_of(self.doc.get(x.dict, "BBox"))
        if box:
            x0, y0, x1, y1 = box
            c = coverage([[apply(self.s.ctm, *p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]], self.canvas.width, self.canvas.height)
            self.s.clip = c if self.s.clip is None else np.minimum(self.s.clip, c)
        try:
            self.run(filters.decode(x), self.doc.get(x.dict, "Resources") or res, depth)
        finally:
            self.s = saved
            del self.stack[held:]

    def image(self, x: Stream, spaces) -> None:
        """An image on the unit square, by the nearest sample; JPEG data is a grey box."""
        names = filters.filter_names(x.dict)
        back = inverse(self.s.ctm)
        if back is None:
            return
        try:
            if names and names[-1] in ("DCTDecode", "JPXDecode"):
                px = np.full((1, 1, 4), [128, 128, 128, 255], np.uint8)
            else:
                soft = self.doc.get(x.dict, "SMask")
                alpha = to_rgba({k: self.doc.resolve(v) for k, v in soft.dict.items()}, filters.decode(soft), self.doc.resolve)[..., 0] if isinstance(soft, Stream) else None
                px = to_rgba(x.dict, filters.decode(x), self.doc.resolve, spaces)
                if alpha is not None:
                    px[..., 3] = alpha[np.arange(px.shape[0])[:, None] * alpha.shape[0] // px.shape[0], np.arange(px.shape[1])[None] * alpha.shape[1] // px.shape[1]]
        except (PdfError, IndexError, ValueError, TypeError):
            return
        yy, xx = np.mgrid[0 : self.canvas.height, 0 : self.canvas.width] + 0.5
        u, v = xx * back[0] + yy * back[2] + back[4], xx * back[1] + yy * back[3] + back[5]
        ok = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
        i, j = np.clip(((1 - v) * px.shape[0]).astype(int), 0, px.shape[0] - 1), np.clip((u * px.shape[1]).astype(int), 0, px.shape[1] - 1)
        got = px[i, j].astype(float) / 255
        stencil = x.dict.get("ImageMask") is True
        color = self.s.fill if stencil and isinstance(self.s.fill, np.ndarray) else got[..., :3]
        self.canvas.paint(ok * got[..., 3], color, self.s, self.s.fill_alpha)


def render_page(doc: Document, page: dict, dpi: float = 72, background=(1.0, 1.0, 1.0)) -> np.ndarray:
    """8-bit RGBA of a page: its own crop or media box, rotation, content, annotations with an appearance."""
    box = rect_of(doc.get(page, "CropBox")) or rect_of(doc.get(page, "MediaBox")) or [0.0, 0.0, 612.0, 792.0]
    x0, x1, y0, y1 = min(box[0], box[2]), max(box[0], box[2]), min(box[1], box[3]), max(box[1], box[3])
    k = dpi / 72
    w, h = (x1 - x0) * k, (y1 - y0) * k
    turn = doc.get(page, "Rotate")
    turn = turn % 360 if isinstance(turn, int) else 0
    base = {0: (k, 0, 0, -k, -x0 * k, y1 * k), 90: (0, k, k, 0, -y0 * k, -x0 * k), 180: (-k, 0, 0, k, x1 * k, -y0 * k), 270: (0, -k, -k, 0, y1 * k, x1 * k)}.get(turn, (k, 0, 0, -k, -x0 * k, y1 * k))
    width, height = (max(1, round(v)) for v in ((h, w) if turn in (90, 270) else (w, h)))
    canvas = Canvas(width, height, np.array(background) if background is not None else None)
    r = Renderer(doc, canvas, base)
    data = doc.content(page)
    if data:
        r.run(data, doc.inherited(page, "Resources"))
    for ref in doc.get(page, "Annots") or []:
        a = doc.resolve(ref)
        look = doc.get(doc.get(a, "AP"), "N")
        if isinstance(look, dict):
            look = doc.resolve(look.get(str(doc.get(a, "AS") or "")))
        rect, flags = rect_of(doc.get(a, "Rect")), doc.get(a, "F")
        if isinstance(look, Stream) and rect and not (isinstance(flags, int) and flags & 2):
            b = rect_of(doc.get(look.dict, "BBox")) or [0, 0, 1, 1]
            sx, sy = ((rect[2] - rect[0]) / ((b[2] - b[0]) or 1), (rect[3] - rect[1]) / ((b[3] - b[1]) or 1))
            one = Renderer(doc, canvas, concat((sx, 0, 0, sy, rect[0] - b[0] * sx, rect[1] - b[1] * sy), base))
            one.form(look, None, 1)
    out = np.zeros((height, width, 4), np.uint8)
    out[..., :3] = np.clip(np.round(canvas.rgb * 255), 0, 255)
    out[..., 3] = np.clip(np.round(canvas.alpha * 255), 0, 255)
    return out
