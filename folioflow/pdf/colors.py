"""Colour spaces, functions and blend modes on numpy arrays."""

from __future__ import annotations


import numpy as np

from folioflow.pdf import filters
from folioflow.pdf.syntax import Name, PdfError, Stream, number_of

# Fixed values
DEVICE = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4}
WHITE_D65 = (0.9505, 1.0, 1.089)
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


class Function:
    """Type 0 (one input), 2 and 3 functions, of arrays; of several inputs the first counts."""

    def __init__(self, value, resolve):
        value = resolve(value)
        head = value.dict if isinstance(value, Stream) else value
        if not isinstance(head, dict):
            raise PdfError("Function", "no function")
        get = lambda k, default=None: resolve(head.get(k)) if k in head else default
        self.kind, self.domain, self.range = get("FunctionType"), get("Domain", [0, 1]), get("Range")
        if self.kind == 0:
            bits, size = get("BitsPerSample", 8), get("Size", [1])[0]
            n = len(self.range) // 2
            raw = np.unpackbits(np.frombuffer(filters.decode(value), np.uint8))[: size * n * bits].reshape(size, n, bits)
            top = float((1 << bits) - 1)
            samples = raw @ (2.0 ** np.arange(bits - 1, -1, -1)) / top
            lo, hi = np.array((get("Decode") or self.range)[::2], float), np.array((get("Decode") or self.range)[1::2], float)
            self.samples, self.encode = lo + samples * (hi - lo), get("Encode") or [0, size - 1]
        elif self.kind == 2:
            self.c0, self.c1, self.n = np.array(get("C0", [0.0]), float), np.array(get("C1", [1.0]), float), float(get("N", 1))
        elif self.kind == 3:
            self.parts = [Function(f, resolve) for f in get("Functions")]
            self.bounds, self.encode = get("Bounds", []), get("Encode")
        else:
            raise PdfError("UnsupportedFeature", f"function type {self.kind}")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Outputs in the last axis."""
        lo, hi = self.domain[:2]
        x = np.clip(np.asarray(x, float), lo, hi)
        if self.kind == 0:
            at = np.clip(self.encode[0] + (x - lo) / ((hi - lo) or 1) * (self.encode[1] - self.encode[0]), 0, len(self.samples) - 1)
            k = np.minimum(at.astype(int), len(self.samples) - 1)
            nxt = np.minimum(k + 1, len(self.samples) - 1)
            out = self.samples[k] + (self.samples[nxt] - self.samples[k]) * (at - k)[..., None]
        elif self.kind == 2:
            out = self.c0 + np.power(x, self.n)[..., None] * (self.c1 - self.c0)
        else:
            edges = [lo, *self.bounds, hi]
            which = np.searchsorted(np.array(self.bounds, float), x, side="right")
            out = None
            for k, part in enumerate(self.parts):
                a, b, e0, e1 = edges[k], edges[k + 1], *self.encode[2 * k : 2 * k + 2]
                own = part(e0 + (x - a) * ((e1 - e0) / (b - a)) if b != a else np.full_like(x, e0))
                out = own if out is None else np.where((which == k)[..., None], own, out)
        return np.clip(out, self.range[::2], self.range[1::2]) if self.range else out


class Space:
    """A colour space: how many components it has, and RGB of arrays of components."""

    def __init__(self, value, resolve, named: dict | None = None):
        value = resolve(value)
        if isinstance(value, Name) and str(value) not in DEVICE and named:
            value = resolve(named.get(str(value), value))
        parts = [resolve(v) for v in value] if isinstance(value, list) else [value]
        self.kind = str(parts[0]) if parts and isinstance(parts[0], Name) else "DeviceGray"
        self.head = parts[1] if len(parts) > 1 else None
        self.base = self.function = self.table = None
        if self.kind in ("Indexed", "I"):
            self.kind, self.n = "Indexed", 1
            self.base = Space(value[1], resolve, named)
            raw = filters.decode(parts[3]) if isinstance(parts[3], Stream) else bytes(parts[3])
            self.table = np.frombuffer(raw[: len(raw) // self.base.n * self.base.n], np.uint8).reshape(-1, self.base.n) / 255
        elif self.kind in ("Separation", "DeviceN"):
            self.n = len(parts[1]) if self.kind == "DeviceN" else 1
            self.base, self.function = Space(value[2], resolve, named), Function(value[3], resolve)
        elif self.kind == "ICCBased":
            self.n = self.head.dict.get("N", 3) if isinstance(self.head, Stream) else 3
            alt = self.head.dict.get("Alternate") if isinstance(self.head, Stream) else None
            self.base = Space(alt, resolve, named) if alt is not None else Space(Name({1: "DeviceGray", 4: "DeviceCMYK"}.get(self.n, "DeviceRGB")), resolve)
        else:
            self.n = DEVICE.get(self.kind, 1)

    def rgb(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, float)
        if self.kind == "Indexed":
            k = np.clip(c[..., 0].astype(int), 0, max(0, len(self.table) - 1))
            return self.base.rgb(self.table[k])
        if self.function is not None:
            return self.base.rgb(self.function(c[..., 0]))
        if self.base is not None:
            return self.base.rgb(c)
        if self.kind == "Lab":
            return self._lab(c)
        if self.n == 4:
            return np.clip((1 - c[..., :3]) * (1 - c[..., 3:4]), 0, 1)
        gamma = self.head.get("Gamma") if isinstance(self.head, dict) else None
        if self.n == 1:
            g = number_of(gamma) or 1.0
            return np.clip(np.repeat(c[..., :1], 3, axis=-1), 0, 1) ** g
        return np.clip(c[..., :3], 0, 1) ** (np.array(gamma, float) if isinstance(gamma, list) and len(gamma) == 3 else 1.0)

    def _lab(self, c: np.ndarray) -> np.ndarray:
        white = np.array(self.head.get("WhitePoint", WHITE_D65) if isinstance(self.head, dict) else WHITE_D65, float)
        m = (c[..., 0] + 16) / 116
        g = lambda v: np.where(v >= 6 / 29, v**3, 108 / 841 * (v - 4 / 29))
        xyz = np.stack([g(m + c[..., 1] / 500), g(m), g(m - c[..., 2] / 200)], axis=-1) * white
        lin = np.clip(xyz @ np.array(XYZ_TO_RGB).T, 0, 1)
        return np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * lin ** (1 / 2.4) - 0.055)


def luminosity(c: np.ndarray) -> np.ndarray:
    return c @ np.array([0.3, 0.59, 0.11])


def _with_luminosity(c: np.ndarray, lum: np.ndarray) -> np.ndarray:
    c = c + (lum - luminosity(c))[..., None]
    l, lo, hi = luminosity(c)[..., None], c.min(axis=-1, keepdims=True), c.max(axis=-1, keepdims=True)
    c = np.where(lo < 0, l + (c - l) * l / np.maximum(l - lo, 1e-9), c)
    return np.where(hi > 1, l + (c - l) * (1 - l) / np.maximum(hi - l, 1e-9), c)


def _saturation(c: np.ndarray) -> np.ndarray:
    return c.max(axis=-1) - c.min(axis=-1)


def _with_saturation(c: np.ndarray, s: np.ndarray) -> np.ndarray:
    lo, hi = c.min(axis=-1, keepdims=True), c.max(axis=-1, keepdims=True)
    return np.where(hi > lo, (c - lo) / np.maximum(hi - lo, 1e-9) * s[..., None], 0)


def _soft(b: np.ndarray, s: np.ndarray) -> np.ndarray:
    d = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b))
    return np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (d - b))


def _hard(b: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(s <= 0.5, 2 * s * b, 1 - 2 * (1 - s) * (1 - b))


#: Each mode's mix of backdrop b and source s.
BLEND = {
    "Normal": lambda b, s: s, "Multiply": lambda b, s: b * s, "Screen": lambda b, s: b + s - b * s, "Overlay": lambda b, s: _hard(s, b), "Darken": np.minimum, "Lighten": np.maximum,
    "ColorDodge": lambda b, s: np.where(b == 0, 0, np.where(s >= 1, 1, np.minimum(1, b / np.maximum(1 - s, 1e-9)))), "ColorBurn": lambda b, s: np.where(b >= 1, 1, np.where(s <= 0, 0, 1 - np.minimum(1, (1 - b) / np.maximum(s, 1e-9)))),
    "HardLight": _hard, "SoftLight": _soft, "Difference": lambda b, s: np.abs(b - s), "Exclusion": lambda b, s: b + s - 2 * b * s,
    "Hue": lambda b, s: _with_luminosity(_with_saturation(s, _saturation(b)), luminosity(b)), "Saturation": lambda b, s: _with_luminosity(_with_saturation(b, _saturation(s)), luminosity(b)),
    "Color": lambda b, s: _with_luminosity(s, luminosity(b)), "Luminosity": lambda b, s: _with_luminosity(b, luminosity(s)),
}


def blend_mode(value) -> str:
    """The first known mode of a name or an array of names."""
    names = value if isinstance(value, list) else [value]
    return next((str(n) for n in names if str(n) in BLEND), "Normal")


