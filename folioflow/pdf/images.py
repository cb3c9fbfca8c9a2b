"""Image pixels, and images to be put in documents."""

from __future__ import annotations

import zlib

import numpy as np

from folioflow.pdf import filters
from folioflow.pdf.colors import Space
from folioflow.pdf.syntax import Name, PdfError, Stream


def samples(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray:
    """Numbers of height x width x n; what is missing is 0."""
    row = (width * n * bits + 7) // 8
    raw = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 8:
        return raw[:, : width * n].reshape(height, width, n)
    if bits == 16:
        return raw.reshape(height, -1, 2)[:, : width * n, 0].reshape(height, width, n)
    flat = np.unpackbits(raw, axis=1)[:, : width * n * bits].reshape(height, width, n, bits)
    return flat @ (1 << np.arange(bits - 1, -1, -1))


def to_rgba(head: dict, data: bytes, resolve=lambda v: v, named: dict | None = None, soft_mask: np.ndarray | None = None) -> np.ndarray:
    """8-bit RGBA of raw image data by its dictionary: colour space, bits, decode array, stencil masks."""
    w, h = resolve(head.get("Width")), resolve(head.get("Height"))
    bits = resolve(head.get("BitsPerComponent")) or (1 if head.get("ImageMask") is True else 8)
    decode = resolve(head.get("Decode"))
    out = np.zeros((h, w, 4), np.uint8)
    if head.get("ImageMask") is True:
        m = samples(data, w, h, 1, 1)[..., 0]
        out[..., 3] = np.where(m == (1 if decode and decode[0] == 1 else 0), 255, 0)
        return out
    space = Space(head.get("ColorSpace", Name("DeviceGray")), resolve, named)
    v = samples(data, w, h, space.n, bits).astype(float)
    top = float((1 << min(bits, 8)) - 1)
    if space.kind != "Indexed":
        v /= top
        if isinstance(decode, list) and len(decode) >= 2 * space.n:
            lo, hi = np.array(decode[: 2 * space.n : 2], float), np.array(decode[1 : 2 * space.n : 2], float)
            v = lo + v * (hi - lo)
        elif space.kind == "Lab":
            v = v * [100, 200, 200] - [0, 100, 100]
    out[..., :3] = np.round(space.rgb(v) * 255)
    out[..., 3] = 255 if soft_mask is None else soft_mask
    return out


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and components from a JPEG's frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big"), data[at + 9]
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise PdfError("Image", "no JPEG frame")


def _object(width: int, height: int, space: str, data: bytes, **more) -> Stream:
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name(space)} | more, data)


def from_jpeg(data: bytes) -> tuple[Stream, None]:
    w, h, n = jpeg_size(data)
    return _object(w, h, {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB"), data, Filter=Name("DCTDecode")), None


def from_png(data: bytes) -> tuple[Stream, Stream | None]:
    """An image object of an 8-bit PNG, and its alpha as a soft mask if it has one."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PdfError("Image", "no PNG")
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12]
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2] != 8 or head[4]:
        raise PdfError("UnsupportedFeature", "PNGs of 8 bits without interlace only")
    w, h, _, color, _ = head
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    px = np.frombuffer(filters.png_predictor(zlib.decompress(packed), n, 8, w), np.uint8).reshape(h, w, n)
    if palette is not None and color == 3:
        px = palette[np.minimum(px[..., 0], len(palette) - 1)]
    alpha = px[..., -1] if color in (4, 6) else None
    px = px[..., :-1] if alpha is not None else px
    space = "DeviceGray" if px.shape[2] == 1 else "DeviceRGB"
    mask = _object(w, h, "DeviceGray", zlib.compress(alpha.tobytes()), Filter=Name("FlateDecode")) if alpha is not None else None
    return _object(w, h, space, zlib.compress(np.ascontiguousarray(px).tobytes()), Filter=Name("FlateDecode")), mask


def png_of(rgba: np.ndarray) -> bytes:
    """A PNG of 8-bit RGBA."""
    h, w, _ = rgba.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgba).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x06\0\0\0") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
