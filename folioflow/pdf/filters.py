"""Stream filters and predictors."""

from __future__ import annotations

import re
import zlib

import numpy as np

from folioflow.pdf import fax
from folioflow.pdf.syntax import Name, PdfError, Stream

# Fixed values
LIMIT = 256 << 20
ROW_LIMIT = 16 << 20
#: Places of codes that the largest table of LZW goes back to: one for each entry, and the end of the last.
LZW_PLACES = 4096 - 258 + 2
SHORT_NAMES = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}


def flate(data: bytes) -> bytes:
    """zlib data, or bare deflate data; cut at LIMIT."""
    for window in (15, -15):
        d = zlib.decompressobj(window)
        try:
            out = d.decompress(data, LIMIT)
            if out or window > 0:
                return out
        except zlib.error:
            continue
    raise PdfError("Filter", "no deflate data")


def ascii_hex(data: bytes) -> bytes:
    body = re.sub(rb"[\0\t\n\f\r ]", b"", data.split(b">")[0])
    if not re.fullmatch(rb"[0-9A-Fa-f]*", body):
        raise PdfError("Filter", "no hex digit")
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    body = re.sub(rb"[\0\t\n\f\r ]", b"", data.split(b"~")[0])
    whole = len(body) // 5 * 5
    out, group = bytearray(), []
    if b"z" not in body:
        # without the short form all groups at once
        digits = np.frombuffer(body, np.uint8, whole).reshape(-1, 5).astype(np.int64) - 0x21
        if ((digits < 0) | (digits > 84)).any():
            raise PdfError("Filter", "no base-85 digit")
        words = digits @ (85 ** np.arange(4, -1, -1))
        if (words >= 1 << 32).any():
            raise PdfError("Filter", "a group out of range")
        out, body = bytearray(words.astype(">u4").tobytes()), body[whole:]
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 0x21 <= c <= 0x75:
            raise PdfError("Filter", "no base-85 digit")
        group.append(c - 0x21)
        if len(group) == 5:
            out += _word(group)
            group = []
    if len(group) == 1:
        raise PdfError("Filter", "a group of one digit")
    if group:
        out += _word(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _word(group: list[int]) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    if n >= 1 << 32:
        raise PdfError("Filter", "a group out of range")
    return n.to_bytes(4, "big")


def _codes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    """n codes of so many bits from a bit on; width is 16 at most."""
    raw = np.frombuffer(data[at >> 3 : (at + n * width + 7 >> 3)] + b"\0\0", np.uint8).astype(np.int32)
    bit = (at & 7) + width * np.arange(n)
    k = bit >> 3
    return (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (24 - width - (bit & 7)) & ((1 << width) - 1)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, changing one code early.

    Between two clear codes the width follows from the number of codes, so many are cut at once, and literals are taken at once. An entry of
    the table is what a code gave and the next character, so it is a piece of the output: only the places of codes are kept.
    """
    out, places, width = bytearray(), [], 9
    at, end, many, stretch = 0, 8 * len(data), 8, 0
    while at + width <= end:
        # codes until the width changes, at most twice as many as before, as a clear code ends them
        n = min(many, (end - at) // width, many if width == 12 else (1 << width) - 258 - len(places))
        codes, cleared = _codes(data, at, n, width), False
        literal = int(np.argmax(codes > 255)) if codes.max() > 255 else n
        places += range(len(out), len(out) + min(literal, LZW_PLACES - len(places)))
        out += codes[:literal].astype(np.uint8).tobytes()
        for code in codes[literal:].tolist():
            place, k = len(out), code - 258
            if code < 256:
                out.append(code)
            elif code == 257:
                return bytes(out)
            elif code == 256:
                cleared = True
                break
            elif k + 1 < len(places):
                out += out[places[k] : places[k + 1] + 1]
            elif k + 1 == len(places):
                out += out[places[k] :] + out[places[k] : places[k] + 1]
            else:
                raise PdfError("Filter", "a code out of range")
            literal += 1
            if len(places) < LZW_PLACES:
                places.append(place)
        if len(out) > LIMIT:
            raise PdfError("Filter", "too long")
        if cleared:
            at += (literal + 1) * width
            many, stretch, places, width = max(2, min(stretch + literal + 1, 4096)), 0, [], 9
        else:
            at, stretch, many = at + n * width, stretch + n, min(2 * many, 4096)
            width = min(12, max(9, (min(4096, 257 + max(1, len(places))) + 1).bit_length()))
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n == 128:
            break
        if n < 128:
            if at + 2 + n > len(data):
                raise PdfError("Filter", "a run is cut short")
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if at + 1 >= len(data):
                raise PdfError("Filter", "a run is cut short")
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def png_predictor(data: bytes, colors: int, bits: int, columns: int) -> bytes:
    """Rows with a type byte each; what is left of a last row goes."""
    unit = max(1, colors * bits // 8)
    width = (colors * bits * columns + 7) // 8
    if not 0 < width <= ROW_LIMIT:
        return data
    rows = np.frombuffer(data[: len(data) // (width + 1) * (width + 1)], np.uint8).reshape(-1, width + 1)
    if not len(rows):
        return b""
    out = np.zeros((len(rows), width), np.uint8)
    above = np.zeros(width, np.uint8)
    # rows of one type after each other, all but types 3 and 4 at once
    starts = np.flatnonzero(np.diff(rows[:, 0].astype(int), prepend=-1))
    for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        kind, raw = rows[k, 0], rows[k:end, 1:]
        if kind == 1:
            for c in range(unit):
                out[k:end, c::unit] = np.cumsum(raw[:, c::unit], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[k:end] = np.cumsum(raw, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for m in range(k, end):
                above = out[m] = _by_both(kind, rows[m, 1:], above, unit)
        else:
            out[k:end] = raw
        above = out[end - 1]
    return out.tobytes()


def _by_both(kind: int, raw: np.ndarray, above: np.ndarray, unit: int) -> np.ndarray:
    """A row of type 3 or 4, by its left and upper neighbours."""
    now = bytearray(len(raw))
    up = above.tolist()
    for i, x in enumerate(raw.tolist()):
        a = now[i - unit] if i >= unit else 0
        if kind == 3:
            guess = (a + up[i]) // 2
        else:
            c = up[i - unit] if i >= unit else 0
            p = a + up[i] - c
            guess = min(((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c)))[2]
        now[i] = (x + guess) & 255
    return np.frombuffer(bytes(now), np.uint8)


def tiff_predictor(data: bytes, colors: int, bits: int, columns: int) -> bytes:
    width = colors * columns
    if bits != 8 or not width:
        return data
    body = len(data) // width * width
    rows = np.frombuffer(data[:body], np.uint8).reshape(-1, columns, colors)
    return np.cumsum(rows, axis=1, dtype=np.uint64).astype(np.uint8).tobytes() + data[body:]


def predicted(data: bytes, parms: dict) -> bytes:
    get = lambda k, default, top: min(max(parms[k], 1), top) if isinstance(parms.get(k), int) else default
    kind = parms.get("Predictor", 1)
    shape = get("Colors", 1, 32), get("BitsPerComponent", 8, 16), get("Columns", 1, 1 << 20)
    if kind == 2:
        return tiff_predictor(data, *shape)
    return png_predictor(data, *shape) if isinstance(kind, int) and 10 <= kind <= 15 else data


DECODERS = {"FlateDecode": flate, "ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii_85, "LZWDecode": lzw, "RunLengthDecode": run_length, "DCTDecode": lambda d: d, "JPXDecode": lambda d: d}


def filter_names(head: dict) -> list[str]:
    f = head.get("Filter")
    names = f if isinstance(f, list) else [f] if f is not None else []
    return [SHORT_NAMES.get(n, str(n)) for n in names if isinstance(n, Name)]


def decode(stream: Stream) -> bytes:
    """The data of a stream after all its filters; a dictionary of parameters is that of the first one."""
    parms = stream.dict.get("DecodeParms")
    data = stream.data
    for k, name in enumerate(filter_names(stream.dict)):
        own = parms if isinstance(parms, dict) and k == 0 else parms[k] if isinstance(parms, list) and k < len(parms) else None
        own = own if isinstance(own, dict) else {}
        if name == "CCITTFaxDecode":
            columns = own.get("Columns", fax.WIDTH)
            data = fax.decode_g4(data, columns if isinstance(columns, int) and 0 < columns < 1 << 16 else fax.WIDTH)
        elif name in DECODERS:
            data = predicted(DECODERS[name](data), own)
        else:
            raise PdfError("UnsupportedFeature", f"filter {name}")
    return data


def encode_flate(data: bytes, head: dict | None = None) -> Stream:
    """Compressed if that is shorter."""
    small = zlib.compress(data)
    return Stream({**(head or {}), "Filter": Name("FlateDecode")}, small) if len(small) < len(data) else Stream(dict(head or {}), data)


def encode_ascii_hex(data: bytes) -> bytes:
    return data.hex().upper().encode() + b">"


def encode_ascii_85(data: bytes) -> bytes:
    words = np.frombuffer(data + bytes(-len(data) % 4), ">u4").astype(np.int64)
    digits = (words[:, None] // 85 ** np.arange(4, -1, -1) % 85 + 33).astype(np.uint8)
    zero = (words == 0) & (4 * np.arange(len(words)) + 4 <= len(data))
    digits[zero, 0] = 0x7A
    kept = np.ones(digits.shape, bool)
    kept[zero, 1:] = False
    if len(data) % 4:
        # a part of a word is as many digits as bytes and one
        kept[-1, len(data) % 4 + 1 :] = False
    return digits[kept].tobytes() + b"~>"


def encode_run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        for k in range(at, m.start(), 128):
            part = data[k : min(k + 128, m.start())]
            out += bytes([len(part) - 1]) + part
        out += bytes([257 - len(m[0])]) + m[1]
        at = m.end()
    for k in range(at, len(data), 128):
        part = data[k : k + 128]
        out += bytes([len(part) - 1]) + part
    return bytes(out) + b"\x80"
