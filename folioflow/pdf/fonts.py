"""Encodings, glyph names, ToUnicode maps, and the text of shown strings."""

from __future__ import annotations

import codecs
import html.entities
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from folioflow.functions.text import PDFDOC_EURO, PDFDOC_HIGH, PDFDOC_LOW
from folioflow.pdf import syntax
from folioflow.pdf.syntax import Name, Parser, Ref, Stream

# Fixed values
#: Standard encoding from code 0xA1 on; a space is an unused code.
STANDARD_HIGH = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ –†‡· ¶•‚„”»…‰ ¿ `´ˆ˜¯˘˙¨ ˚¸ ˝˛ˇ—"
STANDARD_LAST = {0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
#: Names of ASCII marks from code 0x20 on, digits and letters left out.
ASCII_NAMES = "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash".split()
DIGIT_NAMES = "zero one two three four five six seven eight nine".split()
MARK_NAMES = {":": "colon", ";": "semicolon", "<": "less", "=": "equal", ">": "greater", "?": "question", "@": "at", "[": "bracketleft", "\\": "backslash", "]": "bracketright", "^": "asciicircum", "_": "underscore", "`": "grave", "{": "braceleft", "|": "bar", "}": "braceright", "~": "asciitilde"}
MORE_NAMES = {"quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "germandbls": "ß", "Euro": "€", "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "minus": "−", "periodcentered": "·", "perthousand": "‰", "trademark": "™", "florin": "ƒ", "fraction": "⁄", "nbspace": " "}
#: Widths of Helvetica from space to tilde, in thousandths.
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
STANDARD_14 = ["Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Symbol", "ZapfDingbats"]


def _codec(name: str) -> list[str | None]:
    out = []
    for k in range(256):
        c = bytes([k]).decode(name, "replace")
        out.append(None if c == "�" else c)
    return out


def _standard() -> list[str | None]:
    out: list[str | None] = [chr(k) if 32 <= k < 127 else None for k in range(256)]
    out[0x27], out[0x60] = "’", "‘"
    for k, c in enumerate(STANDARD_HIGH):
        out[0xA1 + k] = None if c == " " else c
    for k, c in STANDARD_LAST.items():
        out[k] = c
    return out


def _pdfdoc() -> list[str]:
    out = [chr(k) for k in range(256)]
    for k, c in enumerate(PDFDOC_LOW):
        out[0x18 + k] = c
    for k, c in enumerate(PDFDOC_HIGH):
        out[0x80 + k] = c
    out[0xA0] = PDFDOC_EURO
    return out


WIN_ANSI = [c if c is not None else "•" for c in _codec("cp1252")]
ENCODINGS = {"WinAnsiEncoding": WIN_ANSI, "MacRomanEncoding": _codec("mac_roman"), "StandardEncoding": _standard(), "PDFDocEncoding": _pdfdoc(), "MacExpertEncoding": _standard()}
PDFDOC = ENCODINGS["PDFDocEncoding"]


def _glyphs() -> dict[str, str]:
    out = {n: chr(c) for n, c in html.entities.name2codepoint.items()}
    out |= {n: chr(0x20 + k) for k, n in enumerate(ASCII_NAMES)} | {n: str(k) for k, n in enumerate(DIGIT_NAMES)}
    out |= {n: c for c, n in MARK_NAMES.items()} | {chr(k): chr(k) for k in [*range(65, 91), *range(97, 123)]} | MORE_NAMES
    for accent, word in (("caron", "CARON"), ("ogonek", "OGONEK"), ("acute", "ACUTE"), ("breve", "BREVE"), ("macron", "MACRON"), ("dotaccent", "DOT ABOVE"), ("hungarumlaut", "DOUBLE ACUTE"), ("dieresis", "DIAERESIS"), ("circumflex", "CIRCUMFLEX"), ("grave", "GRAVE"), ("tilde", "TILDE"), ("ring", "RING ABOVE"), ("cedilla", "CEDILLA")):
        for letter in "abcdefghijklmnopqrstuvwxyz":
            for case, c in (("SMALL", letter), ("CAPITAL", letter.upper())):
                try:
                    out[c + accent] = unicodedata.lookup(f"LATIN {case} LETTER {letter.upper()} WITH {word}")
                except KeyError:
                    pass
    return out


GLYPHS = _glyphs()


def glyph_text(name: str) -> str | None:
    """The character of a glyph name: listed, uniXXXX, or u and 4 to 6 hexadecimal digits."""
    if name in GLYPHS:
        return GLYPHS[name]
    m = re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name)
    if not m:
        return None
    code = int(m[1] or m[2], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class ToUnicode:
    """The maps of a CMap stream: single codes first, then ranges in order."""

    def __init__(self, data: bytes):
        self.chars: dict[bytes, str] = {}
        self.ranges: list[tuple[bytes, bytes, object]] = []
        for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", data, re.S):
            p, items = Parser(body), []
            while True:
                p.skip()
                if p.at >= len(body):
                    break
                try:
                    items.append(p.value())
                except syntax.PdfError:
                    break
            n = 2 if kind == b"bfchar" else 3
            for k in range(0, len(items) - n + 1, n):
                if kind == b"bfchar":
                    if isinstance(items[k], bytes) and isinstance(items[k + 1], bytes):
                        self.chars[bytes(items[k])] = self._text(items[k + 1])
                else:
                    self.ranges.append((items[k], items[k + 1], items[k + 2]))

    @staticmethod
    def _text(b: bytes) -> str:
        return b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")

    def map(self, code: bytes) -> str | None:
        if code in self.chars:
            return self.chars[code]
        for lo, hi, out in self.ranges:
            if isinstance(lo, bytes) and isinstance(hi, bytes) and len(lo) == len(code) and lo <= code <= hi:
                k = int.from_bytes(code, "big") - int.from_bytes(lo, "big")
                if isinstance(out, list):
                    return self._text(out[k]) if k < len(out) and isinstance(out[k], bytes) else None
                if isinstance(out, bytes) and out:
                    base = int.from_bytes(out, "big") + k
                    return self._text(base.to_bytes(max(len(out), (base.bit_length() + 7) // 8), "big"))
        return None


@lru_cache(maxsize=64)
def _table_of(encoding: tuple) -> tuple[list[str], str | None]:
    """The characters of all bytes, and them as one string if each has one character; U+FFFE stands for none there."""
    chars = [c or chr(k) for k, c in enumerate(encoding)]
    return chars, "".join(chars) if all(len(c) == 1 and c != "\ufffe" for c in chars) else None


@dataclass
class Font:
    name: str = "Unknown"
    subtype: str = "Type1"
    encoding: list = field(default_factory=lambda: WIN_ANSI)
    to_unicode: ToUnicode | None = None
    _table: tuple | None = field(default=None, repr=False, compare=False)

    @property
    def composite(self) -> bool:
        return self.subtype == "Type0"

    def text(self, data: bytes) -> str:
        """The characters of a shown string."""
        if data[:2] == b"\xfe\xff":
            return data[2:].decode("utf-16-be", "replace")
        out, at = [], 0
        if not self.composite:
            if self._table is None or self._table[0] is not self.encoding or self._table[1] is not self.to_unicode:
                chars, plain = _table_of(tuple(self.encoding))
                if self.to_unicode:
                    mapped = [self.to_unicode.map(bytes([k])) for k in range(256)]
                    chars = [c if c is not None else chars[k] for k, c in enumerate(mapped)]
                    plain = "".join(chars) if all(len(c) == 1 and c != "\ufffe" for c in chars) else None
                self._table = self.encoding, self.to_unicode, chars, plain
            _, _, chars, plain = self._table
            return "".join([chars[k] for k in data]) if plain is None else codecs.charmap_decode(data, "strict", plain)[0]
        while at < len(data):
            for n in (2, 1):
                code = data[at : at + n]
                c = self.to_unicode.map(code) if self.to_unicode and len(code) == n else None
                if c is not None:
                    out.append(c)
                    at += n
                    break
            else:
                code = data[at : at + 2] if self.to_unicode is None or len(data) - at >= 2 else data[at : at + 1]
                out.append("".join(map(chr, code)).replace("\0", ""))
                at += len(code)
        return "".join(out)


def font_of(head: dict, resolve, stream_data) -> Font:
    """A font of its dictionary. An encoding that is no known table leaves WinAnsi; a ToUnicode map is kept in any case."""
    get = lambda k: resolve(head.get(k))
    base, subtype = get("BaseFont"), get("Subtype")
    font = Font(str(base) if isinstance(base, Name) else "Unknown", str(subtype) if isinstance(subtype, Name) else "Type1")
    enc = get("Encoding")
    if isinstance(enc, Name):
        font.encoding = ENCODINGS.get(str(enc), WIN_ANSI)
    elif isinstance(enc, dict):
        table = list(ENCODINGS.get(str(resolve(enc.get("BaseEncoding")) or ""), ENCODINGS["StandardEncoding"]))
        code = 0
        for item in resolve(enc.get("Differences")) or []:
            if isinstance(item, Name):
                table[code & 255] = glyph_text(str(item)) or table[code & 255]
                code += 1
            elif isinstance(item, int):
                code = item
        font.encoding = table
    cmap = head.get("ToUnicode")
    cmap = resolve(cmap) if isinstance(cmap, Ref) else cmap
    if isinstance(cmap, Stream):
        font.to_unicode = ToUnicode(stream_data(cmap))
    return font
