"""Widths of the standard fonts, in thousandths of the size."""

from __future__ import annotations

import unicodedata

from folioflow.pdf.fonts import HELVETICA, STANDARD_14
from folioflow.pdf.syntax import Name

# Widths from space to tilde
HELVETICA_BOLD = [278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584]
TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
TIMES_BOLD = [250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, *[500] * 10, 333, 333, 570, 570, 570, 500, 930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500, 333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520]
TIMES_ITALIC = [250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, *[500] * 10, 333, 333, 675, 675, 675, 500, 920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833, 667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500, 333, 500, 500, 444, 500, 444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400, 275, 400, 541]
TIMES_BOLD_ITALIC = [250, 389, 555, 500, 500, 833, 778, 278, 333, 333, 500, 570, 250, 333, 250, 278, *[500] * 10, 333, 333, 570, 570, 570, 500, 832, 667, 667, 667, 722, 667, 667, 722, 778, 389, 500, 667, 611, 889, 722, 722, 611, 722, 667, 556, 611, 722, 667, 889, 667, 611, 611, 333, 278, 333, 570, 500, 333, 500, 500, 444, 500, 444, 333, 500, 556, 278, 278, 500, 278, 778, 556, 500, 500, 500, 389, 389, 278, 556, 444, 667, 500, 444, 389, 348, 220, 348, 570]

TABLES = {"Helvetica": HELVETICA, "Helvetica-Oblique": HELVETICA, "Helvetica-Bold": HELVETICA_BOLD, "Helvetica-BoldOblique": HELVETICA_BOLD, "Times-Roman": TIMES, "Times-Bold": TIMES_BOLD, "Times-Italic": TIMES_ITALIC, "Times-BoldItalic": TIMES_BOLD_ITALIC}
#: Symbol and ZapfDingbats have no Latin letters; their mean stands for all of their glyphs.
OTHER = 600


def glyph_width(font: str, char: str) -> int:
    """The width of a character in a standard font; letters with accents are as wide as without. 0 for a font that isn't one."""
    if font not in STANDARD_14:
        return 0
    table = TABLES.get(font)
    if table is None:
        return OTHER
    base = unicodedata.normalize("NFD", char)[:1]
    return table[ord(base) - 32] if base and 32 <= ord(base) < 127 else table[ord("n") - 32]


def measure(font: str, text: str, size: float) -> float:
    """The width of a text at a size."""
    return sum(glyph_width(font, c) for c in text) * size / 1000


def font_dictionary(font: str) -> dict:
    """The dictionary of a standard font, by name, in WinAnsi encoding."""
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(font), "Encoding": Name("WinAnsiEncoding")}
