"""String functions over Columns. All are expressions, so they stay in generated code and can be folded and pushed down.

A few rules are there for single values too, for stages that run in Python from file to result.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
#: Characters that start a list item without a space after them.
BULLETS = "•‣●○■▪–—-*"
#: Roman numbers that count as list markers.
ROMAN = "i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii"
BOLD_NAMES = ["bold", "-bd", "heavy", "black", "demi"]
ITALIC_NAMES = ["italic", "oblique", "slant", "-it"]
MONO_NAMES = ["courier", "consolas", "mono", "menlo", "code", "fixed", "typewriter"]
CAPTION_STARTS = ["figure", "fig.", "fig ", "image", "photo", "table", "chart", "diagram", "illustration"]
#: Code points of PDFDocEncoding that differ from Latin-1, from code 0x18 to 0x1F and from 0x80 to 0x9E.
PDFDOC_LOW = "˘ˇˆ˙˝˛˚˜"
PDFDOC_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
PDFDOC_EURO = "€"

SPACE = r"(?U)\s+"
#: What (?U)\s stands for.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARKER = re.compile(rf"[{re.escape(BULLETS)}]|\((?:[0-9]{{1,4}}|[A-Za-z]|(?ai:{ROMAN}))\)|(?:[0-9]+|[a-z]|{ROMAN})[.):]")


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def is_garbled(c: Column, share: float = 0.2) -> Column:
    """Whether more than a share of the characters are replacement marks, NUL, or non-ASCII that is neither letter, digit nor space."""
    good = F.regexp_replace(c, r"(?U)[\x{FFFD}\x00]|[^\x01-\x7F\p{L}\p{N}\s]", "")
    return F.coalesce((F.length(c) > 0) & ((F.length(c) - F.length(good)) / F.length(c) > share), F.lit(False))


def words(c: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.filter(F.split(c, SPACE), lambda w: F.length(w) > 0))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of word sets: 1 for equal texts, 0 if one of two different ones has no words."""
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(x, y)))


def normalize_for_repeat(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "#")


def list_marker(c: Column) -> Column:
    """The marker that a line starts with, or null: a bullet; (x) with a number, letter or Roman number; x. x) or x: in lower case."""
    start = F.regexp_replace(c, r"(?U)^\s+", "")
    bullet = F.when(F.substring(start, 1, 1).isin(*BULLETS), F.substring(start, 1, 1))
    ring = F.regexp_extract(start, rf"^(\((?:[0-9]{{1,4}}|[A-Za-z]|(?i:{ROMAN}))\))", 1)
    point = F.regexp_extract(start, rf"^((?:[0-9]+|[a-z]|{ROMAN})[.):])", 1)
    return F.coalesce(bullet, F.nullif(ring, F.lit("")), F.nullif(point, F.lit("")))


def font_style(name: Column) -> Column:
    """struct(bold, italic, monospaced) by the parts of a font's name, without its subset tag."""
    low = F.lower(F.regexp_replace(name, r"^[A-Z]{0,6}\+", ""))
    has = lambda parts: F.coalesce(low.rlike("|".join(p.replace("-", "\\-") for p in parts)), F.lit(False))
    return F.struct(has(BOLD_NAMES).alias("bold"), has(ITALIC_NAMES).alias("italic"), has(MONO_NAMES).alias("monospaced"))


def starts_list(text: str) -> bool:
    """Whether list_marker finds a marker, for one text of a Python stage."""
    return _MARKER.match(text.lstrip(WHITE)) is not None


@lru_cache(maxsize=4096)
def style_of(name: str | None) -> tuple[bool, bool, bool]:
    """(bold, italic, monospaced) as font_style has them, for one name of a Python stage."""
    low = re.sub(r"^[A-Z]{0,6}\+", "", name or "").lower()
    return tuple(any(p in low for p in parts) for parts in (BOLD_NAMES, ITALIC_NAMES, MONO_NAMES))


def inline_role(bold: Column, italic: Column, mono: Column) -> Column:
    return F.when(mono, "Code").when(bold & italic, "StrongEmphasis").when(bold, "Strong").when(italic, "Emphasis").otherwise("Normal")


def is_page_number(text: Column, y: Column, page_height: Column) -> Column:
    """Digits, with dashes, points or spaces around, of at most 6 bytes in all, in the upper or lower tenth of the page."""
    t = strip(text)
    margin = page_height * 0.1
    return (F.octet_length(t) <= 6) & t.rlike(r"^[-. ]*[0-9]+[-. ]*$") & ((y > page_height - margin) | (y < margin))


def is_caption(text: Column) -> Column:
    low = F.lower(text)
    starts = "^(?:" + "|".join(s.replace(".", "\\.") for s in CAPTION_STARTS) + ")"
    return low.rlike(starts) | ((F.octet_length(text) > 2) & text.rlike("^[0-9]"))


def block_standard_role(role: Column, level: Column) -> Column:
    """The standard structure type of a block's role; null for an unknown one."""
    return (
        F.when(role == "Heading", F.concat(F.lit("H"), level.cast("string")))
        .when(role.isin("Paragraph", "Code"), "P")
        .when(role == "ListItem", "LI")
        .when(role == "TableCell", "TD")
    )


def standard_role_of(role: str, level: int | None) -> str | None:
    """block_standard_role, for one block of a Python stage."""
    return f"H{level}" if role == "Heading" else {"Paragraph": "P", "Code": "P", "ListItem": "LI", "TableCell": "TD"}.get(role)


def decode_utf16be(b: Column) -> Column:
    """Text of UTF-16BE bytes; an odd last byte is left out, and a lone surrogate gives null instead of an error."""
    even = F.substring(b, F.lit(1), (F.floor(F.length(b) / 2) * 2).cast("int"))
    units = F.regexp_replace(F.hex(even), "(.{4})", "$1 ")
    pairs = F.regexp_replace(units, "D[89AB][0-9A-F]{2} D[C-F][0-9A-F]{2} ", "")
    return F.when(~pairs.rlike("(?:^| )D[89A-F]"), F.decode(even, "UTF-16BE"))


def pdfdoc_decode(b: Column) -> Column:
    """Text of PDFDocEncoding bytes: Latin-1, but for a few codes."""
    latin = F.decode(b, "ISO-8859-1")
    codes = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]))
    return F.translate(latin, codes, PDFDOC_LOW + PDFDOC_HIGH + PDFDOC_EURO)
