"""Invisible text over scanned pages, and tags from what was recognised."""

from __future__ import annotations

from collections.abc import Callable

from folioflow.pdf.document import Document
from folioflow.pdf.syntax import HexText, Name, Ref, Stream
from folioflow.pdf.writer import Builder, Content

# Fixed values
FONT = "F_OCR"
GAP = 30


def to_unicode(codes: dict[str, int], width: int) -> bytes:
    """A CMap for codes of so many bytes; characters beyond the basic plane stand as surrogates."""
    rows = [b"<%s> <%s>" % (format(n, f"0{2 * width}X").encode(), c.encode("utf-16-be").hex().upper().encode()) for c, n in codes.items()]
    parts = [b"%d beginbfchar\n%s\nendbfchar" % (len(p), b"\n".join(p)) for p in (rows[k : k + 100] for k in range(0, len(rows), 100))]
    space = b"<" + b"00" * width + b"> <" + b"FF" * width + b">"
    head = b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /OCR def\n/CMapType 2 def\n1 begincodespacerange\n" + space + b"\nendcodespacerange\n"
    return head + b"\n".join(parts) + b"\nendcmap\nend\nend"


def text_layer(words: list[dict], image: tuple[int, int], page: tuple[float, float]) -> tuple[bytes, bytes, int]:
    """Content, CMap and bytes of a code for words (text, x, y, width, height in pixels from the top left) on a page of so many points.

    Codes are given by first appearance, from 1; they have two bytes if there are more than 255 characters.
    """
    sx, sy = page[0] / max(1, image[0]), page[1] / max(1, image[1])
    shown = [w for w in words if w["text"]]
    codes: dict[str, int] = {}
    for w in shown:
        for c in w["text"] + " ":
            codes.setdefault(c, len(codes) + 1)
    width = 2 if len(codes) > 255 else 1
    c = Content().op("q").op("BT").op("Tr", 3)
    for w in shown:
        size = max(1.0, w["height"] * sy)
        data = b"".join(codes[x].to_bytes(width, "big") for x in w["text"])
        natural = len(w["text"]) * size * 0.5
        c.op("Tf", Name(FONT), round(size, 3)).op("Tz", round(100 * w["width"] * sx / natural, 2) if natural else 100)
        c.op("Tm", 1, 0, 0, 1, round(w["x"] * sx, 3), round(page[1] - (w["y"] + w["height"]) * sy, 3)).op("Tj", HexText(data))
    return c.op("ET").op("Q").bytes(), to_unicode(codes, width), width


def add_text_layer(b: Builder, index: int, words: list[dict], image: tuple[int, int]) -> None:
    doc = Document(b.to_bytes())
    box = doc.media_box(doc.pages()[index])
    data, cmap, width = text_layer(words, image, (box[2] - box[0], box[3] - box[1]))
    font: dict = {"Type": Name("Font"), "BaseFont": Name("Helvetica"), "ToUnicode": b.add(Stream({}, cmap))}
    if width == 1:
        font |= {"Subtype": Name("Type1")}
    else:
        descendant = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Helvetica"), "CIDSystemInfo": {"Registry": HexText(b"Adobe"), "Ordering": HexText(b"Identity"), "Supplement": 0}}
        font |= {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [b.add(descendant)]}
    b.append_content(index, data, {FONT: b.add(font)})


def strip_text_layers(b: Builder, index: int) -> int:
    """Takes the content streams that use the layer's font from a page; their number."""
    from folioflow.pdf import filters

    page = b.objects[b.page_root["Kids"][index]]
    own = page.get("Contents")
    parts = own if isinstance(own, list) else [own] if own else []
    keep = [p for p in parts if not (isinstance(s := b.objects.get(p) if isinstance(p, Ref) else p, Stream) and FONT.encode() in filters.decode(s))]
    page["Contents"] = keep
    return len(parts) - len(keep)


def paragraphs(words: list[dict], gap: int = GAP) -> list[list[dict]]:
    """Words in order; a new paragraph starts more than gap pixels below the last word's foot."""
    out: list[list[dict]] = []
    for w in words:
        if out and max(0, w["y"] - (out[-1][-1]["y"] + out[-1][-1]["height"])) <= gap:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def structure_of(words: list[dict]) -> list[tuple[str, str]]:
    """(type, text) for each paragraph: H1 to H6 by distinct heights above 1.4 times the median, else P."""
    words = [w for w in words if w["text"]]
    if not words:
        return []
    mid = lambda v: sorted(v)[len(v) // 2]
    body = mid([w["height"] for w in words])
    groups = [(mid([w["height"] for w in g]), " ".join(w["text"] for w in g)) for g in paragraphs(words)]
    sizes = sorted({h for h, _ in groups if h > int(body * 1.4)}, reverse=True)
    return [(f"H{min(6, sizes.index(h) + 1)}" if h in sizes else "P", t) for h, t in groups]


def auto_tagged(data: bytes, kinds: list[tuple[str, str]] | Callable[[Document], list[tuple[str, str]]], lang: str = "en-US") -> bytes:
    """A document with a structure tree of (type, text) elements, or of those that a function gives for it, unless it has one."""
    doc = Document(data)
    if doc.struct_elements() is not None or not (found := kinds(doc) if callable(kinds) else kinds):
        return data
    b = Builder(doc)
    b.structure(found, lang)
    return b.to_bytes()
