"""Content streams: tokens, plain text and positioned runs."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

from folioflow.pdf.fonts import PDFDOC, Font
from folioflow.pdf.syntax import Name, Parser, PdfError, Text, number_of, plain_string

_OPERATOR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
#: The common tokens: the start of a string, a number that starts no reference, an operator.
_COMMON = re.compile(
    rb"[\0\t\n\f\r ]*(?:(\()|((?>[+-]?(?:\d+\.?\d*|\.\d+)))(?![\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%]))"
    rb"|(?!true|false|null)([^\0\t\n\f\r ()<>\[\]{}/%+\-.0-9][^\0\t\n\f\r ()<>\[\]{}/%]*))"
)
_END_IMAGE = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)")


def tokens(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands); an inline image comes as ("BI", [dictionary, data]). What can't be read is left out."""
    p, operands, common = Parser(data), [], _COMMON.match
    while True:
        if m := common(data, p.at):
            p.at, kind = m.end(), m.lastindex
            if kind == 1:
                if (plain := plain_string(data, p.at)) is not None:
                    operands.append(Text(plain))
                    p.at += len(plain) + 1
                    continue
                p.at -= 1
            elif kind == 2:
                operands.append(float(m[2]) if b"." in m[2] else int(m[2]))
                continue
            elif m[3] != b"BI":
                yield m[3].decode("latin-1"), operands
                operands = []
                continue
            else:
                p.at = m.start(3)
        p.skip()
        if p.at >= len(data):
            return
        c = data[p.at]
        if c in b"/(<[+-.0123456789" or p.data.startswith((b"true", b"false", b"null"), p.at):
            try:
                operands.append(p.value())
                continue
            except PdfError:
                pass
        m = _OPERATOR.match(data, p.at)
        if not m:
            p.at += 1
            continue
        p.at, name = m.end(), m[0].decode("latin-1")
        if name == "BI":
            image = _inline_image(p)
            if image:
                yield "BI", list(image)
        else:
            yield name, operands
        operands = []


def _inline_image(p: Parser) -> tuple[dict, bytes] | None:
    head: dict = {}
    while True:
        p.skip()
        if p.word(b"ID"):
            break
        try:
            key = str(p.name())
            head[key] = p.value()
        except (PdfError, IndexError):
            return None
        if p.at >= len(p.data):
            return None
    p.at += p.data[p.at : p.at + 1] in (b" ", b"\n", b"\r", b"\t")
    m = _END_IMAGE.search(p.data, p.at)
    if not m:
        return None
    data, p.at = p.data[p.at : m.start()], m.end()
    return head, data


def _number(operands: list, k: int, default: float = 0.0) -> float:
    v = number_of(operands[k]) if -len(operands) <= k < len(operands) else None
    return default if v is None else v


_PDFDOC = "".join(PDFDOC)


def _plain(data: bytes) -> str:
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    return codecs.charmap_decode(data, "strict", _PDFDOC)[0]


def plain_text(data: bytes, fonts: dict[str, Font] | None = None) -> str:
    """Shown strings in stream order; moves to other lines give line feeds, wide gaps and new text matrices give spaces."""
    fonts = fonts or {}
    out: list[str] = []
    last = ""
    font, stack, inside = None, [], False

    def push(s: str) -> None:
        nonlocal last
        if s:
            out.append(s)
            last = s[-1]

    def decoded(b: bytes) -> str:
        return fonts[font].text(b) if font in fonts else _plain(b)

    def newline() -> None:
        if last and last != "\n":
            push("\n")

    for op, args in tokens(data):
        if op == "BT":
            inside = True
        elif op == "ET":
            inside = False
        elif op == "q":
            stack.append(font)
        elif op == "Q":
            font = stack.pop() if stack else font
        elif op == "Tf" and args and isinstance(args[0], Name):
            font = str(args[0])
        elif not inside:
            continue
        elif op in ("Tj", "'", '"'):
            if args and isinstance(args[-1], Text):
                push(decoded(args[-1]))
            if op != "Tj":
                push("\n")
        elif op == "TJ" and args and isinstance(args[-1], list):
            for item in args[-1]:
                if isinstance(item, Text):
                    push(decoded(item))
                elif (n := number_of(item)) is not None and n <= -100:
                    push(" ")
        elif op in ("Td", "TD"):
            if abs(_number(args, 1)) > 0.5:
                newline()
        elif op == "T*":
            newline()
        elif op == "Tm" and last not in ("", " ", "\n"):
            push(" ")
    return "".join(out).strip()


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def concat(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def text_runs(data: bytes, fonts: dict[str, Font] | None = None, spec_ctm: bool = False) -> list[dict]:
    """A run for each shown string: text, font, size, place, estimated extent, fill colour, rendering mode.

    `cm` puts the new matrix after the current one unless spec_ctm asks for the standard's order; the two differ for matrices that don't
    commute. `q` saves the matrix alone.
    """
    fonts = fonts or {}
    out: list[dict] = []
    ctm, stack, color = IDENTITY, [], [0.0, 0.0, 0.0, 1.0]
    tm = line = IDENTITY
    inside = False
    s = {"font": "", "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "Ts": 0.0, "Tr": 0}

    def show(b: bytes) -> None:
        font = fonts.get(s["font"])
        text = font.text(b) if font else b.decode("utf-8", "replace")
        scale = (ctm[0] ** 2 + ctm[1] ** 2) ** 0.5
        size = s["size"] * scale
        n = len(text)
        width = n * s["size"] * 0.5 * s["Tz"] + n * s["Tc"] + text.count(" ") * s["Tw"]
        x0, y0 = tm[4], tm[5] + s["Ts"]
        x, y = x0 * ctm[0] + y0 * ctm[2] + ctm[4], x0 * ctm[1] + y0 * ctm[3] + ctm[5]
        if text:
            name = font.name if font else s["font"]
            out.append({"text": text, "font_name": name, "font_size": size, "x": x, "y": y, "width": width * scale, "height": size, "color": list(color), "rendering_mode": s["Tr"]})
            advance(width)

    def advance(by: float) -> None:
        """Along x whatever the text matrix is."""
        nonlocal tm
        tm = (*tm[:4], tm[4] + by, tm[5])

    def move(x: float, y: float) -> None:
        nonlocal tm, line
        p, q, r, s_, t, u = line
        tm = line = (p + 0 * r, q + 0 * s_, 0 * p + r, 0 * q + s_, x * p + y * r + t, x * q + y * s_ + u)

    for op, a in tokens(data):
        if op == "Tj":
            if inside and a and isinstance(a[-1], Text):
                show(a[-1])
        elif op == "T*":
            move(0, -s["TL"])
        elif op == "q":
            stack.append(ctm)
        elif op == "Q":
            ctm = stack.pop() if stack else IDENTITY
        elif op == "cm" and len(a) >= 6:
            m = tuple(_number(a, k) for k in range(6))
            ctm = concat(m, ctm) if spec_ctm else concat(ctm, m)
        elif op == "g" or (op in ("sc", "scn") and len(a) == 1):
            color = [_number(a, 0)] * 3 + [1.0]
        elif op == "rg" or (op in ("sc", "scn") and len(a) == 3):
            color = [_number(a, k) for k in range(3)] + [1.0]
        elif op == "k" or (op in ("sc", "scn") and len(a) == 4):
            color = [(1 - _number(a, k)) * (1 - _number(a, 3)) for k in range(3)] + [1.0]
        elif op == "BT":
            tm, line, inside = IDENTITY, IDENTITY, True
        elif op == "ET":
            inside = False
        elif op == "Tf" and len(a) >= 2:
            s["font"], s["size"] = str(a[0]), _number(a, 1)
        elif op == "Td":
            move(_number(a, 0), _number(a, 1))
        elif op == "TD":
            s["TL"] = -_number(a, 1)
            move(_number(a, 0), _number(a, 1))
        elif op == "Tm" and len(a) >= 6:
            tm = line = tuple(_number(a, k) for k in range(6))
        elif op in ("Tc", "Tw", "TL", "Ts"):
            s[op] = _number(a, 0)
        elif op == "Tz":
            s["Tz"] = _number(a, 0, 100.0) / 100
        elif op == "Tr":
            s["Tr"] = int(_number(a, 0))
        elif not inside:
            continue
        elif op in ("'", '"'):
            if op == '"' and len(a) >= 3:
                s["Tw"], s["Tc"] = _number(a, 0), _number(a, 1)
            move(0, -s["TL"])
            if a and isinstance(a[-1], Text):
                show(a[-1])
        elif op == "TJ" and a and isinstance(a[-1], list):
            for item in a[-1]:
                if isinstance(item, Text):
                    show(item)
                elif (n := number_of(item)) is not None:
                    advance(-n / 1000 * s["size"] * s["Tz"])
    return out


def inline_images(data: bytes) -> list[tuple[dict, bytes]]:
    return [(a[0], a[1]) for op, a in tokens(data) if op == "BI"]


