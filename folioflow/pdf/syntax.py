"""Objects and their syntax.

Python's own types stand for most objects: None, bool, int, float, list, dict (by str keys). Names, strings, references and streams have
small classes. Parsing is by recursive descent with a limit on depth; of repeated dictionary keys the last counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

DEPTH = 200
SPACE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"

_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_PLAIN_TEXT = re.compile(rb"[^()\\]*")
_INDIRECT = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
#: The common parts of objects, at once: a dictionary's key with a name, the start of a string, a reference or a number; arrays; ends.
_ENTRY = re.compile(
    rb"[\0\t\n\f\r ]*+/([^\0\t\n\f\r ()<>\[\]{}/%]*+)[\0\t\n\f\r ]*+(?:/([^\0\t\n\f\r ()<>\[\]{}/%]*+)|(\()"
    rb"|(\d++)[\0\t\n\f\r ]++(\d++)[\0\t\n\f\r ]++R(?![^\0\t\n\f\r ()<>\[\]{}/%])|([+-]?+(?:\d++\.?+\d*+|\.\d++)))"
)
_DICTIONARY = re.compile(rb"[\0\t\n\f\r ]*+(\d++)[\0\t\n\f\r ]++(\d++)[\0\t\n\f\r ]++obj[\0\t\n\f\r ]*+<<")
_END = re.compile(rb"[\0\t\n\f\r ]*+>>")
_REFS = re.compile(rb"\[(?:[\0\t\n\f\r ]*+\d++[\0\t\n\f\r ]++\d++[\0\t\n\f\r ]++R(?![^\0\t\n\f\r ()<>\[\]{}/%]))++[\0\t\n\f\r ]*+\]")
_INTEGERS = re.compile(rb"\[[\0\t\n\f\r ]*+(?:-?\d++(?:[\0\t\n\f\r ]++|(?=\])))*+\]")
_INTEGER = re.compile(rb"-?\d+")
_ENDSTREAM = re.compile(rb"[\0\t\n\f\r ]*+endstream(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_DIGITS = re.compile(rb"\d+")
_ENDOBJ = re.compile(rb"[\0\t\n\f\r ]*+endobj(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_HEX2 = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}


class PdfError(Exception):
    """A kind, as a word, and a message."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Name(str):
    __slots__ = ()


@lru_cache(maxsize=4096)
def _name_of(raw: bytes) -> Name:
    return Name(_HEX2.sub(lambda h: bytes([int(h[1], 16)]), raw).decode("utf-8", "replace"))


@lru_cache(maxsize=4096)
def _key_of(raw: bytes) -> str:
    return str(_name_of(raw))


@lru_cache(maxsize=4096)
def _written_name(name: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and is_regular(c) and c != 0x23 else b"#%02X" % c for c in name.encode())


class Text(bytes):
    """A string object: its bytes. `hexadecimal` says how it is written."""

    hexadecimal = False


class HexText(Text):
    hexadecimal = True


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    data: bytes


def is_regular(c: int) -> bool:
    return c not in SPACE and c not in DELIMITERS


def text_of(value) -> str | None:
    """Text of a string object: UTF-16BE after its mark, else strict UTF-8; None for anything else."""
    if not isinstance(value, Text):
        return None
    try:
        return value[2:].decode("utf-16-be") if value[:2] == b"\xfe\xff" else value.decode("utf-8")
    except UnicodeDecodeError:
        return None


def number_of(value) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def rect_of(value) -> list[float] | None:
    """The first four numbers of an array that has them."""
    if not isinstance(value, list) or len(value) < 4:
        return None
    out = [number_of(x) for x in value[:4]]
    return None if None in out else out


def plain_string(data: bytes, at: int) -> bytes | None:
    """What stands from a position to the next closing bracket, if no other bracket and no escape is in it. bytes.find is much faster than a class
    of characters."""
    end = data.find(b")", at)
    return data[at:end] if end >= 0 and data.find(b"(", at, end) < 0 and data.find(b"\\", at, end) < 0 else None


class Parser:
    """Reads objects from data at a position."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def word(self, token: bytes) -> bool:
        """Whether the keyword is next; it is read then."""
        end = self.at + len(token)
        if self.data.startswith(token, self.at) and (end >= len(self.data) or not is_regular(self.data[end])):
            self.at = end
            return True
        return False

    def fail(self, what: str) -> PdfError:
        return PdfError("Parse", f"{what} at byte {self.at}")

    def value(self, depth: int = 0):
        """The next object. Streams only follow dictionaries of indirect objects, see `indirect`."""
        if depth > DEPTH:
            raise self.fail("nested too deep")
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise self.fail("no object")
        c = data[at]
        if c == 0x2F:
            return self.name()
        if c == 0x28:
            return self.literal()
        if c == 0x3C:
            return self.dictionary(depth) if data[at + 1 : at + 2] == b"<" else self.hexadecimal()
        if c == 0x5B:
            if depth < DEPTH and (m := _REFS.match(data, at)):
                self.at, numbers = m.end(), list(map(int, _DIGITS.findall(m[0])))
                return list(map(Ref, numbers[::2], numbers[1::2]))
            if depth < DEPTH and (m := _INTEGERS.match(data, at)):
                self.at = m.end()
                return list(map(int, _INTEGER.findall(m[0])))
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(data):
                    raise self.fail("an array without end")
                if data[self.at] == 0x5D:
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if 0x30 <= c <= 0x39 and (m := _REF.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        if m := _NUMBER.match(data, at):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        for token, out in ((b"true", True), (b"false", False), (b"null", None)):
            if self.word(token):
                return out
        raise self.fail("no object")

    def name(self) -> Name:
        m = _REGULAR.match(self.data, self.at + 1)
        self.at = m.end()
        return _name_of(m[0])

    def literal(self) -> Text:
        data, at, depth = self.data, self.at + 1, 1
        if (plain := plain_string(data, at)) is not None:
            self.at = at + len(plain) + 1
            return Text(plain)
        end = _PLAIN_TEXT.match(data, at).end()
        out, at = bytearray(data[at:end]), end
        while at < len(data):
            c = data[at]
            if c == 0x5C:
                at += 1
                if at >= len(data):
                    break
                e = data[at]
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif 0x30 <= e <= 0x37:
                    end = at + 1
                    while end < at + 3 and end < len(data) and 0x30 <= data[end] <= 0x37:
                        end += 1
                    out.append(int(data[at:end], 8) & 255)
                    at = end - 1
                elif e == 0x0D:
                    at += data[at + 1 : at + 2] == b"\n"
                elif e != 0x0A:
                    out.append(e)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at + 1
                    return Text(bytes(out))
                out.append(c)
            else:
                end = _PLAIN_TEXT.match(data, at).end()
                out += data[at:end]
                at = end - 1
            at += 1
        raise self.fail("a string without end")

    def hexadecimal(self) -> HexText:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise self.fail("a string without end")
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
        self.at = end + 1
        return HexText(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))

    def entries(self, out: dict) -> None:
        """Reads entries of a dictionary as long as they are plain: a name, a string without escapes or brackets, a reference or a number."""
        data, at, entry = self.data, self.at, _ENTRY.match
        while m := entry(data, at):
            kind = m.lastindex
            if kind == 2:
                out[_key_of(m[1])] = _name_of(m[2])
            elif kind == 5:
                out[_key_of(m[1])] = Ref(int(m[4]), int(m[5]))
            elif kind == 6:
                number = m[6]
                out[_key_of(m[1])] = float(number) if b"." in number else int(number)
            else:
                at = m.end()
                if (text := plain_string(data, at)) is None:
                    return
                out[_key_of(m[1])] = Text(text)
                self.at = at = at + len(text) + 1
                continue
            self.at = at = m.end()

    def dictionary(self, depth: int = 0) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            if depth < DEPTH:
                self.entries(out)
            self.skip()
            if self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            if self.at >= len(self.data) or self.data[self.at] != 0x2F:
                raise self.fail("no key")
            key = self.name()
            out[str(key)] = self.value(depth + 1)

    def stream(self, head: dict) -> Stream | None:
        """The stream that follows a dictionary, if one does."""
        self.skip()
        if not self.word(b"stream"):
            return None
        data = self.data
        self.at += 2 if data.startswith(b"\r\n", self.at) else data[self.at : self.at + 1] in (b"\n", b"\r")
        n = head.get("Length")
        if isinstance(n, int) and 0 <= n <= len(data) - self.at:
            if m := _ENDSTREAM.match(data, self.at + n):
                body, self.at = data[self.at : self.at + n], m.end()
                return Stream(head, body)
            body, after = data[self.at : self.at + n], Parser(data, self.at + n)
            after.skip()
            if after.word(b"endstream"):
                self.at = after.at
                return Stream(head, body)
        end = data.find(b"endstream", self.at)
        if end < 0:
            raise self.fail("a stream without end")
        body = data[self.at : end].rstrip(b"\r\n")
        self.at = end + 9
        return Stream(head, body)

    def indirect(self) -> tuple[Ref, object]:
        """`N G obj ... endobj`."""
        self.skip()
        if not (m := _INDIRECT.match(self.data, self.at)):
            raise self.fail("no indirect object")
        self.at = m.end()
        value = self.value()
        if end := _ENDOBJ.match(self.data, self.at):
            self.at = end.end()
            return Ref(int(m[1]), int(m[2])), value
        if isinstance(value, dict) and (s := self.stream(value)):
            value = s
        self.skip()
        if not self.word(b"endobj"):
            raise self.fail("no endobj")
        return Ref(int(m[1]), int(m[2])), value


def indirect(data: bytes, at: int) -> tuple[int, int, object]:
    """Both numbers of the indirect object at a position, and the object."""
    p = Parser(data, at)
    if m := _DICTIONARY.match(data, at):
        # entries as they mostly are; anything else is read from the start
        out: dict = {}
        p.at = m.end()
        p.entries(out)
        if (e := _END.match(data, p.at)) and (e := _ENDOBJ.match(data, e.end())):
            return int(m[1]), int(m[2]), out
        p.at = at
    (num, gen), value = p.indirect()
    return num, gen, value


def write(value) -> bytes:
    """An object as it stands in a file."""
    kind = type(value)
    if kind is dict:
        return b"<<" + b" ".join([_written_name(k) + b" " + write(v) for k, v in sorted(value.items())]) + b">>"
    if kind is Ref:
        return b"%d %d R" % value
    if kind is Name:
        return _written_name(value)
    if kind is int:
        return b"%d" % value
    if kind is Text:
        return b"(" + value.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"
    if kind is list:
        return b"[" + b" ".join([write(v) for v in value]) + b"]"
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        s = f"{value:.6f}".rstrip("0").rstrip(".")
        return (s if s not in ("-0", "") else "0").encode() if "." in f"{value:.6f}" else s.encode()
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, HexText):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, bytes):
        body = value.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n")
        return b"(" + body + b")"
    if isinstance(value, str):
        return _written_name(value)
    if isinstance(value, list):
        return b"[" + b" ".join(map(write, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(write(Name(k)) + b" " + write(v) for k, v in sorted(value.items())) + b">>"
    if isinstance(value, Stream):
        return write(value.dict | {"Length": len(value.data)}) + b"\nstream\n" + value.data + b"\nendstream"
    raise TypeError(type(value))
