"""Building, editing and serialising documents."""

from __future__ import annotations

from folioflow.pdf import crypto, filters, images
from folioflow.pdf.document import Document
from folioflow.pdf.syntax import HexText, Name, PdfError, Ref, Stream, Text, write


def text_object(value: str) -> Text:
    """A string object: ASCII as it is, else UTF-16BE after its mark."""
    return Text(value.encode("ascii")) if value.isascii() else Text(b"\xfe\xff" + value.encode("utf-16-be", "surrogatepass"))


_FIXED = {Ref, Name, Text, HexText, int, float, bool, type(None)}


def _copied(value):
    """A copy of an object that shares only what can't change."""
    if type(value) in _FIXED:
        return value
    if isinstance(value, list):
        return [_copied(v) for v in value]
    if isinstance(value, dict):
        return {k: _copied(v) for k, v in value.items()}
    return Stream(_copied(value.dict), value.data) if isinstance(value, Stream) else value


class Content:
    """Content operators, one after the other."""

    def __init__(self):
        self.parts: list[bytes] = []

    def op(self, name: str, *operands) -> Content:
        self.parts.append(b" ".join([*map(write, operands), name.encode()]))
        return self

    def text(self, font: str, size: float, x: float, y: float, shown: bytes) -> Content:
        return self.op("BT").op("Tf", Name(font), size).op("Td", x, y).op("Tj", Text(shown)).op("ET")

    def lines(self, font: str, size: float, x: float, y: float, leading: float, shown: list[bytes]) -> Content:
        self.op("BT").op("Tf", Name(font), size).op("TL", leading).op("Td", x, y)
        if shown:
            self.parts.append(b"\nT*\n".join([write(Text(line)) + b" Tj" for line in shown]))
        return self.op("ET")

    def rect(self, x: float, y: float, width: float, height: float, paint: str = "f") -> Content:
        return self.op("re", x, y, width, height).op(paint)

    def line(self, x0: float, y0: float, x1: float, y1: float) -> Content:
        return self.op("m", x0, y0).op("l", x1, y1).op("S")

    def image(self, name: str, x: float, y: float, width: float, height: float) -> Content:
        return self.op("q").op("cm", width, 0, 0, height, x, y).op("Do", Name(name)).op("Q")

    def marked(self, tag: str, mcid: int, inner: Content) -> Content:
        """What another content draws, as marked content of a structure element."""
        self.op("BDC", Name(tag), {"MCID": mcid})
        self.parts += inner.parts
        return self.op("EMC")

    def bytes(self) -> bytes:
        return b"\n".join(self.parts)


class Builder:
    """A new document, or the objects of a parsed one, to be changed and written."""

    def __init__(self, base: Document | None = None):
        self.version = base.version if base else "1.7"
        self._top: tuple[dict, int, int] | None = None
        if base:
            self.objects = {r: _copied(v) for r, v in base.objects.items()}
            self.trailer = {k: v for k, v in base.trailer.items() if k in ("Root", "Info", "ID")}
        else:
            self.objects = {Ref(1, 0): {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, Ref(2, 0): {"Type": Name("Pages"), "Kids": [], "Count": 0}}
            self.trailer = {"Root": Ref(1, 0)}

    @property
    def catalog(self) -> dict:
        return self.objects[self.trailer["Root"]]

    @property
    def page_root(self) -> dict:
        return self.objects[self.catalog["Pages"]]

    def add(self, value) -> Ref:
        # the largest number is looked for again only when others changed the objects since the last call
        known = self._top is not None and self._top[0] is self.objects and self._top[1] == len(self.objects)
        ref = Ref((self._top[2] if known else max(r.num for r in self.objects)) + 1, 0)
        self.objects[ref] = value
        self._top = self.objects, len(self.objects), ref.num
        return ref

    def font(self, base: str = "Helvetica", encoding: str = "WinAnsiEncoding") -> Ref:
        return self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name(encoding)})

    def image(self, data: bytes) -> Ref:
        """An image object of a JPEG or PNG file, its alpha as a soft mask."""
        image, mask = images.from_jpeg(data) if data[:2] == b"\xff\xd8" else images.from_png(data)
        if mask is not None:
            image.dict["SMask"] = self.add(mask)
        return self.add(image)

    def page(self, content: bytes | None = None, fonts: dict[str, Ref] | None = None, width: float = 612, height: float = 792, compress: bool = True, **extra) -> Ref:
        page = {"Type": Name("Page"), "Parent": self.catalog["Pages"], "MediaBox": [0, 0, width, height], "Resources": {"Font": dict(fonts or {})}} | extra
        if content is not None:
            page["Contents"] = self.add(filters.encode_flate(content) if compress else Stream({}, content))
        ref = self.add(page)
        self.page_root["Kids"].append(ref)
        self.page_root["Count"] += 1
        return ref

    def metadata(self, **fields: str) -> None:
        self.trailer["Info"] = self.add({k: text_object(v) for k, v in fields.items()})

    def outline(self, titles: list[tuple[str, int, list]]) -> None:
        """titles: (title, page, children) trees."""

        def chain(items: list, parent: Ref) -> list[Ref]:
            refs = [self.add({"Title": text_object(t), "Dest": [p, Name("Fit")], "Parent": parent}) for t, p, _ in items]
            for k, (ref, (_, _, kids)) in enumerate(zip(refs, items, strict=True)):
                node = self.objects[ref]
                if k + 1 < len(refs):
                    node["Next"] = refs[k + 1]
                if kids:
                    own = chain(kids, ref)
                    node |= {"First": own[0], "Last": own[-1], "Count": len(own)}
            return refs

        root = self.add({"Type": Name("Outlines")})
        refs = chain(titles, root)
        if refs:
            self.objects[root] |= {"First": refs[0], "Last": refs[-1]}
        self.catalog["Outlines"] = root

    def fields(self, trees: list[tuple[str, str | None, list]]) -> None:
        """trees: (name, value, children); the leaves are text fields."""

        def node(name: str, value: str | None, kids: list) -> Ref:
            head: dict = {"T": text_object(name)}
            if kids:
                head["Kids"] = [node(*k) for k in kids]
            else:
                head |= {"FT": Name("Tx"), "V": text_object(value or "")}
            return self.add(head)

        self.catalog["AcroForm"] = self.add({"Fields": [node(*t) for t in trees]})

    def structure(self, kinds: list[tuple[str, str]], lang: str | None = "en-US") -> int:
        """A flat structure tree of (type, text) elements under one Document; their number."""
        refs = [self.add({"Type": Name("StructElem"), "S": Name(k), "ActualText": Text(t.encode()), "K": n}) for n, (k, t) in enumerate(kinds)]
        root = self.add({"Type": Name("StructElem"), "S": Name("Document"), "K": refs})
        tree = {"Type": Name("StructTreeRoot"), "K": root} | ({"Lang": text_object(lang)} if lang else {})
        catalog = self.catalog
        catalog |= {"StructTreeRoot": self.add(tree), "MarkInfo": {"Marked": True}} | ({"Lang": text_object(lang)} if lang else {})
        return len(refs)

    # -- edits of the pages under the root

    def _kids(self) -> list:
        kids = self.page_root["Kids"]
        if any("Kids" in self.objects[k] for k in kids):
            raise PdfError("Structure", "the page tree is nested")
        return kids

    def remove_page(self, index: int) -> None:
        del self._kids()[index]
        self.page_root["Count"] -= 1

    def rotate_page(self, index: int, degrees: int) -> None:
        if degrees % 90:
            raise PdfError("Structure", "a multiple of 90 degrees")
        page = self.objects[self._kids()[index]]
        page["Rotate"] = (page.get("Rotate", 0) + degrees) % 360

    def reorder_pages(self, order: list[int]) -> None:
        kids = self._kids()
        if len(order) != len(kids):
            raise PdfError("Structure", "an index for each page")
        self.page_root["Kids"] = [kids[k] for k in order]

    def merge(self, other: Document) -> None:
        """The pages of another document after these; its objects get the numbers after the largest here."""
        shift = max(r.num for r in self.objects)
        move = lambda v: Ref(v.num + shift, v.gen) if isinstance(v, Ref) else [move(x) for x in v] if isinstance(v, list) else {k: move(x) for k, x in v.items()} if isinstance(v, dict) else Stream(move(v.dict), v.data) if isinstance(v, Stream) else v
        for ref, value in other.objects.items():
            self.objects[move(ref)] = move(value)
        root = self.catalog["Pages"]
        kids = [move(k) for k in other.get(other.get(other.catalog, "Pages"), "Kids") or []]
        for k in kids:
            self.objects[k]["Parent"] = root
        self.page_root["Kids"] += kids
        self.page_root["Count"] += other.page_count

    def set_field(self, name: str, value: str) -> bool:
        from_ = Document(self.to_bytes())
        for f in from_.form_fields():
            if f["name"] == name and f["ref"] in self.objects:
                self.objects[f["ref"]]["V"] = text_object(value)
                self.objects[f["ref"]].pop("AP", None)
                return True
        return False

    def append_content(self, index: int, data: bytes, fonts: dict[str, Ref] | None = None) -> None:
        page = self.objects[self._kids()[index]]
        own = page.get("Contents")
        page["Contents"] = [*(own if isinstance(own, list) else [own] if own else []), self.add(filters.encode_flate(data))]
        res = page.setdefault("Resources", {})
        res["Font"] = dict(fonts or {}) | res.get("Font", {})

    # -- bytes

    def to_bytes(self, first: list[Ref] | None = None, written: dict[Ref, bytes] | None = None) -> bytes:
        """Objects by number with a classic table; `first` objects stand first. written: bytes of objects that are known."""
        out = bytearray(f"%PDF-{self.version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1"))
        places = {}
        ahead, written = set(first or ()), written or {}
        for ref in [*(first or []), *[r for r in sorted(self.objects) if r not in ahead]]:
            places[ref.num] = len(out)
            out += b"%d 0 obj\n" % ref.num + (written[ref] if ref in written else write(self.objects[ref])) + b"\nendobj\n"
        return self._finish(out, places)

    def _finish(self, out: bytearray, places: dict[int, int], prev: int | None = None) -> bytes:
        at, top = len(out), max(places)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (top + 1)
        for num in range(1, top + 1):
            out += b"%010d 00000 n \n" % places[num] if num in places else b"0000000000 65535 f \n"
        trailer = self.trailer | {"Size": top + 1} | ({"Prev": prev} if prev is not None else {})
        return bytes(out + b"trailer\n" + write(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)

    def to_linearized(self) -> bytes:
        """The first page's objects at the front, after a linearisation dictionary of fixed width with the true numbers."""
        kids = self._kids()
        if not kids:
            return self.to_bytes()
        front, todo = {}, [kids[0]]
        while todo:
            ref = todo.pop()
            if ref in front or ref not in self.objects or ref == self.catalog["Pages"]:
                continue
            front[ref] = None
            stack = [self.objects[ref]]
            while stack:
                v = stack.pop()
                if isinstance(v, Ref):
                    todo.append(v)
                elif isinstance(v, list):
                    stack += v
                elif isinstance(v, dict):
                    stack += [x for k, x in v.items() if k != "Parent"]
                elif isinstance(v, Stream):
                    stack.append(v.dict)
        head = self.add({"Linearized": 1, "L": 0, "N": len(kids), "O": kids[0].num, "E": 0, "T": 0, "H": [0, 0]})
        data, written = b"", {r: write(v) for r, v in self.objects.items() if r != head}
        for _ in range(4):  # lengths settle, as all numbers have a width of their own
            data = self.to_bytes([head, *front], written)
            last = max((data.find(b"\n%d 0 obj\n" % r.num) for r in front), default=0)
            ends = data.find(b"endobj", last) + 7
            new = {"L": len(data), "E": ends, "T": data.rfind(b"xref\n0 ")}
            if all(self.objects[head][k] == v for k, v in new.items()):
                break
            self.objects[head] |= new
        return data

    def to_incremental(self, original: bytes) -> bytes:
        """The original, and after it all objects with a table that points back."""
        prev = int(original[original.rfind(b"startxref") + 9 :].split()[0])
        out, places = bytearray(original if original.endswith(b"\n") else original + b"\n"), {}
        for ref in sorted(self.objects):
            places[ref.num] = len(out)
            out += b"%d 0 obj\n" % ref.num + write(self.objects[ref]) + b"\nendobj\n"
        return self._finish(out, places, prev)

    def to_encrypted(self, user: str, owner: str = "", permissions: int = -4, aes: bool = True, doc_id: bytes = b"0123456789abcdef") -> bytes:
        """Under the standard handler of revision 4 with AES-128, or 3 with RC4."""
        rev, length = (4, 16) if aes else (3, 16)
        o = crypto.owner_value((owner or user).encode(), user.encode(), rev, length)
        key = crypto.key_r2_r4(user.encode(), o, permissions, doc_id, rev, length)
        u = crypto.user_value(key, doc_id, rev).ljust(32, b"\0")
        head: dict = {"Filter": Name("Standard"), "V": 4 if aes else 2, "R": rev, "Length": 128, "O": HexText(o), "U": HexText(u), "P": permissions}
        if aes:
            head |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16, "AuthEvent": Name("DocOpen")}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

        def seal(v, ref: Ref):
            k = crypto.object_key(key, ref, aes)
            close = (lambda b: crypto.aes_seal(k, k[::-1].ljust(16, b"\1")[:16], b)) if aes else (lambda b: crypto.rc4(k, b))
            if isinstance(v, Text):
                return HexText(close(bytes(v)))
            if isinstance(v, list):
                return [seal(x, ref) for x in v]
            if isinstance(v, dict):
                return {n: seal(x, ref) for n, x in v.items()}
            return Stream(v.dict, close(v.data)) if isinstance(v, Stream) else v

        out = Builder()
        out.version, out.trailer = self.version, dict(self.trailer)
        out.objects = {r: seal(v, r) for r, v in self.objects.items()}
        out.trailer |= {"Encrypt": out.add(head), "ID": [HexText(doc_id), HexText(doc_id)]}
        return out.to_bytes()


def text_document(text: str, lines_per_page: int = 46, size: float = 12, leading: float = 14, **info: str) -> bytes:
    """A document with a page for each so many lines, set in Helvetica at x 72 from y 720 down."""
    b = Builder()
    font = b.font()
    lines = text.split("\n")
    for k in range(0, len(lines), lines_per_page):
        shown = [x.encode("cp1252", "replace") for x in lines[k : k + lines_per_page]]
        b.page(Content().lines("F1", size, 72, 720, leading, shown).bytes(), {"F1": font})
    if info:
        b.metadata(**info)
    return b.to_bytes()
