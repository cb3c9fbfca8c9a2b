"""Files as object graphs, and what can be extracted from them."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from folioflow.pdf import content, crypto, filters
from folioflow.pdf.fonts import Font, font_of
from folioflow.pdf.syntax import Name, Parser, PdfError, Ref, Stream, Text, indirect, number_of, rect_of, text_of

# Fixed values
HEADER_WINDOW, START_WINDOW, CHAIN, PAGE_DEPTH, PARENTS, MOST_OBJECTS = 1024, 1024, 32, 64, 32, 1_000_000
OUTLINE_DEPTH, SIBLINGS, TREE_DEPTH, FIELD_DEPTH = 32, 10_000, 64, 32
NAMESPACES = {"dc": "http://purl.org/dc/elements/1.1/", "xmp": "http://ns.adobe.com/xap/1.0/", "pdf": "http://ns.adobe.com/pdf/1.3/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
XMP_FIELDS = {"title": "dc:title", "author": "dc:creator", "subject": "dc:description", "keywords": "pdf:Keywords", "creator": "xmp:CreatorTool", "producer": "pdf:Producer", "creation_date": "xmp:CreateDate", "modification_date": "xmp:ModifyDate"}
INFO_FIELDS = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate", "modification_date": "ModDate"}
SUB_FILTERS = ["adbe.pkcs7.detached", "adbe.pkcs7.sha1", "ETSI.CAdES.detached", "ETSI.RFC3161"]
STANDARD_ROLES = ["Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "P", "H", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Quote", "Note", "FENote", "Reference", "BibEntry", "Code", "Link", "Annot", "Ruby", "Warichu", "Figure", "Formula", "Form", "Title", "Em", "Strong", "Sub", "Aside", "Artifact"]

_SUBSECTION = re.compile(rb"(\d+)[ \t]+(\d+)[ \t]*[\r\n]*")
_PLACE = re.compile(rb"\s*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")
#: Entries of 20 bytes each, as the standard has them.
_PLACES = re.compile(rb"(?:\d{10} \d{5} [nf](?: \n| \r|\r\n))*+")
_LEVEL = re.compile(r"H([1-6])?")
_OBJECT = re.compile(rb"(?:^|(?<=[\r\n]))[ \t]*(\d+)[ \t]+(\d+)[ \t]+obj(?![A-Za-z])")


class Document:
    """Parsed from bytes: version, trailer and objects by reference."""

    def __init__(self, data: bytes, password: str | None = None):
        at = data[:HEADER_WINDOW].find(b"%PDF-")
        if at < 0:
            raise PdfError("Header", "no header")
        self.data = data[at:]
        m = re.match(rb"%PDF-(\d)\.(\d)", self.data)
        if not m:
            raise PdfError("Header", "no version")
        self.version = f"{int(m[1])}.{int(m[2])}"
        self.objects: dict[Ref, object] = {}
        self.trailer: dict = {}
        packed: list[tuple[int, int]] = []
        try:
            self._read(self._chain(), packed)
            if not self.objects:
                raise PdfError("Xref", "no objects")
        except (PdfError, ValueError, IndexError, RecursionError, OverflowError):
            self.objects, packed = {}, []
            self._rebuild()
        self.numbers = {}
        self._number()
        self.handler = None
        if "Encrypt" in self.trailer:
            self._decrypt((password or "").encode())
        if self._unpack({c for c, _ in packed}):
            self._number()
        self._fonts: dict = {}

    def _number(self) -> None:
        self.numbers = {r.num: r for r in sorted(self.objects)}

    # -- file structure

    def _chain(self) -> list[tuple[dict, dict]]:
        """(entries, trailer) of each section, the oldest first."""
        tail = self.data[-START_WINDOW:]
        at = tail.rfind(b"startxref")
        m = re.match(rb"startxref\s+(\d+)", tail[at:]) if at >= 0 else None
        if not m:
            raise PdfError("Xref", "no startxref")
        place, seen, out = int(m[1]), set(), []
        while place is not None and place not in seen and len(out) < CHAIN:
            seen.add(place)
            if place >= len(self.data):
                raise PdfError("Xref", "a place behind the end")
            p = Parser(self.data, place)
            p.skip()
            entries, trailer = self._table(p) if p.word(b"xref") else self._stream(p)
            out.append((entries, trailer))
            prev = trailer.get("Prev")
            place = int(prev) if isinstance(prev, int | float) and not isinstance(prev, bool) else None
        return out[::-1]

    def _table(self, p: Parser) -> tuple[dict, dict]:
        entries: dict[int, tuple] = {}
        while True:
            p.skip()
            if p.word(b"trailer"):
                trailer = p.value()
                if not isinstance(trailer, dict):
                    raise p.fail("no trailer")
                return entries, trailer
            m = _SUBSECTION.match(self.data, p.at)
            if not m:
                raise p.fail("no subsection")
            p.at = m.end()
            first, n = int(m[1]), int(m[2])
            block = self.data[p.at : p.at + 20 * n]
            if n and len(block) == 20 * n and _PLACES.fullmatch(block):
                entries |= {first + k: (1 if kind == b"n" else 0, int(a), int(b)) for k, (a, b, kind) in enumerate(_PLACE.findall(block))}
                p.at += 20 * n
                continue
            for k in range(n):
                e = _PLACE.match(self.data, p.at)
                if not e:
                    raise p.fail("no entry")
                p.at = e.end()
                entries[first + k] = (1 if e[3] == b"n" else 0, int(e[1]), int(e[2]))

    def _stream(self, p: Parser) -> tuple[dict, dict]:
        _, s = p.indirect()
        if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
            raise p.fail("no cross-reference stream")
        widths = s.dict.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths[:3]):
            raise p.fail("no widths")
        data, size = filters.decode(s), sum(widths[:3])
        index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
        entries, at = {}, 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for k in range(count):
                row = data[at : at + size]
                if len(row) < size or not size:
                    return entries, s.dict
                at += size
                f, cut = [], 0
                for w in widths[:3]:
                    f.append(int.from_bytes(row[cut : cut + w], "big") if w else None)
                    cut += w
                entries[first + k] = (1 if f[0] is None else f[0], f[1] or 0, f[2] or 0)
        return entries, s.dict

    def _read(self, chain: list[tuple[dict, dict]], packed: list) -> None:
        places: dict[int, tuple] = {}
        for entries, trailer in chain:
            for num, e in entries.items():
                if e[0] == 0:
                    places.pop(num, None)
                else:
                    places[num] = e
            self.trailer |= trailer
        for num, (kind, a, b) in places.items():
            if kind == 2:
                packed.append((a, b))
                continue
            if kind != 1 or not 0 <= a < len(self.data):
                continue
            try:
                found, _, value = indirect(self.data, a)
                if found == num:
                    self.objects[Ref(num, b)] = value
            except (PdfError, ValueError, IndexError, RecursionError, OverflowError):
                continue

    def _rebuild(self) -> None:
        """Objects found by their first lines; of one number the last counts. The first catalogue is the root."""
        self.trailer = {}
        for m in _OBJECT.finditer(self.data):
            num, gen = int(m[1]), int(m[2])
            if num > MOST_OBJECTS:
                continue
            try:
                _, value = Parser(self.data, m.start(1)).indirect()
            except (PdfError, ValueError, IndexError, RecursionError, OverflowError):
                continue
            for old in [r for r in self.objects if r.num == num] if len(self.objects) < 2000 else [Ref(num, gen)]:
                self.objects.pop(old, None)
            self.objects[Ref(num, gen)] = value
        for t in re.finditer(rb"trailer", self.data):
            try:
                found = Parser(self.data, t.end()).value()
            except (PdfError, ValueError, IndexError, RecursionError):
                continue
            if isinstance(found, dict):
                self.trailer |= found
        if not isinstance(self.objects.get(self.trailer.get("Root")), dict):
            roots = [r for r, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"]
            if roots:
                self.trailer["Root"] = roots[0]
        if not self.objects:
            raise PdfError("Xref", "no objects")

    def _decrypt(self, password: bytes) -> None:
        head = self.resolve(self.trailer["Encrypt"])
        if not isinstance(head, dict):
            raise PdfError("Encryption", "no dictionary")
        ids = self.resolve(self.trailer.get("ID"))
        first = bytes(ids[0]) if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
        self.handler = crypto.Handler({k: self.resolve(v) for k, v in head.items()}, first, password)
        for ref, value in self.objects.items():
            if ref == self.trailer["Encrypt"] or isinstance(value, Stream) and value.dict.get("Type") == "XRef":
                continue
            self.objects[ref] = self.handler.object(value, ref)

    def _unpack(self, containers: set[int]) -> bool:
        """Objects of object streams; none replaces one that stands in the file itself. Whether there are any streams of them."""
        streams = [r for r, v in self.objects.items() if isinstance(v, Stream) and v.dict.get("Type") == "ObjStm"]
        have = {r.num for r in self.objects}
        for ref in streams:
            s = self.objects.pop(ref)
            try:
                data = filters.decode(s)
                n, first = s.dict["N"], s.dict["First"]
                p = Parser(data)
                pairs = [(p.value(), p.value()) for _ in range(n)]
            except (PdfError, KeyError, TypeError):
                continue
            for num, offset in pairs:
                if not isinstance(num, int) or num in have:
                    continue
                try:
                    self.objects[Ref(num, 0)] = Parser(data, first + offset).value()
                    have.add(num)
                except (PdfError, TypeError, RecursionError):
                    continue
        return bool(streams)

    # -- objects

    def resolve(self, value):
        """What a reference points to, one step; other values are themselves."""
        if isinstance(value, Ref):
            return self.objects.get(value, self.objects.get(self.numbers.get(value.num)))
        return value

    def get(self, head, key: str):
        return self.resolve(head.get(key)) if isinstance(head, dict) else None

    @property
    def catalog(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise PdfError("Structure", "no catalogue")
        return root

    @property
    def info(self) -> dict:
        info = self.resolve(self.trailer.get("Info"))
        return info if isinstance(info, dict) else {}

    @property
    def page_count(self) -> int:
        n = self.get(self.get(self.catalog, "Pages"), "Count")
        if not isinstance(n, int) or n < 0:
            raise PdfError("Structure", "no page count")
        return n

    def pages(self) -> list[dict]:
        """The leaves of the page tree in order."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(node, depth: int) -> None:
            if depth > PAGE_DEPTH:
                raise PdfError("Structure", "page tree too deep")
            if not isinstance(node, dict) or id(node) in seen:
                return
            if node.get("Type") == "Pages" or ("Kids" in node and node.get("Type") != "Page"):
                seen.add(id(node))
                for kid in self.get(node, "Kids") or []:
                    walk(self.resolve(kid), depth + 1)
            else:
                out.append(node)

        walk(self.get(self.catalog, "Pages"), 0)
        walk = None  # a function that holds itself would keep the document until cycles are collected
        return out

    def inherited(self, page: dict, key: str):
        for _ in range(PARENTS):
            if key in page:
                return self.resolve(page[key])
            parent = self.get(page, "Parent")
            if not isinstance(parent, dict):
                return None
            page = parent
        return None

    def media_box(self, page: dict) -> list[float]:
        return rect_of(self.inherited(page, "MediaBox")) or [0.0, 0.0, 612.0, 792.0]

    def content(self, page: dict) -> bytes | None:
        """The page's content streams, joined by line feeds; what can't be decoded is taken as it is."""
        c = self.get(page, "Contents")
        if c is None:
            return None
        parts = [self.resolve(x) for x in c] if isinstance(c, list) else [c]
        out = []
        for s in parts:
            if isinstance(s, Stream):
                try:
                    out.append(filters.decode(s))
                except PdfError:
                    out.append(s.data)
        return b"\n".join(out)

    def fonts(self, page: dict) -> dict[str, Font]:
        res = self.inherited(page, "Resources")
        out = {}
        heads = self.get(res, "Font")
        for name, ref in (heads or {}).items() if isinstance(heads, dict) else ():
            key = ref if isinstance(ref, Ref) else id(ref)
            if key not in self._fonts:
                head = self.resolve(ref)
                try:
                    self._fonts[key] = font_of(head, self.resolve, filters.decode)
                except (PdfError, AttributeError, TypeError, ValueError):
                    self._fonts[key] = Font()
            out[name] = self._fonts[key]
        return out

    def page_text(self, page: dict) -> str | None:
        data = self.content(page)
        return None if data is None else content.plain_text(data, self.fonts(page))

    def text(self) -> str:
        """All pages, joined by form feeds; a page that fails is empty."""
        out = []
        for page in self.pages():
            try:
                out.append(self.page_text(page) or "")
            except PdfError:
                out.append("")
        return "\f".join(out)

    def runs(self, page: dict, spec_ctm: bool = False) -> list[dict]:
        data = self.content(page)
        return [] if data is None else content.text_runs(data, self.fonts(page), spec_ctm)

    # -- extractors

    def xmp(self) -> bytes | None:
        s = self.get(self.catalog, "Metadata")
        try:
            return filters.decode(s) if isinstance(s, Stream) else None
        except PdfError:
            return None

    def metadata(self) -> dict[str, str | None]:
        """Eight fields: from XMP if there, else from the information dictionary."""
        out = {k: text_of(self.get(self.info, v)) for k, v in INFO_FIELDS.items()}
        data = self.xmp()
        if data:
            out |= {k: v for k, v in parse_xmp(data).items() if v is not None}
        return out

    def outlines(self) -> list[dict]:
        """Entries in preorder with their path; page only where the target's first element is a number."""
        out: list[dict] = []

        def walk(item, path: tuple, depth: int) -> None:
            seen, k = set(), 0
            while isinstance(item, dict) and id(item) not in seen and k < SIBLINGS and depth <= OUTLINE_DEPTH:
                seen.add(id(item))
                action = self.get(item, "A")
                dest = self.get(item, "Dest") or self.get(action, "D")
                flags = self.get(item, "F")
                color = self.get(item, "C")
                page = dest[0] if isinstance(dest, list) and dest and isinstance(dest[0], int) and not isinstance(dest[0], bool) else None
                kind = self.get(action, "S")
                out.append({"path": [*path, k], "depth": depth, "title": text_of(self.get(item, "Title")) or "", "page": page, "uri": text_of(self.get(action, "URI")), "action_type": str(kind) if isinstance(kind, Name) else None, "color": [number_of(c) or 0.0 for c in color] if isinstance(color, list) else None, "flags": flags if isinstance(flags, int) else 0})
                walk(self.get(item, "First"), (*path, k), depth + 1)
                item, k = self.get(item, "Next"), k + 1

        walk(self.get(self.get(self.catalog, "Outlines"), "First"), (), 1)
        return out

    def annotations(self, page: dict) -> list[dict]:
        out = []
        for ref in self.get(page, "Annots") or []:
            a = self.resolve(ref)
            rect = rect_of(self.get(a, "Rect"))
            subtype = self.get(a, "Subtype")
            if rect is None or not isinstance(subtype, Name):
                continue
            flags, color, quads = self.get(a, "F"), self.get(a, "C"), self.get(a, "QuadPoints")
            action = a.get("A")
            uri = text_of(self.get(action, "URI")) if subtype == "Link" and isinstance(action, dict) else None
            numbers = lambda v: [number_of(x) or 0.0 for x in v] if isinstance(v, list) else None
            out.append({"subtype": str(subtype), "rect": rect, "contents": text_of(self.get(a, "Contents")), "flags": flags if isinstance(flags, int) else 0, "color": numbers(color), "author": text_of(self.get(a, "T")), "modified_date": text_of(self.get(a, "M")), "uri": uri, "quad_points": numbers(quads)})
        return out

    def form_fields(self) -> list[dict]:
        """Terminal fields with names joined by points. The type isn't inherited; of an option's pair the second counts."""
        out: list[dict] = []

        def value_of(v):
            return text_of(v) if isinstance(v, Text) else str(v) if v is not None and not isinstance(v, list | dict | Stream) else None

        def walk(ref, prefix: str, depth: int) -> None:
            head = self.resolve(ref)
            if not isinstance(head, dict) or depth > FIELD_DEPTH:
                return
            own = text_of(self.get(head, "T"))
            name = ".".join(x for x in (prefix, own) if x)
            kids = [k for k in self.get(head, "Kids") or [] if isinstance(self.resolve(k), dict) and "T" in self.resolve(k)]
            if kids:
                for kid in kids:
                    walk(kid, name, depth + 1)
                return
            kind, flags, opt = self.get(head, "FT"), self.get(head, "Ff"), self.get(head, "Opt")
            options = [value_of(self.resolve(o)[-1] if isinstance(self.resolve(o), list) else self.resolve(o)) for o in opt] if isinstance(opt, list) else []
            out.append({"name": name, "field_type": str(kind) if isinstance(kind, Name) else None, "value": value_of(self.get(head, "V")), "default_value": value_of(self.get(head, "DV")), "flags": flags if isinstance(flags, int) else 0, "options": [o for o in options if o is not None], "ref": ref if isinstance(ref, Ref) else None, "head": head})

        for ref in self.get(self.get(self.catalog, "AcroForm"), "Fields") or []:
            walk(ref, "", 0)
        return out

    def signatures(self) -> list[dict]:
        out = []
        for f in self.form_fields():
            v = self.get(f["head"], "V")
            if f["field_type"] != "Sig" or not isinstance(v, dict):
                continue
            sub, rng, data = self.get(v, "SubFilter"), self.get(v, "ByteRange"), self.get(v, "Contents")
            if not (isinstance(rng, list) and len(rng) == 4 and all(isinstance(x, int) for x in rng) and isinstance(data, bytes) and sub in SUB_FILTERS):
                continue
            out.append({"field": f["name"], "sub_filter": str(sub), "byte_range": rng, "contents": bytes(data)} | {k: text_of(self.get(v, p)) for k, p in (("name", "Name"), ("reason", "Reason"), ("location", "Location"), ("date", "M"), ("contact", "ContactInfo"))})
        return out

    def images(self, page: dict) -> list[dict]:
        """Image objects of the page's resources, and inline ones as Inline0, Inline1 ..."""
        out = []
        objects = self.get(self.inherited(page, "Resources"), "XObject")
        for name, ref in sorted(objects.items()) if isinstance(objects, dict) else ():
            s = self.resolve(ref)
            if isinstance(s, Stream) and self.get(s.dict, "Subtype") == "Image":
                image = self._image(name, {k: self.resolve(v) for k, v in s.dict.items()}, s)
                if image:
                    out.append(image)
        data = self.content(page)
        long = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "IM": "ImageMask", "D": "Decode", "DP": "DecodeParms"}
        for k, (head, raw) in enumerate(content.inline_images(data) if data else []):
            head = {long.get(n, n): v for n, v in head.items()}
            image = self._image(f"Inline{k}", head, Stream(head, raw))
            if image:
                out.append(image)
        return out

    def _image(self, name: str, head: dict, s: Stream) -> dict | None:
        w, h = head.get("Width"), head.get("Height")
        if not isinstance(w, int) or not isinstance(h, int):
            return None
        kinds = filters.filter_names(s.dict)
        encoding = {"DCTDecode": "Jpeg", "JPXDecode": "Jpeg2000"}.get(kinds[-1] if kinds else "", "Raw")
        try:
            data = filters.decode(s)
        except PdfError:
            return None
        cs = head.get("ColorSpace")
        cs = self.resolve(cs[0]) if isinstance(cs, list) and cs else cs
        short = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
        bpc = head.get("BitsPerComponent")
        return {"name": name, "width": w, "height": h, "bpc": bpc if isinstance(bpc, int) else 8, "color_space": short.get(str(cs), str(cs)) if isinstance(cs, Name) else None, "encoding": encoding, "is_mask": head.get("ImageMask") is True, "data": data}

    def struct_elements(self) -> tuple[list[dict], str | None] | None:
        """Elements of the structure tree in preorder, and its language; None without a tree. Content identifiers are left out."""
        root = self.get(self.catalog, "StructTreeRoot")
        if not isinstance(root, dict):
            return None
        roles = self.get(root, "RoleMap")
        roles = {k: str(v) for k, v in roles.items() if isinstance(v, Name)} if isinstance(roles, dict) else {}
        out: list[dict] = []
        known: dict[str, tuple[str, int | None]] = {}

        def text(value: dict, key: str) -> str | None:
            return text_of(self.resolve(value[key])) if key in value else None

        def walk(value, parent: int | None, depth: int) -> None:
            value = self.resolve(value)
            if depth > TREE_DEPTH:
                return
            if isinstance(value, list):
                for v in value:
                    walk(v, parent, depth)
            elif isinstance(value, dict) and isinstance(kind := self.resolve(value.get("S")), Name):
                name, own = str(kind), len(out)
                if name not in known:
                    mapped = roles.get(name, name)
                    m = _LEVEL.fullmatch(mapped)
                    known[name] = "H" if m else mapped if mapped in STANDARD_ROLES else "NonStandard", int(m[1] or 0) if m else None
                role, level = known[name]
                out.append({"dfs_ord": own, "parent_ord": parent, "depth": depth, "struct_type": name, "role": role, "level": level, "title": text(value, "T"), "lang": text(value, "Lang"), "alt_text": text(value, "Alt"), "actual_text": text(value, "ActualText")})
                if not isinstance(below := value.get("K"), int):
                    walk(below, own, depth + 1)

        walk(root.get("K"), None, 1)
        walk = None  # as in pages()
        return out, text_of(self.get(root, "Lang"))

    def features(self) -> dict:
        """What the standards' checks need, see operators.standards."""
        cat = self.catalog
        xmp, meta, info = self.xmp(), {}, {k: text_of(self.get(self.info, INFO_FIELDS[k])) for k in ("title", "author")}
        if xmp:
            meta = parse_xmp(xmp)
        fonts, groups, boxes, device = [], [], [], False
        for page in self.pages():
            res = self.inherited(page, "Resources")
            for ref in (self.get(res, "Font") or {}).values():
                head = self.resolve(ref)
                desc = self.get(head, "FontDescriptor")
                fonts.append({"name": str(self.get(head, "BaseFont") or "Unknown"), "embedded": isinstance(desc, dict) and any(k in desc for k in ("FontFile", "FontFile2", "FontFile3"))})
            spaces = self.get(res, "ColorSpace")
            device |= isinstance(spaces, dict) and any(k.startswith("Device") for k in spaces)
            g = self.get(self.get(page, "Group"), "S")
            if isinstance(g, Name):
                groups.append(str(g))
            boxes.append("TrimBox" in page or "ArtBox" in page)
        intents = [str(self.get(self.resolve(i), "S") or "") for i in self.get(cat, "OutputIntents") or []]
        js = self.get(self.get(cat, "OpenAction"), "S") == "JavaScript" if isinstance(self.get(cat, "OpenAction"), dict) else False
        return {
            "encrypted": "Encrypt" in self.trailer, "xmp": xmp.decode("utf-8", "replace") if xmp else None, "lzw": any(isinstance(v, Stream) and "LZWDecode" in filters.filter_names(v.dict) for v in self.objects.values()),
            "open_action_js": js, "names_js": self.get(self.get(cat, "Names"), "JavaScript") is not None, "aa": "AA" in cat, "fonts": fonts, "output_intents": intents, "device_spaces": device,
            "info_title": info["title"], "xmp_title": meta.get("title"), "info_author": info["author"], "xmp_author": meta.get("author"), "page_groups": groups, "print_boxes": boxes,
        }


def parse_xmp(data: bytes) -> dict[str, str | None]:
    """The eight metadata fields of an XMP packet: elements or attributes of rdf:Description; of alternatives x-default, else the first."""
    try:
        root = ET.fromstring(data.decode("utf-8", "replace").strip().strip("\0"))
    except ET.ParseError:
        return {}
    rdf = "{" + NAMESPACES["rdf"] + "}"
    out: dict[str, str | None] = {}
    for name, qualified in XMP_FIELDS.items():
        prefix, local = qualified.split(":")
        tag = "{" + NAMESPACES[prefix] + "}" + local
        for d in root.iter(rdf + "Description"):
            value = d.get(tag)
            e = d.find(tag)
            if value is None and e is not None:
                items = list(e.iter(rdf + "li"))
                best = next((i for i in items if i.get("{http://www.w3.org/XML/1998/namespace}lang") == "x-default"), items[0] if items else e)
                value = (best.text or "").strip() or None
            if value is not None:
                out.setdefault(name, value)
    return out
