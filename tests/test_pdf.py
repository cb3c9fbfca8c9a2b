"""The byte layer: objects, filters, encryption, text, extractors, edits, and files that are broken."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.pdf import content, crypto, filters, fonts, writer
from folioflow.pdf.document import Document, parse_xmp
from folioflow.pdf.syntax import HexText, Name, Parser, PdfError, Ref, Stream, Text, write

scalars = st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=12).map(Name), st.binary(max_size=20).map(Text), st.binary(max_size=20).map(HexText), st.builds(Ref, st.integers(0, 9999), st.integers(0, 65535)), st.integers(-10**6, 10**6).map(lambda n: n / 8))
objects = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(st.characters(codec="ascii", exclude_characters="\0"), min_size=1, max_size=6), x, max_size=4)), max_leaves=12)


@given(objects)
@settings(max_examples=200, deadline=None)
def test_what_is_written_parses_back(value):
    got = Parser(write(value)).value()
    assert got == value or (isinstance(value, float) and got == pytest.approx(value))


@given(st.binary(max_size=400))
@settings(max_examples=100, deadline=None)
def test_any_bytes_parse_or_fail_in_order(data):
    try:
        Document(b"%PDF-1.4\n" + data)
    except PdfError:
        pass
    list(content.tokens(data))


def test_syntax_details():
    v = lambda b: Parser(b).value()
    assert v(b"(a(b)c\\)\\n\\101\\q\\\n)") == b"a(b)c)\nAq" and v(b"<A>") == b"\xa0" and v(b"/A#20B") == "A B"
    assert v(b"[1 0 R 2 3]") == [Ref(1, 0), 2, 3] and v(b"<< /A 1 /A 2 >>") == {"A": 2} and v(b"-.5") == -0.5
    with pytest.raises(PdfError):
        v(b"[" * 500)


def test_filters():
    s = lambda name, data, **parms: filters.decode(Stream({"Filter": Name(name)} | ({"DecodeParms": parms} if parms else {}), data))
    assert s("AHx", b"48656C6C6F>") == b"Hello" and s("AHx", b"A>") == b"\xa0" and s("A85", b"9jqo^~>") == b"Man " and s("A85", b"z~>") == bytes(4)
    assert s("RL", b"\x04Hello\xfdA\x80") == b"HelloAAAA" and s("Fl", zlib.compress(b"x")) == b"x" and s("LZW", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert s("Fl", zlib.compress(b"\1\1\1\1\2\1\1\1"), Predictor=15, Columns=3) == b"\1\2\3\2\3\4" and s("Fl", zlib.compress(b"\1\1\1"), Predictor=2, Columns=3) == b"\1\2\3"
    for bad in ((b"\x05ab", "RL"), (b"GG>", "AHx"), (b"", "Nope")):
        with pytest.raises(PdfError):
            s(bad[1], bad[0])
    assert filters.encode_flate(b"ab").dict == {}


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_encoders_round_trip(data):
    assert filters.run_length(filters.encode_run_length(data)) == data and filters.ascii_85(filters.encode_ascii_85(data)) == data and filters.ascii_hex(filters.encode_ascii_hex(data)) == data


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3" and crypto.rc4(b"", b"x") == b"x"
    block, key = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(range(16))
    assert crypto.Aes(key).encrypt_block(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" and crypto.Aes(key).decrypt_block(crypto.Aes(key).encrypt_block(block)) == block
    assert crypto.Aes(bytes(range(32))).encrypt_block(block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.aes_open(key, crypto.aes_seal(key, block, b"hello")) == b"hello" and crypto.aes_open(key, b"short") == b"short"


@pytest.mark.parametrize("aes", [True, False])
def test_encrypted_documents(aes):
    b = writer.Builder(Document(writer.text_document("secret text", Title="T")))
    data = b.to_encrypted("user", "owner", aes=aes)
    assert b"secret" not in data and Document(data, "user").text() == "secret text"
    with pytest.raises(PdfError, match="password"):
        Document(data, "wrong")


@pytest.mark.parametrize("revision", [5, 6])
def test_revisions_5_and_6(revision):
    h, key = (crypto.hash_r6 if revision == 6 else crypto.hash_r5), hashlib.sha256(b"k").digest()
    us, uk, os_, ok = b"abcdefgh", b"ijklmnop", b"qrstuvwx", b"yz012345"
    u = h(b"user", us) + us + uk
    o = h(b"owner", os_, u) + os_ + ok
    perms = crypto.Aes(key).encrypt_block((-4 & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb1234")
    head = {"V": 5, "R": revision, "P": -4, "U": u, "O": o, "UE": crypto.cbc_encrypt(h(b"user", uk), bytes(16), key), "OE": crypto.cbc_encrypt(h(b"owner", ok, u), bytes(16), key), "Perms": perms}
    assert all(crypto.Handler(head, b"", p).key == key for p in (b"user", b"owner"))
    with pytest.raises(PdfError):
        crypto.Handler(head, b"", b"no")


def runs(stream, **kw):
    return content.text_runs(stream, {"F1": fonts.Font("Helvetica")}, **kw)


def test_text_runs():
    r = runs(b"BT /F1 12 Tf 100 700 Td (Hello) Tj ( World) Tj ET")
    assert [(x["text"], x["x"], x["y"], x["width"]) for x in r] == [("Hello", 100, 700, 30), (" World", 130, 700, 36)]
    r = runs(b"1 0 0 1 50 100 cm BT /F1 12 Tf 100 700 Td (A) Tj ET")[0]
    assert (r["x"], r["y"]) == (150, 800)
    assert runs(b"2 0 0 2 0 0 cm BT /F1 12 Tf (A) Tj ET")[0]["font_size"] == 24
    assert runs(b"1 0 0 rg BT /F1 12 Tf (A) Tj ET")[0]["color"] == [1, 0, 0, 1] and runs(b"0.5 g BT (A) Tj ET")[0]["color"][:3] == [0.5] * 3
    assert runs(b"BT 3 Tr /F1 12 Tf (A) Tj ET")[0]["rendering_mode"] == 3
    assert runs(b"q 1 0 0 1 9 9 cm Q BT /F1 1 Tf 100 0 Td (A) Tj ET")[0]["x"] == 100 and runs(b"") == []


def test_plain_text():
    assert content.plain_text(b"BT (a) Tj 0 -14 Td (b) Tj T* (c) ' [(d) -200 (e) -50 (f)] TJ ET (no) Tj") == "a\nb\nc\nd ef"
    assert content.plain_text(b"BI /W 1 /H 1 ID \x01\x02 EI BT (x) Tj ET") == "x"


def test_fonts():
    cmap = b"2 beginbfchar <01> <0041> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <20> <21> [<0058> <0059>] endbfrange"
    t = fonts.ToUnicode(cmap)
    assert [t.map(b"\1"), t.map(b"\0\2"), t.map(b"\0\x11"), t.map(b"\x21"), t.map(b"\x11")] == ["A", "é", "b", "Y", None]
    assert fonts.Font("X", "Type0", to_unicode=t).text(b"\0\x10\0\x12") == "ac"
    f = fonts.font_of({"Encoding": {"Differences": [65, Name("eacute"), Name("uni0416")]}}, lambda v: v, None)
    assert f.text(b"ABC") == "éЖC" and fonts.glyph_text("u1F600") == "😀" and fonts.glyph_text("nope") is None


def test_info_and_structure():
    b = writer.Builder()
    f = b.font()
    b.page(writer.Content().text("F1", 12, 72, 700, b"One").bytes(), {"F1": f})
    b.metadata(Title="Ünï", Author="A")
    b.outline([("Top", 0, [("Sub", 0, [])])])
    b.fields([("form", None, [("name", "v", [])])])
    assert b.structure([("H1", "One"), ("P", "x")]) == 2
    d = Document(b.to_bytes())
    assert d.metadata()["title"] == "Ünï" and [o["path"] for o in d.outlines()] == [[0], [0, 0]] and d.form_fields()[0]["name"] == "form.name"
    elems, lang = d.struct_elements()
    assert [(e["role"], e["level"]) for e in elems] == [("Document", None), ("H", 1), ("P", None)] and lang == "en-US"
    assert d.text() == "One" and d.features()["fonts"] == [{"name": "Helvetica", "embedded": False}]


def test_xmp():
    x = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" pdf:Producer="P"><dc:title><rdf:Alt><rdf:li xml:lang="fr">F</rdf:li><rdf:li xml:lang="x-default">D</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>'
    assert parse_xmp(x)["title"] == "D" and parse_xmp(x)["producer"] == "P" and parse_xmp(b"<broken") == {}


def test_object_streams_and_rebuilding():
    body = b"4 0 5 9 " + b"<</A 1>> (five)"
    s = Stream({"Type": Name("ObjStm"), "N": 2, "First": 8}, body)
    b = writer.Builder()
    b.page()
    b.objects[Ref(9, 0)] = s
    d = Document(b.to_bytes())
    assert d.objects[Ref(5, 0)] == b"five"
    broken = b.to_bytes().replace(b"startxref", b"startxxxx")
    assert len(Document(broken).pages()) == 1


def test_cut_files_fail_in_order():
    data = writer.text_document("a\nb", Title="T")
    for k in range(len(data)):
        try:
            Document(data[:k]).text()
        except PdfError:
            pass
    with pytest.raises(PdfError):
        Document(b"no pdf")


def test_edits():
    a, c = writer.text_document("one"), writer.text_document("two")
    b = writer.Builder(Document(a))
    b.merge(Document(c))
    b.reorder_pages([1, 0])
    b.append_content(0, writer.Content().text("F1", 9, 1, 1, b"more").bytes())
    assert Document(b.to_bytes()).text() == "two\nmore\fone"
    b.remove_page(0)
    b.rotate_page(0, 450)
    d = Document(b.to_bytes())
    assert d.page_count == 1 and d.pages()[0]["Rotate"] == 90
    with pytest.raises(PdfError):
        b.rotate_page(0, 45)
    assert Document(b.to_linearized()).text() == "one"
    big = writer.Builder()
    for _ in range(1000):
        big.page()
    assert Document(big.to_bytes()).page_count == 1000
