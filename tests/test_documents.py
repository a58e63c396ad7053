"""DOCX and PDF bytes, and the whole way through."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom import schema as S
from textloom.operators import diff
from textloom.plans import pipeline
from textloom.sources import datasource, docx, pdf, pdf_crypt, pdf_filters

p = lambda *runs: "<w:p>" + "".join(f"<w:r>{f'<w:rPr><w:{f}/></w:rPr>' if f else ''}<w:t xml:space=\"preserve\">{t}</w:t></w:r>" for t, f in runs) + "</w:p>"
HEADER = f'<?xml version="1.0"?><w:hdr xmlns:w="{docx.W}">{p(("Header text", None))}</w:hdr>'
REL = '<Relationship Id="rId9" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/header" Target="header1.xml"/>'
SECT = '<w:sectPr><w:headerReference w:type="default" r:id="rId9"/></w:sectPr>'
BOX = "<w:p><w:r><w:pict><v:shape><v:textbox><w:txbxContent>{}</w:txbxContent></v:textbox></v:shape></w:pict></w:r></w:p>"


def rows(data):
    return {r["container_id"]: r["visible_text"] for r in docx.read_paragraphs(data)}


def simple():
    return docx.make_package(p(("Hello", "b"), (" world", None)) + p(("Second paragraph", None)) + SECT, {"word/header1.xml": HEADER, "media/x.bin": "as it was"}, REL)


def edit(cid, text, a=None, b=None, id=None):
    return {"seq": 0, "container_id": cid, "id": id, "text": text, "start_offset": a, "end_offset": b}


def test_stories_in_order():
    table = f"<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>{p(('A', None))}</w:tc><w:tc>{p(('B', None))}</w:tc></w:tr></w:tbl>"
    sdt = f"<w:sdt><w:sdtContent>{p(('In control', None))}</w:sdtContent></w:sdt>"
    data = docx.make_package(p(("Before", None)) + sdt + table + BOX.format(p(("Boxed", None))) + BOX.format("<w:p/>") + SECT, {"word/header1.xml": HEADER}, REL)
    got = rows(data)
    assert list(got) == ["body:p:0", "body:p:1", "body:p:2", "body:p:3", "table:0:r:0:c:0:p:0", "table:0:r:0:c:2:p:0", "header:0:p:0", "txbx:0:p:0"]
    assert got["body:p:2"] == "" and got["txbx:0:p:0"] == "Boxed" and got["header:0:p:0"] == "Header text"


def test_inline_pieces():
    link = "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink>"
    body = f"<w:p><w:pPr><w:jc w:val=\"center\"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>A</w:t><w:tab/><w:t>B</w:t></w:r>{link}<w:r><w:br/></w:r></w:p>"
    r = docx.read_paragraphs(docx.make_package(body))[0]
    assert [(x["kind"], x["text"]) for x in r["inline"]] == [("text", "A"), ("opaque", "\t"), ("text", "B"), ("opaque", "link"), ("opaque", "\n")]
    assert r["visible_text"] == "A\tBlink\n" and "w:b" in r["inline"][0]["rpr"]


def test_edits_keep_the_rest():
    data = simple()
    out = docx.write_edits(data, [edit("body:p:0", "Universe", 6, 11), edit(None, "Changed", id="s1"), edit("header:0:p:0", "H")])
    assert list(rows(out).values()) == ["Hello Universe", "Changed", "H"]
    a, b = zipfile.ZipFile(io.BytesIO(data)), zipfile.ZipFile(io.BytesIO(out))
    assert a.namelist() == b.namelist() and b.read("media/x.bin") == b"as it was"
    xml = b.read("word/document.xml").decode()
    assert 'mc:Ignorable="w14"' in xml and "xmlns:w14" in xml and "<w:b/>" in xml and "world" not in xml
    assert docx.write_edits(data, []) == data


@pytest.mark.parametrize(("a", "b"), [(-1, 1), (0, 100), (5, 5), (6, 5)])
def test_bad_offsets_fail(a, b):
    with pytest.raises(ValueError, match="invalid offsets"):
        docx.write_edits(simple(), [edit("body:p:0", "X", a, b)])


def test_opaque_text_fails_closed():
    link = docx.make_package("<w:p><w:r><w:t>see </w:t></w:r><w:hyperlink><w:r><w:t>Jan Kowalski</w:t></w:r></w:hyperlink></w:p>")
    for e in (edit("body:p:0", "X"), edit("body:p:0", "X", 2, 8)):
        with pytest.raises(ValueError, match="opaque"):
            docx.write_edits(link, [e])
    assert rows(docx.write_edits(link, [edit("body:p:0", "go to", 0, 3)]))["body:p:0"] == "go to Jan Kowalski"
    with pytest.raises(ValueError, match="unknown"):
        docx.write_edits(link, [edit("nowhere", "X")], strict=True)


def test_hostile_and_broken_packages(spark):
    evil = docx.make_package("<w:p/>", {"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>"})
    df = spark.createDataFrame([("evil", bytearray(evil)), ("junk", bytearray(b"PKjunk")), ("none", None), ("ok", bytearray(simple()))], "doc_id string, content binary")
    got = docx.paragraphs(df).collect()
    assert {r.doc_id: r.error for r in got} == {"evil": S.ERROR_DOCX, "junk": S.ERROR_DOCX, "none": S.ERROR_DOCX, "ok": None}
    segs = docx.segments(docx.paragraphs(df)).orderBy("paragraph_index").collect()
    assert [(s.id, s.container_id, s.run_indices) for s in segs] == [("s0", "body:p:0", [0, 1]), ("s1", "body:p:1", [0]), ("s2", "header:0:p:0", [0])]


def labelled(a, b):
    """Differences with the labels that the writer draws."""
    return [o | {"label": "" if not (t := " ".join(o["replacement_text"].split())) else t if t.isascii() else "****"} for o in diff.opcodes(a, b)]


def texts_of(data):
    return [t for t, _, _ in pdf.read_pages(data)]


def holds(data, *words):
    """Which words any stream, string or name of a file still holds, in any of the ways that text is stored."""
    got = pdf.Pdf(data)
    raw = b"".join(got.stream(v) if isinstance(v := got.get(pdf.Ref(n)), tuple) else pdf.dump(v) for n in [*got.where, *got.packed])
    return [w for w in words if w.encode("cp1252", "replace") in raw or w.encode("utf-16-be") in raw]


def test_pdf_round_trip():
    texts = [["Jan Kowalski (x) \\ y", "Zażółć gęślą 漢字 😀"], ["two"], []]
    assert texts_of(pdf.build(texts)) == ["Jan Kowalski (x) \\ y\nZażółć gęślą 漢字 😀\n", "two\n", ""]
    assert texts_of(pdf.build(texts, paths=())) == texts_of(pdf.build(texts))


FILTERS = [(), ("FlateDecode",), ("ASCII85Decode", "FlateDecode"), ("ASCIIHexDecode",), ("LZWDecode",), ("RunLengthDecode",), ("ASCIIHexDecode", "LZWDecode")]


@pytest.mark.parametrize("filters", FILTERS)
@pytest.mark.parametrize(("two", "form"), [(False, False), (True, False), (False, True), (True, True)])
def test_pdf_redaction_in_place_takes_the_text_out(filters, two, form):
    data = pdf.build([["Jan Kowalski oraz Jan Kowalski", "PESEL 90010112345"], ["other page"]], filters=filters, two=two, form=form)
    a, b = texts_of(data)
    target = a.replace("Jan Kowalski", "[OSOBA_1]", 1).replace("90010112345", "[PESEL_1]")
    out = pdf.rewrite(data, [(a, target, "redact", labelled(a, target)), (b, b, "unchanged", [])])
    got = texts_of(out)
    assert got[0].count("Kowalski") == 1 and got[0].count("oraz Jan Kowalski") == 1 and "[OSOBA_1]" in got[0] and "90010112345" not in got[0] and got[1] == b
    assert not holds(out, "90010112345")
    kept = [g for g in pdf.glyphs(pdf.Pdf(out), pdf.Pdf(out).pages[0])][1:5]
    was = [g for g in pdf.glyphs(pdf.Pdf(data), pdf.Pdf(data).pages[0])][13:17]
    assert [g.c for g in kept] == [g.c for g in was] and all(abs(x.rect[0] - y.rect[0]) < 0.05 for x, y in zip(kept, was))  # the rest stays where it was
    again = pdf.rewrite(out, [(got[0], "gone", "rebuild", []), (b, b, "unchanged", [])])
    assert texts_of(again) == ["gone\n", b] and not holds(again, "Kowalski", "OSOBA_1")


def made(content, fonts=b"/F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", page=b"", more=b""):
    """A file of one page, as another writer may make it: no filters, direct objects, old line ends."""
    return b"%%PDF-1.4\r1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\r2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\r3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]%s/Resources<</Font<<%s>>>>/Contents[4 0 R]>>endobj\r4 0 obj<</Length %d>>stream\r\n%s\rendstream endobj\r%strailer<</Root 1 0 R>>" % (page, fonts, len(content), content, more)


def test_pdf_show_operators_of_other_writers():
    data = made(b"BT /F1 12 Tf 14 TL 72 700 Td [(Anna)-250( No)20(wak)]TJ T* (second) Tj (third) ' 1 0 (fourth secret) \" ET")
    assert texts_of(data) == ["Anna Nowak\nsecond\nthird\nfourth secret\n"]
    a, = texts_of(data)
    target = a.replace("Nowak", "[1]").replace("third", "[2]").replace("secret", "[3]")
    out = pdf.rewrite(data, [(a, target, "redact", labelled(a, target))])
    got, = texts_of(out)
    assert all(x in got for x in ("Anna", "second", "fourth", "[1]", "[2]", "[3]")) and not holds(out, "No", "wak", "third", "secret")


def test_pdf_pages_seen_turned_and_cropped():
    for turn in (b"/Rotate 90", b"/Rotate 180", b"/Rotate 270", b"/CropBox[50 50 500 800]", b"/Rotate 90/CropBox[50 50 500 800]"):
        data = made(b"BT /F1 12 Tf 100 700 Td (Jan Nowak lives here) Tj ET", page=turn)
        a, = texts_of(data)
        assert a == "Jan Nowak lives here\n"
        target = a.replace("Nowak", "[X]")
        out = pdf.rewrite(data, [(a, target, "redact", labelled(a, target))])
        before = {g.c: g for g in pdf.glyphs(pdf.Pdf(data), pdf.Pdf(data).pages[0])}
        label = [g for g in pdf.glyphs(pdf.Pdf(out), pdf.Pdf(out).pages[0]) if g.c == "["][0]
        assert "[X]" in texts_of(out)[0] and abs((label.rect[1] + label.rect[3]) / 2 - (before["N"].rect[1] + before["N"].rect[3]) / 2) < 90
        assert texts_of(pdf.rewrite(data, [(a, "new text", "rebuild", [])])) == ["new text\n"]


def test_pdf_text_that_marked_content_repeats_goes_too():
    data = made(b"/Span <</ActualText (Jan Nowak) /Lang (pl)>> BDC BT /F1 12 Tf 72 700 Td (Jan Nowak tu) Tj ET EMC")
    a, = texts_of(data)
    out = pdf.rewrite(data, [(a, "[X] tu\n", "redact", labelled(a, "[X] tu\n"))])
    assert not holds(out, "Nowak") and "Lang" in pdf.Pdf(out).content(pdf.Pdf(out).pages[0]).decode("latin-1")


def test_a_form_that_another_page_draws_too_is_copied():
    form = b"5 0 obj<</Type/XObject/Subtype/Form/BBox[0 0 9 9]/Resources<</Font<</F1<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>>>>>/Length 46>>stream\nBT /F1 12 Tf 72 700 Td (Shared secret) Tj ET  \nendstream endobj\n"
    page = b"%d 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</XObject<</X 5 0 R>>>>/Contents 4 0 R>>endobj\n"
    data = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R 6 0 R]/Count 2>>endobj\n" + page % 3 + page % 6 + b"4 0 obj<</Length 5>>stream\n/X Do\nendstream endobj\n" + form + b"trailer<</Root 1 0 R>>"
    a, b = texts_of(data)
    assert a == b == "Shared secret\n"
    target = "Shared [X]\n"
    out = pdf.rewrite(data, [(a, target, "redact", labelled(a, target)), (b, b, "unchanged", [])])
    assert [''.join(t.split()) for t in texts_of(out)] == ['Shared[X]', 'Sharedsecret']
    both = pdf.rewrite(data, [(a, target, "redact", labelled(a, target))] * 2)
    assert not holds(both, "secret") and [''.join(t.split()) for t in texts_of(both)] == ['Shared[X]'] * 2


@pytest.mark.parametrize(
    "bad",
    [
        made(b"BT /F1 12 Tf 72 700 Td /Name Tj ET"),
        made(b"BT /F1 12 Tf (x) 72 Td (text) Tj ET"),
        made(b"").replace(b"/Kids[3 0 R]", b"/Kids[3 0 R 2 0 R]"),
        made(b"").replace(b"/Kids[3 0 R]", b"/Kids[3 0 R 9 0 R]"),
        made(b"/X Do").replace(b"/Resources<<", b"/Resources<</XObject<</X 5 0 R>>") + b"\n5 0 obj<</Subtype/Form/Length 5>>stream\n/X Do\nendstream endobj",
        made(b"x").replace(b"<</Length 1>>", b"<</Length 1/Filter/DCTDecode>>"),
        made(b"x").replace(b"<</Length 1>>", b"<</Length 1/Filter/FlateDecode>>"),
    ],
)
def test_text_that_cannot_be_read_fails_its_document(bad):
    with pytest.raises(Exception):
        pdf.read_pages(bad)


def test_pdf_fonts_by_names_and_maps():
    names = made(b"BT /F1 12 Tf 72 700 Td (\001\002\003\004) Tj ET", b"/F1<</Type/Font/Subtype/Type1/BaseFont/X/FontDescriptor<<>>/Encoding<</Differences[1/aogonek/uni0142/afii10065/Euro]>>>>")
    assert texts_of(names) == ["ąłа€\n"]
    broken = made(b"BT /F1 12 Tf 72 700 Td (abc) Tj ET", b"/F1<</Type/Font/Subtype/TrueType/BaseFont/X/ToUnicode 5 0 R/Encoding/WinAnsiEncoding>>", more=b"5 0 obj<</Length 3/Filter/FlateDecode>>stream\nxxx\nendstream endobj\r")
    assert texts_of(broken) == ["abc\n"]
    unmapped = made(b"BT /F1 12 Tf 72 700 Td <00410042> Tj ET", b"/F1<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/Identity-H/DescendantFonts[<</DW 500>>]>>")
    assert texts_of(unmapped) == ["\ufffd\ufffd\n"]
    assert texts_of(unmapped.replace(b"Identity-H", b"UniGB-UCS2-H")) == ["AB\n"]


def test_filters():
    sample = bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf_filters.lzw(bytes.fromhex("800B6050220C0C8501")) == sample
    for data in (b"", sample, bytes(range(256)) * 40, b"ab" * 5000):
        for name, encode in pdf_filters.ENCODE.items():
            assert pdf_filters.decode(encode(data), [name], [{}]) == data
    png = b"".join(bytes([k]) + row for k, row in zip((0, 1, 2, 3, 4), (b"\x01\x02\x03", b"\x01\x01\x01", b"\x01\x01\x01", b"\x01\x01\x01", b"\x01\x01\x01")))
    assert pdf_filters.unpredict(png, {"Predictor": 15, "Columns": 3})[:9] == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4])
    assert pdf_filters.unpredict(b"\x01\x01\x01\x05\x01\x01", {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])
    broken = pdf_filters.ENCODE["FlateDecode"](b"some text " * 100)
    assert b"some text some text".startswith(pdf_filters.flate(broken[:-6])[:19]) and pdf_filters.flate(broken[:-6])


def test_encrypted_for_an_empty_password():
    file_id, owner, rights = b"0123456789abcdef", bytes(range(32)), -44
    for v, r, n in ((1, 2, 5), (2, 3, 16)):
        key = hashlib.md5(pdf_crypt._PAD + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
        for _ in range(50 if r == 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        if r == 2:
            user = pdf_crypt.rc4(key, pdf_crypt._PAD)
        else:
            user = hashlib.md5(pdf_crypt._PAD + file_id).digest()
            for k in range(20):
                user = pdf_crypt.rc4(bytes(x ^ k for x in key), user)
            user += bytes(16)
        plain = b"BT /F1 12 Tf 72 700 Td (Jan Nowak) Tj ET"
        own = hashlib.md5(key + (4).to_bytes(3, "little") + bytes(2)).digest()[: min(16, n + 5)]
        lock = b"/ID[<%s><00>]/Encrypt<</Filter/Standard/V %d/R %d/Length %d/P %d/O<%s>/U<%s>>>" % (file_id.hex().encode(), v, r, 8 * n, rights, owner.hex().encode(), user.hex().encode())
        data = made(pdf_crypt.rc4(own, plain)).replace(b"trailer<<", b"trailer<<" + lock)
        assert texts_of(data) == ["Jan Nowak\n"]
        out = pdf.rewrite(data, [("Jan Nowak\n", "[X]\n", "redact", labelled("Jan Nowak\n", "[X]\n"))])
        assert texts_of(out) == ["[X]\n"] and b"Encrypt" not in out
        with pytest.raises(ValueError):
            pdf.Pdf(data.replace(owner.hex().encode(), bytes(32).hex().encode()))
    aes = pdf_crypt.Aes(bytes(range(16)))
    assert aes.encrypt(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert aes.unchain(aes.chain(b"sixteen bytes...and more of them", bytes(16)), bytes(16)) == b"sixteen bytes...and more of them"


def test_pdf_redaction_by_alignment_and_by_search():
    data = pdf.build([["Jan Kowalski lives here", "and so does Jan Kowalski"]])
    a, = texts_of(data)
    near = a.replace("lives", "liVes")  # the caller's text differs a little from the page's
    target = near.replace("Jan Kowalski", "****", 1)
    got = texts_of(pdf.rewrite(data, [(near, target, "redact", labelled(near, target))]))[0]
    assert got.count("Kowalski") == 1
    far = "Jan  Kowalski QQQQ ZZZZ 0123456789 0123456789\n"  # no alignment: looked for, every place goes
    change = [{"tag": "replace", "source_start": 0, "source_end": 13, "source_text": "Jan  Kowalski", "replacement_text": "[X]", "label": "[X]"}]
    got = texts_of(pdf.rewrite(data, [(far, "[X]", "redact", change)]))[0]
    assert "Kowalski" not in got and got.count("[X]") == 2
    assert pdf.occurrences("one two\nthree", "one  two three") and not pdf.occurrences("abc", "x\ny")


def test_pdf_text_that_does_not_fit_flows(spark):
    data = pdf.build([["short"]])
    a, = texts_of(data)
    out = pdf.rewrite(data, [(a, "word " * 1500, "rebuild", [])])
    assert sum(t.count("word") for t in texts_of(out)) == 1500 and len(texts_of(out)) > 1
    with pytest.raises(ValueError):
        pdf.rewrite(data, [])
    page = "struct<page:int,source_text:string,text:string,strategy:string,ops:array<string>>"
    df = spark.createDataFrame([("new", None, [(0, "", "line\n" * 200, "rebuild", [])]), ("none", None, None)], f"doc_id string, content binary, edited array<{page}>")
    got = {r.doc_id: r.data for r in pdf.write(df).collect()}
    assert sum(t.count("line") for t in texts_of(bytes(got["new"]))) == 200 and got["none"] is None


def test_whole_way(spark, tmp_path):
    blobs = [
        ("t", "notatka.txt", None, "Zażółć".encode("cp1250")),
        ("m", None, "", "# Title".encode()),
        ("w", "umowa.docx", None, simple()),
        ("p", "plik.pdf", None, pdf.build([["Jan Kowalski"], ["next"]])),
        ("b", "x.bin", None, b"\x00\x01"),
        ("e", "x.pdf", None, b"%PDF-1.4 broken"),
        ("o", "scan.pdf", None, pdf.build([[]])),
    ]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in blobs], S.BLOB)
    loaded = pipeline.load(df)
    assert {(r.doc_id, r.id): r.text for r in loaded.segments.collect()} == {("t", "s0"): "Zażółć", ("m", "s0"): "# Title", ("w", "s0"): "Hello world", ("w", "s1"): "Second paragraph", ("w", "s2"): "Header text", ("p", "p0"): "Jan Kowalski\n", ("p", "p1"): "next\n"}
    assert {(r.doc_id, r.error) for r in loaded.errors.collect()} == {("b", S.ERROR_TYPE), ("e", S.ERROR_PDF), ("o", S.ERROR_PDF_OCR)}
    edits = spark.createDataFrame([("t", 0, None, "s0", "Nowy", None, None), ("w", 0, "body:p:0", None, "X", 0, 5), ("p", 0, None, "p0", "[OSOBA]", 0, 12), ("m", 0, None, "s0", "x", 5, 99)], S.EDIT)
    out = {r.doc_id: r for r in pipeline.render(loaded, edits).collect()}
    assert bytes(out["t"].data) == b"Nowy" and out["t"].filename == "notatka.anonimizowany.txt"
    assert rows(bytes(out["w"].data))["body:p:0"] == "X world" and out["w"].content_type == S.DOCX_MIME
    assert "[OSOBA]" in pdf.read_pages(bytes(out["p"].data))[0][0] and "Kowalski" not in pdf.read_pages(bytes(out["p"].data))[0][0]
    assert out["m"].data is None and out["m"].error == "invalid offsets"
    assert out["e"].error == S.ERROR_PDF and out["o"].error == S.ERROR_PDF_OCR and out["o"].data is None
    saved = pipeline.export_files(pipeline.render(loaded, edits), str(tmp_path / "out")).collect()
    assert {s.doc_id for s in saved} == {"t", "w", "p"} and all(open(s.path, "rb").read() for s in saved)
    pipeline.save_files(pipeline.render(loaded, edits), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    strict = {r.doc_id: r.error for r in pipeline.render(loaded, edits.withColumn("id", F.lit("s99")).withColumn("container_id", F.lit(None).cast("string")), strict=True).collect()}
    assert strict["t"] == strict["w"] == strict["p"] == "unknown edit target"


def test_texts_by_position_of_every_kind(spark):
    blobs = [("t", "a.txt", None, b"one"), ("w", "b.docx", None, simple()), ("p", "c.pdf", None, pdf.build([["Jan"], [], ["Ewa"]])), ("x", "d.txt", None, b"kept")]
    loaded = pipeline.load(spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in blobs], S.BLOB))
    texts = [("t", 0, "T"), *(("w", k, f"W{k}") for k in range(3)), ("p", 0, "P0"), ("p", 1, "P1"), ("p", 2, "one too many")]
    edits, wrong = pipeline.edits_by_position(loaded, spark.createDataFrame(texts, "doc_id string, pos int, new_text string"))
    out = {r.doc_id: r for r in pipeline.render(loaded, edits, failures=wrong).collect()}
    assert bytes(out["t"].data) == b"T" and bytes(out["x"].data) == b"kept" and list(rows(bytes(out["w"].data)).values()) == ["W0", "W1", "W2"]
    assert out["p"].error == "expected 2 text segments, got 3" and out["p"].data is None


def test_data_source_and_stream(spark, tmp_path):
    from textloom.streaming import ingest

    files = tmp_path / "in"
    files.mkdir()
    (files / "a.txt").write_bytes("Żółw".encode())
    (files / "b.docx").write_bytes(simple())
    datasource.register(spark)
    got = spark.read.format("document_segments").load(str(files)).collect()
    assert sorted(r.text for r in got) == ["Header text", "Hello world", "Second paragraph", "Żółw"]
    assert {r.doc_id.rsplit("/", 1)[-1] for r in pipeline.read_files(spark, str(files)).collect()} == {"a.txt", "b.docx"}
    ingest.segments_to(spark, str(files), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    (files / "c.txt").write_bytes(b"later")
    ingest.segments_to(spark, str(files), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
