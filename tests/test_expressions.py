"""Names, bytes, labels and inline algebra against plain Python."""

import os.path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom import schema as S
from textloom.functions import inline as I
from textloom.functions import text as T
from textloom.functions.ordering import number_rows
from textloom.operators import detect as D
from textloom.operators import layout as L


def values(spark, rows, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_suffix_and_output_names(spark):
    names = [("Umowa nr 1.DOCX",), ("a.tar.gz",), (".txt",), ("a.",), ("",), (None,), ("dir.x/file",), ("żółć.md",), ("..",)]
    got = values(spark, names, "n string", T.suffix("n"), T.output_filename("n", ".docx"))
    want = [".docx", ".gz", "", "", "", "", "", ".md", ""]
    assert [g[0] for g in got] == want
    assert got[0][1] == "Umowa_nr_1.anonimizowany.docx"
    assert got[4][1] == got[5][1] == "document.anonimizowany.docx"


def test_decode_ladder(spark):
    text = "Zażółć gęślą jaźń – “x” 😀"
    cases = [text.encode(), b"\xef\xbb\xbf" + text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be"), "Zażółć".encode("cp1250"), b"\x81abc\xe9", b"", b"\xff\xfeA", b"\xff\xfe\x00\xd8A\x00"]

    def python(b):
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            try:
                return b.decode("utf-16")
            except UnicodeDecodeError:
                pass
        for e in ("utf-8-sig", "cp1250", "latin-1"):
            try:
                return b.decode(e)
            except UnicodeDecodeError:
                pass

    got = values(spark, [(bytearray(c),) for c in cases], "b binary", T.decode_text("b"))
    assert [g[0] for g in got] == [python(c) for c in cases]
    assert values(spark, [(None,)], "b binary", T.decode_text("b")) == [(None,)]


@pytest.mark.parametrize(
    ("name", "mime", "data", "kind", "source"),
    [
        ("x.docx", "", b"%PDF-1.4", "pdf", "signature"),
        ("x.docx", None, b"PKzz", "docx", "metadata"),
        ("x", "application/pdf; q=1", b"abc", "pdf", "metadata"),
        ("x.MD", None, b"\x00\x01", "text", "metadata"),
        (None, "text/x-thing", b"abc", "text", "metadata"),
        ("x.bin", "application/json", b"{}", "text", "content"),
        ("x.bin", None, b"\x00\x01\x02\x03", None, None),
        ("x.bin", None, b"\xef\xbb\xbf", None, None),
        ("x.txt", None, b"", None, None),
        ("x.txt", None, None, None, None),
    ],
)
def test_detection(spark, name, mime, data, kind, source):
    df = spark.createDataFrame([("d", name, mime, bytearray(data) if data is not None else None)], "doc_id string, filename string, content_type string, content binary")
    r = D.detect(df).first().detected
    assert (r.kind, r.source) == (kind, source)
    assert (r.error is None) == (kind is not None)


def test_labels_and_short_sources(spark):
    rows = [("Jan  Kowalski x",), ("ż",), ("a" * 65,), ("  \n",), ("[OSOBA_1]",), ("a < b > c",), ("7.",)]
    got = values(spark, rows, "t string", T.redaction_label("t"), T.unsafe_short_source("t"), T.looks_like_redaction("t"), T.search_candidates("t"))
    assert [g[0] for g in got] == ["Jan Kowalski x", "****", "****", "", "[OSOBA_1]", "a < b > c", "7."]
    assert [g[1] for g in got] == [False, True, False, False, False, False, True]
    assert [g[2] for g in got] == [False, False, False, False, True, True, False]
    assert got[0][3] == ["Jan  Kowalski x", "Jan Kowalski x"] and got[3][3] == []


# ---- inline algebra ---------------------------------------------------------

piece = st.tuples(st.sampled_from(["text", "text", "opaque"]), st.text("ab😀 ", max_size=4), st.sampled_from([None, "<b/>", "<i/>"]))


def split(ps, o):
    out, at = [], 0
    for k, t, r in ps:
        if k == "text" and at < o < at + len(t):
            out += [(k, t[: o - at], r), (k, t[o - at :], r)]
        else:
            out.append((k, t, r))
        at += len(t)
    return out


def index(ps, o):
    at = 0
    for n, (_, t, _) in enumerate(ps):
        if at >= o:
            return n
        at += len(t)
    return len(ps)


def insert(ps, o, new):
    ps = split(ps, o)
    n = index(ps, o)
    return ps[:n] + new + ps[n:]


def replace(ps, a, b, new):
    ps, out, at, put = split(split(ps, b), a), [], 0, False
    for k, t, r in ps:
        if k == "text" and at >= a and at + len(t) <= b and at < b and at + len(t) > a:
            out += [] if put else new
            put = True
        else:
            out.append((k, t, r))
        at += len(t)
    if not put:
        n = index(out, a)
        out = out[:n] + new + out[n:]
    return out


def rpr(ps, o):
    at, last = 0, None
    for k, t, r in ps:
        if k == "text":
            if at <= o <= at + len(t):
                return r
            last = r
        at += len(t)
    return last


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.lists(piece, max_size=5), st.integers(0, 9), st.integers(0, 9)), min_size=25, max_size=25))
def test_inline_algebra(spark, cases):
    rows = [([{"kind": k, "text": t, "rpr": r, "element": None} for k, t, r in ps], min(a, b), max(a, b)) for ps, a, b in cases]
    df = spark.createDataFrame(rows, f"p array<{S.INLINE}>, a int, b int")
    new = F.array(I.text_piece("NEW"))
    got = df.select("p", "a", "b", I.visible_text("p").alias("v"), I.split_at("p", F.col("a")).alias("s"), I.insert_at("p", F.col("a"), new).alias("i"), I.replace_range("p", F.col("a"), F.col("b"), new).alias("r"), I.rpr_at("p", F.col("a")).alias("f"), I.index_at("p", F.col("a")).alias("n")).collect()
    flat = lambda ps: [(x.kind, x.text, x.rpr) for x in ps]
    for g in got:
        ps = flat(g.p)
        assert g.v == "".join(t for _, t, _ in ps)
        assert flat(g.s) == split(ps, g.a)
        assert g.n == index(ps, g.a)
        assert flat(g.i) == insert(ps, g.a, [("text", "NEW", None)])
        assert g.f == rpr(ps, g.a)
        assert flat(g.r) == replace(ps, g.a, g.b, [("text", "NEW", None)]), (ps, g.a, g.b)


def test_rebuilt_markup(spark):
    rows = [([{"kind": "text", "text": "a <b ", "rpr": "<w:rPr/>", "element": None}, {"kind": "opaque", "text": "\t", "rpr": None, "element": "<w:r><w:tab/></w:r>"}, {"kind": "text", "text": "", "rpr": None, "element": None}],)]
    assert values(spark, rows, f"p array<{S.INLINE}>", I.paragraph_xml("p")) == [('<w:r><w:rPr/><w:t xml:space="preserve">a &lt;b </w:t></w:r><w:r><w:tab/></w:r>',)]


# ---- layout -----------------------------------------------------------------


def greedy(text, most=49_900):
    """Lines filled word by word, the plain way."""
    out = []
    for line in text.split("\n"):
        now = ""
        for word in line.split():
            if now and L.text_width(f"{now} {word}") <= most:
                now += f" {word}"
                continue
            if now:
                out.append(now)
            now = ""
            for c in word:
                if now and L.text_width(now + c) > most:
                    out.append(now)
                    now = ""
                now += c
        out.append(now)
    return out


def test_wrapping(spark):
    texts = ["", "one two\tthree", "word " * 90, "x" * 400, "ala ma kota\n\nżółć " + "漢" * 80, "W" * 60 + " tail " + "i" * 500, " \n "]
    for t in texts:
        assert L.wrap(t) == greedy(t)
    rows = [("\n".join(map(str, range(130))) + "\fend",), (None,), ("",)]
    got = [r.pages for r in L.flowed(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert [len(p) for p in got[0]] == [58, 58, 14, 1] and got[1] is None and got[2] == [[""]]
    assert L.reflow_text(["a\n\n", "b"]) == "a\nb"


def test_rectangles_merge_by_line(spark):
    rects = [(60.0, 10.0, 70.0, 20.0), (10.0, 10.5, 20.0, 20.5), (10.0, 40.0, 20.0, 50.0)]
    want = [(9.25, 9.25, 65.0, 21.25), (9.25, 39.25, 20.75, 50.75)]
    assert L.merge_lines(rects, 65.0, 800.0) == want
    assert L.span_rects("a b", [rects[0], None, rects[1]], 0, 3, 65.0, 800.0) == [want[0]]
    assert L.span_rects("abc", [rects[0], None, rects[1]], 0, 3, 65.0, 800.0) == []
    got = L.merged_boxes(spark.createDataFrame([(rects,), ([],), (None,)], f"r array<{L.RECT}>"), "r", 65.0).collect()
    assert [tuple(x)[:4] for x in got[0].boxes] == want and got[1].boxes == [] and got[2].boxes is None


def test_soft_wraps():
    rows = [("goes on", 48.0, 590.0, 48.0), ("ends.", 48.0, 590.0, 48.0), ("short", 48.0, 90.0, 48.0), ("long line", 48.0, 500.0, 60.0), (" ", 48.0, 590.0, 48.0)]
    assert [L.soft_wrapped(*r, 595.0) for r in rows] == [True, False, False, True, False]


def test_numbers_in_groups_of_any_size(spark):
    rows = [("big", k * 7 if k else None, f"t{k}") for k in range(3000)] + [("small", 5, "b"), ("small", 5, "a"), (None, 1, "x")]
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(7)
    got = {(r.g, r.t): r.n for r in number_rows(df, "g", "k", "t").collect()}
    assert all(got["big", f"t{k}"] == k for k in range(3000))
    assert got["small", "a"] == 0 and got["small", "b"] == 1 and got[None, "x"] == 0
    assert number_rows(df.limit(0), "g", "k").count() == 0


def test_paths_do_not_depend_on_the_machine():
    assert os.path.sep == "/"
