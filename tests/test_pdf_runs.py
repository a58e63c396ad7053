"""PDF texts read by whole strings, and each file made and read once."""

import os
import random

import pytest

from textloom.operators import diff, layout as L
from textloom.sources import pdf, pdf_filters

DATA = os.environ.get("TEXTLOOM_TEST_DATA", "/root/testdata/sf0.001")
PLAIN = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
#: A ligature of two characters, a character without width, one without a name.
ODD = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 65 /Widths [500 0 600 -300] /Encoding << /Differences [65 /f_i.x /B /fi /D] >> >>"


def file_of(content, font=PLAIN):
    page = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>"
    stream = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)
    return pdf._file({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", 3: page, 4: stream, 5: font}, 1)


@pytest.mark.parametrize("font", [PLAIN, ODD])
@pytest.mark.parametrize("content", [
    b"BT /F1 10 Tf 48 700 Td (Some words) Tj ( and more) Tj T* 0 -12 Td (\\(below\\)) Tj ET",
    b"BT /F1 10 Tf 2 Tc 48 700 Td (spaced ABCD) Tj 0 Tc 40 Tw (wide gaps) Tj ET",
    b"BT /F1 10 Tf -100 Tz 300 700 Td (mirrored) Tj 100 Tz (ABCD ABCD) Tj ET",
    b"BT /F1 10 Tf 0 1 -1 0 300 300 Tm (turned ABC) Tj 1 0 0.3 1 40 40 Tm (slanted) Tj ET",
    b"BT /F1 10 Tf 48 700 Td [(kern) -200 (ed) -900 (far) 3000 (back)] TJ () Tj ( ) Tj (end) ' ET",
    b"BT /F1 0 Tf 48 700 Td (no size) Tj /F1 10 Tf (A) Tj (B) Tj (C) Tj (D) Tj ET",
])
def test_runs_read_as_glyphs_do(font, content):
    f = pdf.Pdf(file_of(content, font))
    page = f.pages[0]
    assert pdf.page_text(pdf.runs(f, page), 595.0)[0] == pdf.page_text(pdf.glyphs(f, page), 595.0)[0]


@pytest.mark.parametrize("two", [False, True])
def test_a_long_text_is_read_a_string_at_a_time(two):
    """Each line of a set text is one piece, with the rectangle of its glyphs to the last bit."""
    words = random.Random(3)
    text = " ".join("".join(words.choices("abcdeéWi.,", k=words.randint(1, 12))) for _ in range(3000))
    ls = L.flow_pages(text)
    f = pdf.Pdf(pdf.build(ls, two=two))
    for page, lines in zip(f.pages, ls):
        runs, glyphs = pdf.runs(f, page), pdf.glyphs(f, page)
        assert [r.c for r in runs] == lines
        ends = [[glyphs[k] for k in line] for line in pdf.lines(glyphs)]
        assert [r.rect for r in runs] == [(min(g.rect[0] for g in gs), gs[0].rect[1], max(g.rect[2] for g in gs), gs[0].rect[3]) for gs in ends]
        assert pdf.page_text(runs, L.WIDTH)[0] == pdf.page_text(glyphs, L.WIDTH)[0]


@pytest.mark.parametrize("a, b", [("", "x"), ("abc", "abc"), ("aXa", "aa"), ("aa", "aXa"), ("secret \ud800x", "\ud800" + "many words é " * 700), ("ab" * 90, "ba" * 90)])
def test_differences_lead_from_one_text_to_the_other(a, b):
    out, at = [], 0
    for o in diff.opcodes(a, b):
        assert a[o["source_start"] : o["source_end"]] == o["source_text"]
        out += [a[at : o["source_start"]], o["replacement_text"]]
        at = o["source_end"]
    assert "".join(out) + a[at:] == b


@pytest.mark.parametrize("n", [0, 1, 253, 254, 255, 3837, 3838, 3839, 3840, 9000])
def test_lzw_at_the_edges_of_its_table(n):
    data = random.Random(n).randbytes(n)
    assert pdf_filters.lzw(pdf_filters.encode_lzw(data)) == data


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["pdf_rebuilt", "pdf_reflowed"])
def test_each_file_is_made_and_read_once(spark, name):
    """Made and read, compared, written and read again: each is one step of the plan, and no file is shuffled."""
    from textloom.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Join" not in plan
