"""Edits, markdown and differences."""

import pytest
from pyspark.sql import functions as F

from textloom import schema as S
from textloom.operators import diff, edits as E, markdown as M

SEG = "doc_id string, id string, text string, container_id string, paragraph_index int"


@pytest.fixture(scope="module")
def segs(spark):
    rows = [("d", "s0", "Hello world", "body:p:0", 0), ("d", "s1", "Alpha Beta Gamma", "body:p:1", 1), ("d", "s2", "a😀b", "header:0:p:0", 2), ("e", "s0", "", "body:p:0", 0), ("f", "s0", None, "body:p:0", 0)]
    return spark.createDataFrame(rows, SEG)


def edits(spark, *rows):
    return spark.createDataFrame(list(rows), S.EDIT)


def apply(spark, segs, *rows, **kw):
    return {(r.doc_id, r.id): (r.text, r.error) for r in E.apply_edits(segs, edits(spark, *rows), **kw).collect()}


def test_ordered_fold(spark, segs):
    got = apply(spark, segs, ("d", 2, "body:p:1", None, "Z", 0, 1), ("d", 1, "body:p:1", "s0", "XX", 6, 10), ("d", 3, "", "s0", "Bye", None, None), ("d", 3, "", "s0", "Bye", None, None), ("d", 4, None, "s2", "é", 1, 2))
    assert got["d", "s1"] == ("Zlpha XX Gamma", None)
    assert got["d", "s0"] == ("Bye", None)
    assert got["d", "s2"] == ("aéb", None)
    assert got["e", "s0"] == ("", None) and got["f", "s0"] == (None, None)


@pytest.mark.parametrize(("a", "b"), [(-1, 1), (0, 100), (5, 5), (6, 5)])
def test_bad_ranges_change_nothing(spark, segs, a, b):
    got = apply(spark, segs, ("d", 1, "body:p:0", None, "X", a, b), ("d", 2, "body:p:0", None, "later", None, None))
    assert got["d", "s0"] == ("Hello world", E.RANGE_ERROR)
    left = E.suppress_failed(E.apply_edits(segs, edits(spark, ("d", 1, "body:p:0", None, "X", a, b))))
    assert {r.doc_id for r in left.collect()} == {"e", "f"}


def test_missing_offsets_mean_the_ends(spark, segs):
    assert apply(spark, segs, ("d", 1, "body:p:0", None, "X", None, 5))["d", "s0"] == ("X world", None)
    assert apply(spark, segs, ("d", 1, "body:p:0", None, "X", 6, None))["d", "s0"] == ("Hello X", None)
    assert apply(spark, segs, ("d", 1, "body:p:0", None, None, None, None))["d", "s0"] == ("", None)


def test_unknown_targets(spark, segs):
    e = [("d", 1, "nowhere", "s0", "X", None, None), ("d", 2, None, None, "X", None, None), ("zz", 1, None, "s0", "X", None, None)]
    assert apply(spark, segs, *e)["d", "s0"] == ("Hello world", None)  # no fallback to the id
    assert {tuple(r) for r in E.unknown_targets(segs, edits(spark, *e)).collect()} == {("d", "c:nowhere"), ("zz", "i:s0")}
    with pytest.raises(Exception, match="unknown edit target"):
        apply(spark, segs, *e, strict=True)


def test_empty_tables(spark, segs):
    none = spark.createDataFrame([], S.EDIT)
    assert E.apply_edits(segs, none).count() == 5
    assert E.apply_edits(segs.limit(0), none).count() == 0
    assert M.to_markdown(segs.limit(0), ["paragraph_index"]).count() == 0


def test_other_spellings_of_edits(spark):
    df = spark.createDataFrame([("d", "s1", 123)], "doc_id string, segment_id string, replacement_text int")
    assert E.as_edits(df).first().asDict() == {"doc_id": "d", "seq": 0, "container_id": None, "id": "s1", "text": "123", "start_offset": None, "end_offset": None}


def test_positional_texts(spark, segs):
    given = spark.createDataFrame([("d", 0, "A"), ("d", 1, "B"), ("d", 2, "C"), ("e", 0, "D"), ("e", 1, "too many")], "doc_id string, pos int, new_text string")
    got = {(r.doc_id, r.id): (r.text, r.error) for r in E.apply_texts(segs, given, "paragraph_index").collect()}
    assert got["d", "s1"] == ("B", None)
    assert got["e", "s0"] == ("", "expected 1 text segments, got 2")
    assert got["f", "s0"][1] == "expected 1 text segments, got 0"


def test_placeholder(spark, segs):
    got = {r.id: (r.text, r.error) for r in E.replace_placeholder(segs.filter("doc_id = 'd'"), "l", "[L]").collect()}
    assert got == {"s0": ("He[L]lo world", None), "s1": ("A[L]pha Beta Gamma", None), "s2": ("a😀b", E.MISSING_ERROR)}


def test_runs_keep_their_formatting(spark):
    runs = [(0, "Hello", "<b/>"), (1, " ", None), (2, "World", "<i/>")]
    df = spark.createDataFrame([(runs,)], f"r array<{S.RUN}>")
    r = F.col("r")
    got = df.select(E.replace_in_runs(r, F.lit(3), F.lit(8), F.lit("X")).alias("a"), E.replace_all_runs(r, F.lit("new")).alias("b"), E.replace_all_runs(F.slice(r, 1, 0), F.lit("new")).alias("c")).first()
    assert [(x.text, x.rpr) for x in got.a] == [("Hel", "<b/>"), ("X", "<b/>"), ("", None), ("", "<i/>"), ("rld", "<i/>")]
    assert [x.text for x in got.b] == ["new", "", ""] and [x.text for x in got.c] == ["new"]


def test_markdown_round_trip(spark):
    rows = [("d", "s0", "one\n\ntwo\n", "c", 0), ("d", "s1", "", "c", 1), ("d", "s2", "<!-- textloom: -->", "c", 2)]
    segs = spark.createDataFrame(rows, SEG)
    md = M.to_markdown(segs, ["paragraph_index"])
    assert md.first().markdown.startswith("<!-- textloom:s0 -->\none\n\ntwo")
    got = {r.id: (r.text, r.error) for r in M.apply_markdown(segs.withColumn("text", F.lit("old")), md).collect()}
    assert got == {"s0": ("one\n\ntwo", None), "s1": ("", None), "s2": ("<!-- textloom: -->", None)}
    wrong = spark.createDataFrame([("d", "<!-- textloom:s0 -->\nA\n\n<!-- textloom:s0 -->\nB\n\n<!-- textloom:s9 -->\nC")], "doc_id string, markdown string")
    assert {r.error for r in M.apply_markdown(segs, wrong).collect()} == {"markdown marker mismatch"}
    lax = {r.id: r.text for r in M.apply_markdown(segs, wrong, strict=False).collect()}
    assert lax["s0"] == "B" and lax["s1"] == ""
    assert {(r.id, r.problem) for r in M.mismatches(segs, wrong).collect()} == {("s1", "missing"), ("s2", "missing"), ("s9", "unknown")}


PAGES = "doc_id string, page int, source_text string, text string"


@pytest.mark.parametrize(
    ("source", "target", "strategy"),
    [
        ("same", "same", "unchanged"),
        ("Jan Kowalski here", "[OSOBA_1] here", "redact"),
        ("Jan here", "Someone longer here", "rebuild"),
        ("one two three", "one three", "rebuild"),
        ("ab cd", "ab xy", "redact"),
        ("abcd", "żxcd", "rebuild"),
        (None, "new", "rebuild"),
        (None, None, "unchanged"),
    ],
)
def test_page_strategy(spark, source, target, strategy):
    df = spark.createDataFrame([("d", 0, source, target)], PAGES)
    assert diff.page_strategy(diff.with_opcodes(df)).first().strategy == strategy


def test_one_overflowing_page_reflows_its_document(spark):
    df = spark.createDataFrame([("d", 0, "a", "long text"), ("d", 1, "x", "x"), ("e", 0, "a", "long text")], PAGES)
    got = diff.page_strategy(diff.with_opcodes(df).withColumn("fits", F.col("doc_id") == "e"), "fits").collect()
    assert {(r.doc_id, r.page): r.strategy for r in got} == {("d", 0): "reflow", ("d", 1): "reflow", ("e", 0): "rebuild"}


def test_changed_spans_and_long_pages(spark):
    a = "".join(f"line {k} of many\n" for k in range(4000))
    b = a.replace("line 7 of", "line seven of", 1)
    ops = diff.opcodes(a, b)
    assert len(ops) < 5
    for o in reversed(ops):
        a = a[: o["source_start"]] + o["replacement_text"] + a[o["source_end"] :]
    assert a == b
    df = spark.createDataFrame([("d", 0, "Jan i Ewa", "*** i *** x")], PAGES)
    got = diff.changed_spans(diff.with_opcodes(df)).collect()
    assert [(r.source_text, r.tag) for r in got][0] == ("Jan", "replace")


def test_a_long_page_without_lines_is_compared_by_characters():
    a = "some words of a long page " * 1000
    b = a[:13_000] + "X" + a[13_001:]
    ops = diff.opcodes(a, b)
    assert [(o["tag"], o["source_start"], o["source_end"], o["replacement_text"]) for o in ops] == [("replace", 13_000, 13_001, "X")]
