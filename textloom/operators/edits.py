"""Ordered edits of segments.

Edits are rows ``(doc_id, seq, container_id, id, text, start_offset,
end_offset)``; their order is ``seq``. A set container_id wins over id, without
fallback. All edits of a segment are gathered in order and folded over its text
by one higher-order aggregate, so a document's edits cost one shuffle of the
edits and no Python. Bad ranges give an ``error`` and leave the text as it was
before them (later edits of the segment are not applied); nothing raises unless
``strict``. Rules: both offsets null mean the whole segment, one null means the
start or the end, ``0 <= start < end <= length`` must hold.

Redelivered edits (all columns equal) count once. An edit without any target, or
with an unknown one, is skipped, or listed by ``unknown_targets``. Edits with a
null text put nothing in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.inline import starts
from textloom.functions.ordering import number_rows
from textloom.functions.text import let

RANGE_ERROR = "invalid offsets"
MISSING_ERROR = "placeholder not found"
TARGET_ERROR = "unknown edit target"


def as_edits(df: DataFrame) -> DataFrame:
    """Edits from rows of other spellings: ``segment_id`` for id, ``replacement_text`` for text, any types."""
    have = set(df.columns)
    pick = lambda names, kind: F.coalesce(*[F.col(n).cast(kind) for n in names if n in have], F.lit(None).cast(kind))
    seq = F.col("seq").cast("int") if "seq" in have else F.lit(0)
    return df.select("doc_id", seq.alias("seq"), pick(["container_id"], "string").alias("container_id"), pick(["id", "segment_id"], "string").alias("id"), F.coalesce(pick(["text", "replacement_text"], "string"), F.lit("")).alias("text"), pick(["start_offset"], "int").alias("start_offset"), pick(["end_offset"], "int").alias("end_offset"))


def fold(text: Column, edits: Column) -> Column:
    """``struct<text, error>`` after ``array<struct<seq, text, start_offset, end_offset>>`` in order of seq."""

    def step(acc: Column, e: Column) -> Column:
        t = acc["text"]
        n = F.length(t)
        whole = e["start_offset"].isNull() & e["end_offset"].isNull()
        a, b = F.coalesce(e["start_offset"], F.lit(0)), F.coalesce(e["end_offset"], n)
        ok = whole | ((a >= 0) & (a < b) & (b <= n))
        new = F.when(whole, e["text"]).otherwise(F.concat(F.substring(t, F.lit(1), a), e["text"], F.substring(t, b + 1, n)))
        done = F.struct(F.when(ok, new).otherwise(t).alias("text"), F.when(~ok, F.lit(RANGE_ERROR)).alias("error"))
        return F.when(acc["error"].isNotNull(), acc).otherwise(done)

    return F.aggregate(F.array_sort(edits), F.struct(text.alias("text"), F.lit(None).cast("string").alias("error")), step)


def _keyed(edits: DataFrame) -> DataFrame:
    """Edits with the kind and the value of their target; those without one are left out."""
    by_container = F.nullif(F.col("container_id"), F.lit(""))
    target = F.coalesce(F.concat(F.lit("c:"), by_container), F.concat(F.lit("i:"), F.nullif(F.col("id"), F.lit(""))))
    cols = ["doc_id", "seq", "container_id", "id", "text", "start_offset", "end_offset"]
    return edits.select(*cols).withColumn("target", target).filter(F.col("target").isNotNull())


def _grouped(edits: DataFrame) -> DataFrame:
    """Each target's edits, a redelivered one once: the set is built on the way, without a shuffle of its own."""
    e = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"), "start_offset", "end_offset")
    return _keyed(edits).groupBy("doc_id", "target").agg(F.collect_set(e).alias("edits"))


def by_document(edits: DataFrame) -> DataFrame:
    """``(doc_id, edits)``: each document's edits with their ``target``, redelivered ones once, for documents that are one row."""
    e = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"), "start_offset", "end_offset", "target")
    return _keyed(edits).groupBy("doc_id").agg(F.collect_set(e).alias("edits"))


def apply_edits(segments: DataFrame, edits: DataFrame, strict: bool = False) -> DataFrame:
    """Segments with their text after the edits, and an ``error``. ``strict``: unknown targets raise."""
    if strict and unknown_targets(segments, edits).take(1):
        raise ValueError(TARGET_ERROR)
    g = _grouped(edits)
    c = g.filter(F.col("target").startswith("c:")).select("doc_id", F.substring("target", 3, 1 << 30).alias("container_id"), F.col("edits").alias("by_container"))
    i = g.filter(F.col("target").startswith("i:")).select("doc_id", F.substring("target", 3, 1 << 30).alias("id"), F.col("edits").alias("by_id"))
    none = F.array().cast("array<struct<seq:int,text:string,start_offset:int,end_offset:int>>")
    joined = segments.join(c, ["doc_id", "container_id"], "left").join(i, ["doc_id", "id"], "left")
    todo = F.concat(F.coalesce("by_container", none), F.coalesce("by_id", none))
    out = joined.withColumn("_f", F.when(F.size(todo) > 0, fold(F.col("text"), todo)))
    kept = [x for x in segments.columns if x != "text"]
    out = out.select(*kept, F.coalesce("_f.text", "text").alias("text"), F.col("_f.error").alias("error"))
    return out


def unknown_targets(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Distinct targets ``(doc_id, target)`` that no segment has."""
    have = segments.select("doc_id", F.concat(F.lit("c:"), "container_id").alias("target")).unionByName(segments.select("doc_id", F.concat(F.lit("i:"), "id").alias("target")))
    return _keyed(edits).select("doc_id", "target").distinct().join(have, ["doc_id", "target"], "left_anti")


def suppress_failed(segments: DataFrame) -> DataFrame:
    """Segments of the documents in which no edit failed: a failed document gives no output."""
    bad = segments.filter("error IS NOT NULL").select("doc_id").distinct()
    return segments.join(bad, "doc_id", "left_anti")


def replace_placeholder(df: DataFrame, placeholder: str, replacement: str, text: str = "text") -> DataFrame:
    """The first occurrence replaced; an ``error`` where there is none."""
    at = F.instr(F.col(text), placeholder) if placeholder else F.lit(0)
    new = F.concat(F.substring(F.col(text), F.lit(1), at - 1), F.lit(replacement), F.substring(F.col(text), at + len(placeholder), F.length(text)))
    return df.withColumn("error", F.when(at == 0, MISSING_ERROR)).withColumn(text, F.when(at > 0, new).otherwise(F.col(text)))


def apply_texts(segments: DataFrame, texts: DataFrame, key: str, *ties: str) -> DataFrame:
    """Positional replacement: ``texts (doc_id, pos, new_text)``, positions from 0 in the order of ``key`` and ``ties``; a document whose
    counts differ gets an ``error`` and keeps its texts.

    Both sides meet once, on (doc_id, pos): a row of either without its partner tells that the
    counts differ, and only such documents' counts are taken.
    """
    placed = number_rows(segments, "doc_id", key, *ties, name="pos").withColumn("_s", F.lit(True))
    given = texts.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.struct("new_text").alias("_t"))
    both = placed.join(given, ["doc_id", "pos"], "full")
    counts = both.groupBy("doc_id").agg(F.count("_s").alias("have"), F.count("_t").alias("given"))
    wrong = counts.filter("have != given").select("doc_id", F.concat(F.lit("expected "), F.col("have").cast("string"), F.lit(" text segments, got "), F.col("given").cast("string")).alias("error"))
    joined = both.filter("_s").join(wrong, "doc_id", "left")
    return joined.select(*[c for c in segments.columns if c != "text"], F.when(F.col("error").isNotNull(), F.col("text")).otherwise(F.coalesce("_t.new_text", "text")).alias("text"), "error")


def split_runs(runs: Column, start: Column, end: Column) -> Column:
    """Runs ``array<struct<idx, text, rpr>>`` cut at both offsets, with their ``s`` and ``e``."""
    placed = F.zip_with(runs, starts(runs), lambda r, s: F.struct(r.alias("r"), s.alias("s"), (s + F.length(r["text"])).alias("e")))

    def cut(x: Column, ab: Column) -> Column:
        lo, hi = F.greatest(x["s"], F.least(ab["a"], x["e"])), F.least(x["e"], F.greatest(ab["b"], x["s"]))
        part = lambda a, b: F.struct(x["r"].withField("text", F.substring(x["r"]["text"], a - x["s"] + 1, b - a)).alias("r"), a.alias("s"), b.alias("e"))
        parts = F.filter(F.array(part(x["s"], lo), part(lo, hi), part(hi, x["e"])), lambda y: y["s"] < y["e"])
        return F.when((hi <= x["s"]) | (lo >= x["e"]), F.filter(F.array(x), lambda y: y["s"] < y["e"])).otherwise(parts)

    return let(placed, lambda ps: _with_range(start, end, lambda ab: F.flatten(F.transform(ps, lambda x: cut(x, ab)))))


def _with_range(start: Column, end: Column, body) -> Column:
    """``body`` of a range that is computed once for a row."""
    return let(F.struct(start.alias("a"), end.alias("b")), body)


def replace_in_runs(runs: Column, start: Column, end: Column, text: Column) -> Column:
    """A range replaced inside runs: the first run of the range takes the text, the others of it are emptied."""

    def put(parts: Column, ab: Column) -> Column:
        inside = lambda x: (x["s"] >= ab["a"]) & (x["e"] <= ab["b"])
        first = F.array_position(F.transform(parts, inside), True)
        return let(first, lambda f: F.transform(parts, lambda x, i: F.when(inside(x), x["r"].withField("text", F.when(i + 1 == f, text).otherwise(""))).otherwise(x["r"])))

    return let(split_runs(runs, start, end), lambda parts: _with_range(start, end, lambda ab: put(parts, ab)))


def replace_all_runs(runs: Column, text: Column) -> Column:
    """The first run takes the text, the others are emptied; without runs there is a new one."""
    new = F.array(F.struct(F.lit(0).alias("idx"), text.alias("text"), F.lit(None).cast("string").alias("rpr")))
    return F.when(F.size(runs) == 0, new.cast("array<struct<idx:int,text:string,rpr:string>>")).otherwise(F.transform(runs, lambda r, i: r.withField("text", F.when(i == 0, text).otherwise(""))))
