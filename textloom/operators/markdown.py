"""Markdown round trip: a marker line before each segment's text.

Newlines at the end of a segment's text do not survive the round trip. A
duplicate marker's last text counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "textloom"


def to_markdown(segments: DataFrame, order: list[str], marker: str = MARKER) -> DataFrame:
    """One ``(doc_id, markdown)`` for each document. A block is the marker of an id and the text; nulls read as empty."""
    block = F.concat(F.lit(f"<!-- {marker}:"), F.col("id"), F.lit(" -->\n"), F.coalesce("text", F.lit("")))
    rows = F.struct(*order, block.alias("block"))
    got = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(rows)).alias("b"))
    return got.select("doc_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("markdown"))


def markdown_blocks(docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """Rows ``(doc_id, pos, id, text)`` of the marked blocks."""
    head = f"<!-- {marker}:(s[0-9]+) -->\\n"
    ids = F.regexp_extract_all("markdown", F.lit(f"(?:^|\\n){head}"), F.lit(1))
    texts = F.slice(F.split("markdown", f"(?:^|\\n)<!-- {marker}:s[0-9]+ -->\\n", -1), 2, 1 << 30)
    return docs.select("doc_id", F.posexplode(F.arrays_zip(ids.alias("id"), texts.alias("text"))).alias("pos", "x")).select("doc_id", "pos", "x.id", F.regexp_replace("x.text", r"\n+\z", "").alias("text"))


def apply_markdown(segments: DataFrame, docs: DataFrame, marker: str = MARKER, strict: bool = True) -> DataFrame:
    """Segments with the texts of their marked blocks. ``strict``: a document whose ids differ gets an ``error`` and keeps its texts."""
    blocks = markdown_blocks(docs, marker)
    last = blocks.groupBy("doc_id", "id").agg(F.max_by("text", "pos").alias("new_text"))
    out = segments.join(last, ["doc_id", "id"], "left")
    if not strict:
        return out.withColumn("text", F.coalesce("new_text", "text")).withColumn("error", F.lit(None).cast("string")).drop("new_text")
    both = mismatches(segments, docs, marker).groupBy("doc_id").agg(F.count("*").alias("n"))
    bad = F.col("n") > 0
    out = out.join(both, "doc_id", "left")
    return out.withColumn("text", F.when(bad, F.col("text")).otherwise(F.coalesce("new_text", "text"))).withColumn("error", F.when(bad, "markdown marker mismatch")).drop("new_text", "n")


def mismatches(segments: DataFrame, docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """Rows ``(doc_id, id, problem)``: ids without a block (missing), blocks without a segment (unknown)."""
    blocks = markdown_blocks(docs, marker).select("doc_id", "id").distinct()
    have = segments.select("doc_id", "id").distinct()
    missing = have.join(docs.select("doc_id"), "doc_id", "left_semi").join(blocks, ["doc_id", "id"], "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(blocks.join(have, ["doc_id", "id"], "left_anti").withColumn("problem", F.lit("unknown")))
