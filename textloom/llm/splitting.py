"""Problem 1: cut oversized texts at natural boundaries, with overlap.

Sizes are UTF-8 bytes. Prefix sums of the bytes of each code point turn every
size question into a binary search; natural boundaries are one sorted array for
each rank (blank line, line end, sentence end, clause end, space).

Defined cases: null text or null limit gives no piece limit (the item comes out
whole; a null text gives one null piece); an empty text is one empty piece; a
single code point larger than the limit comes out alone; an overlap of the limit or
more is taken as the limit less one byte, and a piece that is no longer than its
overlap is followed without one, so that pieces always advance.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import bounded_rows

#: Ranks of natural boundaries, strongest first; a boundary is where the next piece would begin.
RANKS = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…।؟]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*\s*"),
    re.compile(r"[,;:]\s+|[，、；：]"),
    re.compile(r"\s+"),
)
PIECE_DDL = "array<struct<piece_no:int,n_pieces:int,start_off:int,end_off:int,piece:string>>"
PIECE_TYPE = pa.list_(pa.struct([("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_off", pa.int32()), ("end_off", pa.int32()), ("piece", pa.string())]))


def byte_prefix(text: str) -> np.ndarray:
    """``p[i]``: UTF-8 bytes of the first ``i`` code points."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    return np.concatenate(([0], np.cumsum(size)))


def _joined(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part a letter from its marks, or the parts of one emoji."""
    if not 0 < at < len(text):
        return False
    c, p = text[at], text[at - 1]
    return unicodedata.category(c)[0] == "M" or c == "\u200d" or p == "\u200d" or 0x1F3FB <= ord(c) <= 0x1F3FF


def split_spans(text: str, max_bytes: int, overlap_bytes: int) -> list[tuple[int, int]]:
    """Spans ``(start, end)`` of the pieces, which cover the text in order."""
    n = len(text)
    pre = byte_prefix(text)
    if max_bytes <= 0 or pre[n] <= max_bytes:
        return [(0, n)]
    overlap = max(0, min(overlap_bytes, max_bytes - 1))
    ranks = [np.fromiter((m.end() for m in r.finditer(text)), np.int64) for r in RANKS]
    every = np.unique(np.concatenate(ranks))
    spans, start = [], 0
    while True:
        if pre[n] - pre[start] <= max_bytes:
            spans.append((start, n))
            return spans
        top = int(np.searchsorted(pre, pre[start] + max_bytes, "right")) - 1
        cut = 0
        # A stronger boundary is taken while it leaves the piece at least half full, a weaker one later.
        most = (overlap + max_bytes) // 2
        for least in (max(max_bytes // 2, most if 3 * overlap > max_bytes else 0), min(2 * overlap, most)):
            floor = int(np.searchsorted(pre, pre[start] + least, "left"))
            for r in ranks:
                k = int(np.searchsorted(r, top, "right")) - 1
                if k >= 0 and r[k] > max(floor, start):
                    cut = int(r[k])
                    break
            if cut:
                break
        if not cut:
            cut = max(top, start + 1)
            back = cut
            while back > start + 1 and _joined(text, back):
                back -= 1
            cut = cut if _joined(text, back) else back
        spans.append((start, cut))
        want = pre[cut] - overlap
        lo, hi = (int(np.searchsorted(pre, w, "left")) for w in (want - overlap // 2, want + overlap // 2))
        near = every[np.searchsorted(every, lo, "left") : np.searchsorted(every, hi, "right")] if overlap else every[:0]
        near = near[(near > start) & (near < cut)]
        if len(near):
            nxt = int(near[np.argmin(np.abs(pre[near] - want))])
        else:
            nxt = int(np.searchsorted(pre, want, "left")) if overlap else cut
            while nxt < cut and _joined(text, nxt):
                nxt += 1
        start = nxt if start < nxt < cut else cut


def _limit_columns(limits: DataFrame, src: str):
    """Expressions for the limit and the overlap of a row's source, from a parameter table of at most 1,000 rows."""
    max_col, over_col = F.lit(None).cast("int"), F.lit(0)
    for r in bounded_rows(limits.select("src", "max_bytes", "overlap_bytes"), 1000, "split limits"):
        if r.src is not None and r.max_bytes is not None:
            max_col = F.when(F.col(src) == r.src, F.lit(int(r.max_bytes))).otherwise(max_col)
            over_col = F.when(F.col(src) == r.src, F.lit(int(r.overlap_bytes or 0))).otherwise(over_col)
    return max_col, over_col


def split_oversized(df: DataFrame, limits: DataFrame, text: str = "text", src: str = "src") -> DataFrame:
    """Rows over their limit, with ``pieces`` in place of the text. The size test runs on the JVM."""
    max_col, over_col = _limit_columns(limits, src)
    kept = [c for c in df.columns if c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept]

    def run(batches):
        for b in batches:
            out = []
            texts, most, over = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (text, "_max", "_over"))
            for t, m, o in zip(texts, most, over):
                spans = split_spans(t, m, o)
                out.append([{"piece_no": k, "n_pieces": len(spans), "start_off": s, "end_off": e, "piece": t[s:e]} for k, (s, e) in enumerate(spans)])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + [pa.array(out, PIECE_TYPE)], names=[*kept, "pieces"])

    large = df.filter(F.octet_length(text) > max_col)
    return large.withColumn("_max", max_col).withColumn("_over", over_col).mapInArrow(run, ", ".join([*fields, f"pieces {PIECE_DDL}"]))


def split_items(df: DataFrame, limits: DataFrame, text: str = "text", src: str = "src") -> DataFrame:
    """Replace the text of rows ``(src, ..., text)`` by ``pieces``, each at most the limit of its ``src``.

    Rows within their limit stay on the JVM as one whole piece; only oversized rows visit Python.
    """
    max_col, _ = _limit_columns(limits, src)
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_off"), F.length(text).alias("end_off"), F.col(text).alias("piece"))).cast(PIECE_DDL)
    fits = df.filter(~F.coalesce(F.octet_length(text) > max_col, F.lit(False))).withColumn("pieces", whole).drop(text)
    return fits.unionByName(split_oversized(df, limits, text, src))
