"""Page edits as differences: changed spans, and how a page can be written back.

The differences of a page are computed once and both results derive from them.
Pages that didn't change never reach Python. What two texts begin and end with in
common is left out first; the rest is compared by characters at every size, by the
rule of the longest common stretch (the first one if several are as long).
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import layout as L

OPCODE = "struct<tag:string,source_start:int,source_end:int,source_text:string,replacement_text:string>"
_OPS_PA = pa.list_(pa.struct([("tag", pa.string()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("source_text", pa.string()), ("replacement_text", pa.string())]))
_COMPARED_PA = pa.struct([("ops", _OPS_PA), ("fits", pa.bool_())])
COMPARED = f"struct<ops:array<{OPCODE}>,fits:boolean>"


class Matcher(difflib.SequenceMatcher):
    """The library's matcher with its longest common stretch found a row of the second text at a time."""

    def __init__(self, a: str, b: str):  # without the library's own index of the second text
        self.a, self.b, self.matching_blocks, self.opcodes, self.fullbcount = a, b, None, None, None
        signs = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4")
        self.places = {c: np.flatnonzero(signs == ord(c)) for c in set(a)}

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        best_i, best_j, best = alo, blo, 0
        run = np.zeros(bhi - blo + 1, np.int32)  # length of the common stretch that ends before each place
        none = np.zeros(0, np.int64)
        old = none
        for i in range(alo, ahi):
            at = self.places.get(self.a[i], none)
            if len(at):
                lo, hi = at.searchsorted((blo, bhi))
                at = at[lo:hi] - blo
            grown = run[at] + 1
            run[old] = 0
            old = at + 1
            run[old] = grown
            if len(grown) and (k := int(grown.argmax())) >= 0 and grown[k] > best:
                best = int(grown[k])
                best_i, best_j = i - best + 1, int(at[k]) + blo - best + 1
        return difflib.Match(best_i, best_j, best)


def _common(most: int, same: Callable[[int], bool]) -> int:
    """The largest length up to ``most`` at which two texts are the same, halving what is left."""
    least = 0
    while least < most:
        k = (least + most + 1) // 2
        least, most = (k, most) if same(k) else (least, k - 1)
    return least


def opcodes(a: str, b: str) -> list[dict]:
    """Replacements, deletions and insertions that lead from ``a`` to ``b``."""
    least = min(len(a), len(b))
    head = _common(least, lambda k: a[:k] == b[:k])
    tail = _common(least - head, lambda k: a[len(a) - k :] == b[len(b) - k :])
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    matcher = Matcher(x, y) if len(x) * len(y) > 4096 else difflib.SequenceMatcher(None, x, y, autojunk=False)
    ops = [(t, i + head, j + head, k + head, m + head) for t, i, j, k, m in matcher.get_opcodes() if t != "equal"]
    return [{"tag": t, "source_start": i, "source_end": j, "source_text": a[i:j], "replacement_text": b[k:m]} for t, i, j, k, m in ops]


def compare(source: str, target: str, width: float | None = None, height: float | None = None) -> dict:
    """The differences, and whether the new text, wrapped, fits its page (of the usual size where none is known)."""
    if source == target:
        return {"ops": [], "fits": True}
    return {"ops": opcodes(source, target), "fits": L.fits_page(target, width or L.WIDTH, height or L.HEIGHT)}


def with_opcodes(pages: DataFrame, source: str = "source_text", target: str = "text", width: str | None = None, height: str | None = None) -> DataFrame:
    """Pages with ``ops array<opcode>`` and ``fits``; unchanged ones have no ops and fit. Nulls count as empty texts
    where the other side has text."""
    a, b = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    w, h = (F.coalesce(F.col(c).cast("double"), F.lit(d)) if c else F.lit(d) for c, d in ((width, L.WIDTH), (height, L.HEIGHT)))
    same = pages.filter(a == b).withColumn("ops", F.array().cast(f"array<{OPCODE}>")).withColumn("fits", F.lit(True))
    todo = pages.filter(a != b).withColumns({"_a": a, "_b": b, "_w": w, "_h": h})
    done = L.with_column(todo, "_c", COMPARED, _COMPARED_PA, compare, "_a", "_b", "_w", "_h")
    return same.unionByName(done.withColumn("ops", F.col("_c.ops")).withColumn("fits", F.col("_c.fits")).drop("_a", "_b", "_w", "_h", "_c"))


def changed_spans(df: DataFrame) -> DataFrame:
    """``ops`` without insertions, exploded: ``(..., ord, tag, source_start, source_end, source_text, replacement_text)``."""
    spans = F.filter("ops", lambda o: o["tag"] != "insert")
    kept = [c for c in df.columns if c not in ("ops", "fits", "source_text", "text")]
    return df.select(*kept, F.posexplode(spans).alias("ord", "o")).select(*kept, "ord", "o.*")


def strategy(source: Column, target: Column, ops: Column) -> Column:
    """How a page by itself is written back: ``unchanged``, ``redact`` in place, or ``rebuild``."""

    def own(red: Column) -> Column:  # looked for once a page, not once a change
        op = F.exists(
            ops,
            lambda o: ((o["tag"] == "insert") & ~red)
            | ((o["tag"] == "delete") & ~red & ~T.is_blank(o["source_text"]))
            | ((o["tag"] == "replace") & T.requires_reflow(o["source_text"], o["replacement_text"], red)),
        )
        return F.when(((F.length(target) > F.length(source)) & ~red) | op, "rebuild").otherwise("redact")

    return F.when(source == target, "unchanged").otherwise(T.let(T.looks_like_redaction(target), own))


def page_strategy(df: DataFrame, fits: str | None = None, doc: str = "doc_id", source: str = "source_text", target: str = "text") -> DataFrame:
    """``strategy`` of each page; with ``fits`` (whether a rebuilt page's text fits its page) one page that doesn't makes its
    whole document ``reflow``. ``dropped_insert`` tells where a pure insertion into a redacted page would be lost by writing in place.

    The documents that flow are those of the pages that don't fit, few and narrow; no document is gathered.
    """
    a, b = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    lost = (a != b) & T.looks_like_redaction(b) & F.exists("ops", lambda o: o["tag"] == "insert")
    out = df.withColumn("strategy", strategy(a, b, F.col("ops"))).withColumn("dropped_insert", lost)
    if fits is None:
        return out
    over = out.filter((F.col("strategy") == "rebuild") & ~F.col(fits)).groupBy(doc).agg(F.lit(True).alias("_over"))
    return out.join(over, doc, "left").withColumn("strategy", F.when(F.col("_over"), "reflow").otherwise(F.col("strategy"))).drop("_over")


# ---- pages in one row a document ----------------------------------------------


def compare_pages(docs: DataFrame, pages: str = "edited") -> DataFrame:
    """An array of pages ``(page, source_text, text, width, height)`` with ``ops``, ``fits`` and ``strategy`` in each; one rebuilt
    page that doesn't fit makes all of them ``reflow``. Labels of the changes are added for the writer."""
    each = lambda ps: [compare(p["source_text"], p["text"], p["width"], p["height"]) for p in ps]
    got = L.with_column(docs, "_c", f"array<{COMPARED}>", pa.list_(_COMPARED_PA), each, pages)
    label = lambda o: o.withField("label", T.redaction_label(o["replacement_text"]))
    whole = F.zip_with(pages, "_c", lambda p, c: p.withField("ops", F.transform(c["ops"], label)).withField("fits", c["fits"]).withField("strategy", strategy(p["source_text"], p["text"], c["ops"])))
    got = got.withColumn(pages, whole).drop("_c")
    over = F.exists(pages, lambda p: (p["strategy"] == "rebuild") & ~p["fits"])
    return got.withColumn("_over", over).withColumn(pages, F.when(F.col("_over"), F.transform(pages, lambda p: p.withField("strategy", F.lit("reflow")))).otherwise(F.col(pages))).drop("_over")
