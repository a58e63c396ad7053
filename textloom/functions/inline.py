"""Offset algebra on inline segments: ``array<struct<kind, text, rpr, element>>`` columns.

A paragraph is an ordered array of text pieces (with their formatting ``rpr``)
and opaque pieces (tabs, breaks, links; never split, kept by every edit).
Offsets count code points of the visible text, which is the text of all pieces.
Offsets of pieces are running sums, made for a whole Arrow batch at a time; all else
are higher-order functions. Everything is linear in the pieces. A null array gives
null; offsets below 0 or past the end act as the ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from textloom import schema as S
from textloom.functions.text import col, let

ARRAY = f"array<{S.INLINE}>"


def _int(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def text_piece(text: Column | str, rpr: Column | None = None) -> Column:
    t = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit("text").alias("kind"), t.alias("text"), (rpr if rpr is not None else F.lit(None).cast("string")).alias("rpr"), F.lit(None).cast("string").alias("element"))


def empty() -> Column:
    return F.array().cast(ARRAY)


def advances_offset(piece: Column) -> Column:
    return piece["kind"].isin("text", "opaque")


def visible_text(pieces: Column | str) -> Column:
    return F.array_join(F.transform(F.filter(col(pieces), advances_offset), lambda p: p["text"]), "")


def visible_len(pieces: Column | str) -> Column:
    return F.length(visible_text(pieces))


def copy_with_text(piece: Column, text: Column) -> Column:
    return piece.withField("text", text)


@F.arrow_udf(ArrayType(IntegerType()))
def _running(lengths: pa.Array) -> pa.Array:
    """Sums of the lengths before each place of an array: one running sum over a whole batch."""
    at = lengths.offsets.to_numpy()
    flat = lengths.values.slice(at[0], at[-1] - at[0]).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
    at = at - at[0]
    own = total[:-1] - np.repeat(total[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own, pa.int32()), mask=lengths.is_null() if lengths.null_count else None)


def starts(pieces: Column | str) -> Column:
    """Offset of each piece: running sums of the lengths, linear in the pieces."""
    return _running(F.transform(col(pieces), lambda p: F.length(p["text"])))


def _at(p: Column, s: Column) -> Column:
    return F.struct(p.alias("p"), s.alias("s"), (s + F.length(p["text"])).alias("e"))


def _placed(pieces: Column) -> Column:
    """Pieces with their ``start`` and ``end``."""
    return F.zip_with(pieces, starts(pieces), _at)


def rpr_at(pieces: Column | str, offset: Column | int) -> Column:
    """Formatting at an offset: of the first text piece that reaches it, else of the last text piece."""

    def pick(texts: Column) -> Column:
        at = let(_int(offset), lambda o: F.filter(texts, lambda x: (x["s"] <= o) & (o <= x["e"])))
        return F.coalesce(F.get(at, F.lit(0)), F.get(texts, F.size(texts) - 1))["p"]["rpr"]

    return let(F.filter(_placed(col(pieces)), lambda x: x["p"]["kind"] == "text"), pick)


def _index(placed: Column, offset: Column) -> Column:
    return let(offset, lambda o: F.size(F.filter(placed, lambda x: x["s"] < o)))


def index_at(pieces: Column | str, offset: Column | int) -> Column:
    """Index of the first piece that begins at or behind an offset; the number of pieces if none does."""
    return let(_placed(col(pieces)), lambda placed: _index(placed, _int(offset)))


def _cut(placed: Column, *offsets: Column) -> Column:
    """Placed pieces with the text pieces that an offset is strictly inside of cut there; ``offsets`` rise."""

    def parts(x: Column, at: Column) -> Column:
        t = x["p"]["text"]
        marks = [F.get(at, F.lit(k)) for k in range(len(offsets))]
        ends = [F.least(F.greatest(o, x["s"]), x["e"]) for o in marks]
        inside = F.lit(False)
        for o in marks:
            inside = inside | ((x["s"] < o) & (o < x["e"]))
        piece = lambda a, b: F.struct(copy_with_text(x["p"], F.substring(t, a - x["s"] + 1, b - a)).alias("p"), a.alias("s"), b.alias("e"))
        cut = F.filter(F.array(*(piece(a, b) for a, b in zip([x["s"], *ends], [*ends, x["e"]]))), lambda y: y["s"] < y["e"])
        return F.when((x["p"]["kind"] == "text") & inside, cut).otherwise(F.array(x))

    # the offsets are computed once for a row, not once for a piece
    return let(placed, lambda ps: let(F.array(*offsets), lambda at: F.flatten(F.transform(ps, lambda x: parts(x, at)))))


def _bare(placed: Column) -> Column:
    return F.transform(placed, lambda x: x["p"])


def split_at(pieces: Column | str, offset: Column | int) -> Column:
    """Cut the text piece that an offset is strictly inside of."""
    return _bare(_cut(_placed(col(pieces)), _int(offset)))


def insert_at(pieces: Column | str, offset: Column | int, insert: Column) -> Column:
    """Put pieces at an offset, before opaque pieces without width that stand there."""
    o = _int(offset)
    put = lambda parts: let(_index(parts, o), lambda k: F.concat(F.slice(_bare(parts), F.lit(1), k), insert, F.slice(_bare(parts), k + 1, F.size(parts))))
    return let(_cut(_placed(col(pieces)), o), put)


def replace_range(pieces: Column | str, start: Column | int, end: Column | int, replacement: Column) -> Column:
    """Drop the text of a range and put the replacement where its first text stood; opaque pieces stay."""
    new = F.filter(replacement, lambda p: p["text"] != "")

    def put(placed: Column, ab: Column) -> Column:
        a, b = ab["a"], ab["b"]
        gone = lambda x: (x["p"]["kind"] == "text") & (x["s"] >= a) & (x["e"] <= b) & (x["s"] < b) & (x["e"] > a)

        def at(first: Column) -> Column:
            bare = _bare(placed)
            kept = F.concat(F.slice(bare, F.lit(1), first - 1), new, _bare(F.filter(F.slice(placed, first, F.size(placed)), lambda x: ~gone(x))))
            inserted = let(_index(placed, a), lambda k: F.concat(F.slice(bare, F.lit(1), k), new, F.slice(bare, k + 1, F.size(bare))))
            return F.when(first > 0, kept).otherwise(inserted)

        return let(F.array_position(F.transform(placed, gone), True), at)

    a, b = _int(start), _int(end)
    return let(_cut(_placed(col(pieces)), a, b), lambda placed: let(F.struct(a.alias("a"), b.alias("b")), lambda ab: put(placed, ab)))


def paragraph_xml(pieces: Column | str) -> Column:
    """Word mark-up of the pieces: runs with formatting for texts, opaque elements as they were; empty texts are left out."""
    esc = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def one(p: Column) -> Column:
        keep = F.when(p["text"].rlike(r"^\s|\s$"), F.lit(' xml:space="preserve"')).otherwise("")
        run = F.concat(F.lit("<w:r>"), F.coalesce(p["rpr"], F.lit("")), F.lit("<w:t"), keep, F.lit(">"), esc(p["text"]), F.lit("</w:t></w:r>"))
        return F.when(p["kind"] == "text", F.when(p["text"] != "", run).otherwise("")).otherwise(F.coalesce(p["element"], F.lit("")))

    return F.array_join(F.transform(col(pieces), one), "")
