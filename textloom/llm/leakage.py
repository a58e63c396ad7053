"""Problem 6: evaluation passages inside training text.

The word n-grams of every distinct passage, those of words in a row and those
with the third word left out, form a hash index, which is a few entries for each
word of a fixed table and is broadcast in blocks of at most ``BLOCK`` words. Training texts are scanned window by window against it; a text
with enough hits is verified by the longest common word sequence near the hits.
A passage leaks if at least half of its words occur there in their order.

Case, punctuation, mark-up, layout, invisible characters and compatibility forms
of letters do not count. Null or empty texts hold nothing; a passage of fewer
than ``N`` words is never searched (it is a name or a short quotation).
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import add_column
from textloom.session import bounded_rows

N = 3
SHARE = 0.5
#: Passage words that the hits must cover before a text is verified.
LEAST_HITS = 0.15
BLOCK = 1_000_000
ITEM_LIMIT = 200_000
#: A word; invisible characters (as NUL) and a hyphen at a line end do not part it.
_WORD = re.compile(r"[^\W_]+(?:(?:\0+|-\r?\n)[^\W_]+)*")
_INSIDE = re.compile(r"\0+|-\r?\n")
_MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>|&(?:#\d{1,6}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,8});|[\u00ad\u034f\u200b\u200c\u200d\u2060\ufeff]")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words and their spans in the text."""
    flat = text
    if "<" in text or "&" in text or not text.isascii():
        flat = _MARKUP.sub(lambda m: "\0" if len(m.group()) == 1 else (u if len(u := html.unescape(m.group())) == 1 and u.isalpha() else " ").ljust(len(m.group())), text)
    out, spans = [], []
    for m in _WORD.finditer(flat):
        w = m.group()
        if "\0" in w or "\n" in w:
            w = _INSIDE.sub("", w)
        out.append(w.lower() if w.isascii() else unicodedata.normalize("NFKC", w).lower())
        spans.append(m.span())
    return out, spans


class Passages:
    """Hash index of the n-grams of distinct passages."""

    def __init__(self, rows: list[tuple[int, str]]):
        same: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, passage in rows:
            w = tuple(words(passage or "")[0])
            if len(w) >= N:
                same[w].append(item)
        self.words = list(same)
        self.items = list(same.values())
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            for i, g in self.grams(w):
                self.index[g].append((k, i))
        self.index = dict(self.index)

    @staticmethod
    def grams(w):
        """``(place, n-gram)``: words in a row, and with the third one left out, so that a changed, added or missing word
        in every three leaves some n-grams alike."""
        yield from enumerate(map(" ".join, zip(*(w[i:] for i in range(N)))))
        yield from enumerate(map(" ".join, zip(w, w[1:], w[3:])))

    def scan(self, text: str | None) -> list[dict]:
        """Leaked passages of a text: their items, the share of their words, and the span of the text."""
        if not text:
            return []
        w, spans = words(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        get = self.index.get
        for j, g in self.grams(w):
            if found := get(g):
                for k, i in found:
                    hits[k].append((j, i))
        out = []
        for k, h in hits.items():
            while h and (got := self._leak(self.words[k], w, h)):
                share, first, last, used = got
                out.append({"items": self.items[k], "share": share, "start_off": spans[first][0], "end_off": spans[last][1]})
                h = [x for x in h if not used[0] <= x[0] <= used[1]]  # the text may hold the passage again
        return out

    def _leak(self, p: tuple[str, ...], w: list[str], h: list[tuple[int, int]]):
        """One copy of a passage: its share, its first and last word, and the range of its hits; None if there is none."""
        if len({i for _, i in h}) + N - 1 < LEAST_HITS * len(p):
            return None
        chain = self._chain(h)
        if len(chain) + N - 1 < LEAST_HITS * len(p):
            return None
        lo, hi = max(0, chain[0][0] - len(p)), chain[-1][0] + N + len(p)
        share = len(self._common(p, w[lo:hi])) / len(p)
        if share < SHARE:
            return None
        # a chain may begin in one copy and end in another: the part with the most hits, if it is a case by itself
        parts = [[chain[0]]]
        for x, y in zip(chain, chain[1:]):
            if y[0] - x[0] - (y[1] - x[1]) > len(p) // 2:
                parts.append([])
            parts[-1].append(y)
        for part in [max(parts, key=len), chain]:
            (j0, i0), (j1, i1) = part[0], part[-1]
            lo, hi = max(0, j0 - i0 - 2), j1 + len(p) - i1 + 2
            near = w[lo:hi]
            most = len(self._common(p, near))
            if most >= SHARE * len(p):
                share = most / len(p)
                break
        else:
            return share, j0, j1 + N - 1, (j0, j1)
        # the shortest stretch with as many common words: its end from the front, its start from the back
        end = self._reach(p, near, most)
        start = end - self._reach(p[::-1], near[:end][::-1], most)
        first, last = min(lo + start, j0), max(lo + end - 1, j1 + N - 1)
        return share, first, last, (first, last)

    @classmethod
    def _reach(cls, p: tuple[str, ...], w: list[str], most: int) -> int:
        """How many words are needed for so many common words."""
        a, b = 0, len(w)
        while a < b:
            c = (a + b) // 2
            if len(cls._common(p, w[:c])) >= most:
                b = c
            else:
                a = c + 1
        return a

    @staticmethod
    def _chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The longest run of hits that rises in the text and in the passage."""
        hits = sorted(hits, key=lambda x: (x[0], -x[1]))
        tails, ends, back = [], [], []
        for n, (_, i) in enumerate(hits):
            q = bisect.bisect_left(tails, i)
            if q == len(tails):
                tails.append(i)
                ends.append(n)
            else:
                tails[q], ends[q] = i, n
            back.append(ends[q - 1] if q else -1)
        out, n = [], ends[-1]
        while n >= 0:
            out.append(hits[n])
            n = back[n]
        return out[::-1]

    @staticmethod
    def _common(p: tuple[str, ...], w: list[str]) -> list[int]:
        """As many positions as the longest common subsequence has words, by bit-parallel dynamic programming."""
        mask: dict[str, int] = defaultdict(int)
        for i, x in enumerate(p):
            mask[x] |= 1 << i
        full = (1 << len(p)) - 1
        v = full
        for x in w:
            if m := mask.get(x):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return [i for i in range(len(p)) if not v >> i & 1]


_TYPE = pa.list_(pa.struct([("items", pa.list_(pa.int64())), ("share", pa.float64()), ("start_off", pa.int32()), ("end_off", pa.int32())]))
DDL = "array<struct<items:array<bigint>,share:double,start_off:int,end_off:int>>"


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows of ``docs`` that hold a passage of ``items (item_id, passage)``, with ``leaks``.

    The items are a fixed table (at most ``ITEM_LIMIT``); every block of them is held against all rows.
    """
    rows = [(r.item_id, r.passage) for r in bounded_rows(items.select("item_id", "passage").filter("item_id IS NOT NULL AND passage IS NOT NULL"), ITEM_LIMIT, "evaluation items")]
    rows.sort()
    out, blocks, size = None, [[]], 0
    for r in rows:
        size += len(r[1]) // 2 + 1  # words at most
        if size > BLOCK and blocks[-1]:
            blocks.append([])
            size = len(r[1]) // 2 + 1
        blocks[-1].append(r)
    for block in blocks:
        index = docs.sparkSession.sparkContext.broadcast(Passages(block))
        scan = lambda texts, index=index: pa.array([index.value.scan(t) for t in texts], _TYPE)
        one = add_column(docs, "leaks", DDL, scan, text, keep_text).filter(F.size("leaks") > 0)
        out = one if out is None else out.unionByName(one)
    return out


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct ``(doc_id, item_id)`` of leaks; items that share a passage all count."""
    got = leaks(docs.select(doc_id, text), items, text)
    return got.select(doc_id, F.explode("leaks").alias("x")).select(doc_id, F.explode("x.items").alias("item_id")).distinct()


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Affected documents with the leaked spans cut out: ``(doc_id, text, removed)``."""
    got = leaks(docs.select(doc_id, text), items, text, keep_text=True)
    got = got.select(doc_id, text, F.explode("leaks").alias("x")).select(doc_id, text, "x.start_off", "x.end_off")
    spans = got.groupBy(doc_id).agg(F.first(text).alias(text), F.array_sort(F.collect_set(F.struct("start_off", "end_off"))).alias("spans"))
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s.end_off <= acc["at"], acc).otherwise(
            F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.greatest(F.lit(0), s.start_off - acc["at"]))).alias("out"), s.end_off.alias("at"))
        ),
    )
    return spans.withColumn("c", cut).select(doc_id, F.concat("c.out", F.expr(f"substring({text}, c.at + 1)")).alias(text), F.size("spans").alias("removed"))
