"""Problem 4: sentence units across languages and scripts.

A generator proposes candidate boundaries (end marks of any script with the closers
behind them, line ends, spaces in scripts that write no end marks). A maximum-entropy
classifier decides each from features of its surroundings: the token before and how often
that token ends an item or is followed by a small letter, case, length, digits,
script, the next token, and for a line end whether the next word would have
fitted. The model is trained on reliable boundaries of the same kind of text
(``train_sentences.py``) and stored as JSON beside this module.

Units tile the text except for white space. A label ("12.", "a)", "§ 3.",
"Art. 7.") belongs to the unit it introduces; closing quotes, brackets and emoji
belong to the unit before. Null and blank texts have no units.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import KEY, add_column, not_blank, once_texts

MODEL = Path(__file__).with_name("models") / "sentence_maxent.json"
MEMO_LIMIT = 300_000

_INVISIBLE = "\u00ad\u034f\u200b\u200c\u2060\ufeff"
_CLOSERS = "\"'”’»›)\\]}」』）】》〉＂“"
_EMOJI = "\U0001F000-\U0001FAFF☀-\u27bf\ufe0f\u200d\U0001F3FB-\U0001F3FF⭐✅"
#: Scripts that set clauses off by spaces: Thai, Lao, Khmer.
_THAI = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ebd\u0ec0-\u0ecd\u1780-\u17d3"
#: An end mark with the closers behind it, or a line end. One character class leads, so that the scan is fast.
CANDIDATE = re.compile(rf"([.!?…।॥؟؛;。！？｡\n։۔።፧။។៕།])[.!?…。！？]*[{_INVISIBLE}]*(?:[{_CLOSERS}]+|[ \u00a0\u202f][»”](?!\w))*")
GREEK = re.compile("[Ͱ-Ͽ]")
THAI = re.compile(f"[{_THAI}]")
#: A space before Thai, as a boundary of clauses.
THAI_CANDIDATE = re.compile(rf"\n|[.!?…។៕]+(?=\s)|(?<=[{_THAI}0-9A-Za-z])[^\S\n]+(?=[{_THAI}])")
_EMOJI_RUN = re.compile(rf"(?:[^\S\n]*[{_EMOJI}]+)+")
_SPACE = re.compile(r"\s+")
_INVISIBLE_RUN = re.compile(f"[{_INVISIBLE}\u200d]+")
_TOKEN = re.compile(r"[^\s(\[{„“«\"]+$")
_NEXT = re.compile(r"[\s]*([\"'“„«‹(\[{¡¿「『（‘]*)\s?(\S*)")
LABEL = re.compile(
    r"(?:[-•–—*·]\s*)?(?:[(\[（]?\d{1,4}[.)\]）]|[(\[]?[A-Za-zЀ-ӿͰ-Ͽ]{1,2}[.)]|§§?\s*\d+[a-z]?[.)]?"
    r"|\w{2,9}\.?\s*\d{1,4}[a-z]?[.):]|\w{2,9}\.)\s*$"
)
BULLET = re.compile(r"\s*(?:[-•–—*·▪◦]\s|[(\[（]?\d{1,4}[.)\]）]\s|[a-zA-Z]\)\s|§\s?\d|#+ )")
_ORDINAL_BEFORE = re.compile(r"(?:^|[\s(])(?:der|die|das|dem|den|des|am|vom|zum|im|bis|ab|seit|und|the|le|el)\s+\d{1,2}$", re.I)


@lru_cache(1)
def model() -> dict:
    if not MODEL.exists():
        return {"lex": {}, "w": {}, "units": frozenset()}
    got = json.loads(MODEL.read_text())
    return got | {"units": frozenset(got.get("units", ()))}


def shape(word: str) -> str:
    """Class of a word by its first character: U, l, d, c (no case), o (other) or e (none)."""
    if not word:
        return "e"
    c = word[0]
    if c.isdigit():
        return "d"
    if c.isupper() or c.istitle():
        return "U"
    if c.islower():
        return "l"
    return "c" if c.isalpha() else "-" if c in "-–—" else "," if c in ",;:.!?)" else "o"


def token_key(token: str) -> str:
    """A token's form in the lexicon: digits folded, case kept for one letter only."""
    t = re.sub(r"\d", "0", token.strip(_INVISIBLE + "(\"'„“«["))
    return t if len(t) == 1 else t.lower()


def mark_features(token: str, mark: str, nxt_open: bool, nxt: str, ordinal: bool, lex: dict) -> list[str]:
    """Features of an end mark followed by white space."""
    n, last = shape(nxt), mark[0]
    key = token_key(token)
    dots = mark.count(".")
    kind = "ell" if dots > 1 or "…" in mark else "." if last == "." else ";" if last in ";؛" else "end"
    closed = any(c in "\"'”’»›)]}“」』" for c in mark)
    final, lower, number, seen = lex.get(key, (-1, -1, -1, 0))
    bare = token.strip(_INVISIBLE)
    tok = "0" if not bare else f"d{min(len(bare), 4)}" if bare.isdigit() else "X" if len(bare) == 1 and bare.isupper() else "x" if len(bare) == 1 else "i" if "." in bare else f"w{min(len(bare), 5)}"
    case = "U" if bare[:1].isupper() else "l"
    out = ["b", f"k={kind}", f"n={n}", f"k={kind}|n={n}", f"k={kind}|c={closed}|n={n}"]
    if kind == ".":
        rare = seen < 3
        out += [f"t={tok}{case}|n={n}", f"f={final}|n={n}", f"lo={lower}|n={n}", f"f={final}|lo={lower}|n={n}", f"nu={number}|n={n}", f"r={rare}|t={tok}{case}|n={n}", f"ord={ordinal}|t={tok}|n={n}"]
    if nxt_open:
        out.append(f"o={n}|k={kind}")
    return out


def line_features(fits: bool, wide: bool, short: bool, comma: bool, n: str, bullet: bool) -> list[str]:
    """Features of a line end that may be mere layout: whether the next line's first word ``fits`` behind it,
    lines too ``wide`` to be wrapped, a ``short`` line, a ``comma`` at its end, the next word's shape, a ``bullet`` before it."""
    return ["L", f"L fit={fits}|w={wide}", f"L n={n}|w={wide}", f"L c={comma}|w={wide}", f"L fit={fits}|n={n}|w={wide}", f"L short={short}|w={wide}|n={n}", f"L bul={bullet}"]


def line_key(line: str, after: str, word: str, width: int) -> tuple:
    """The arguments of ``line_features`` for a line end."""
    width = max(width, 62)
    return len(line) + 1 + len(word) <= width, width > 112, len(line) < 0.6 * width, line.rstrip()[-1:] in (",", "-", "–", "(", "„"), shape(word), bool(BULLET.match(after))


def han_features(nxt: str, closed: bool, opened: bool) -> list[str]:
    """Features of an end mark of Chinese or Japanese: what follows, whether a quotation closes with it, and whether that opened the unit."""
    n = "e" if not nxt or nxt.isspace() else "," if nxt in "、，" else "p" if nxt in "とっ" else "a" if nxt.isalpha() else "o"
    return ["C", f"C n={n}", f"C n={n}|q={closed}", f"C n={n}|q={closed}|o={opened}"]


def space_features(before: str, after: str, unit: bool, size: int) -> list[str]:
    """Features of a space in a script without end marks: the characters beside it, whether a word for what is counted follows a
    number, and the length of the unit so far."""
    kind = lambda c: "d" if c.isdigit() else "l" if c.isascii() else "t"
    p = kind(before)
    return ["T", f"T p={p}|n={kind(after)}", f"T u={unit}", f"T p={p}|s={min(size // 4, 4)}"]


def row_end_features(n: str, bullet: bool, blank: bool) -> list[str]:
    """Features of a line end where lines aren't wrapped."""
    return ["S", f"S n={n}", f"S bul={bullet}", f"S blank={blank}"]


def score(features: list[str], w: dict) -> float:
    return sum(w.get(f, 0.0) for f in features)


def line_width(lines: list[str]) -> int:
    """Length of the longest line of ordinary words (a long code or address doesn't wrap)."""
    return max((len(x) for x in lines if len(x) < 16 * (x.count(" ") + 1)), default=0)


def _opened_at_start(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens the unit, so that what follows its end says who speaks."""
    at = max(text.rfind(q, start, end) for q in "「『“\"‘")
    return at >= start and (not (head := text[start:at].strip()) or LABEL.fullmatch(head) is not None)


def unit_starts(text: str, layout: bool, memo: dict | None = None) -> list[int]:
    """Offsets of the first character of each unit. ``layout``: line ends may be mere layout (PDF pages)."""
    m = model()
    lex, w, units = m["lex"], m["w"], m.get("units", ())
    memo = {} if memo is None else memo
    size = len(text)
    at = size - len(text.lstrip())
    if at == size:
        return []
    start, starts = at, [at]
    lines = None
    greek = not text.isascii() and GREEK.search(text) is not None
    thai = not text.isascii() and THAI.search(text) is not None
    for c in (THAI_CANDIDATE if thai else CANDIDATE).finditer(text, at):
        begin, end = c.span()
        first = text[begin]
        if first == "\n":
            if begin < start:
                continue
            if layout:
                if lines is None:
                    lines = text.split("\n")
                    width = line_width(lines)
                k = text.count("\n", 0, begin)
                line, after = lines[k], lines[k + 1]
                word = after.split(None, 1)[0] if after and not after.isspace() else ""
                if word and line:
                    key = line_key(line, after, word, width)
                    yes = memo.get(key)
                    if yes is None:
                        yes = memo[key] = score(line_features(*key), w) > 0
                    if not yes:
                        continue
            else:
                key = ("S", shape(text[end : end + 1]), text[end : end + 1] in "-•–—*·▪◦#§" or text[end : end + 1].isdigit(), text[end : end + 1] == "\n")
                yes = memo.get(key)
                if yes is None:
                    yes = memo[key] = score(row_end_features(*key[1:]), w) > 0
                if not yes:
                    continue
        elif first.isspace():
            if begin - start < 14 and LABEL.fullmatch(text[start:begin]):
                continue
            before = text[begin - 1]
            key = ("T", before.isdigit(), before.isascii(), before.isdigit() and text[end : end + 3] in units, min((begin - start) // 4, 4))
            yes = memo.get(key)
            if yes is None:
                yes = memo[key] = score(space_features(before, text[end], key[3], begin - start), w) > 0
            if not yes:
                continue
        elif first in "。！？｡":
            if text[end - 1] == "“":  # opens what follows in these scripts
                end -= 1
            nxt = text[end : end + 1]
            closed = text[end - 1] in "」』”’\""
            key = ("C", nxt, closed, closed and nxt.isalpha() and _opened_at_start(text, start, begin))
            yes = memo.get(key)
            if yes is None:
                yes = memo[key] = score(han_features(*key[1:]), w) > 0
            if not yes:
                continue
        else:
            if end < size and not text[end].isspace():
                if text[end] < "\u2000" or not (e := _EMOJI_RUN.match(text, end)):
                    continue
                end = e.end()
            elif end + 1 < size and text[end + 1] > "\u2000" and (e := _EMOJI_RUN.match(text, end)):
                end = e.end()
            if first in ";؛" and (first == "؛" or not greek or not "Ͱ" <= text[begin - 1 : begin] <= "Ͽ"):
                continue
            rest = sp.end() if (sp := _SPACE.match(text, end)) else end
            if rest == size:
                break
            nxt = text[rest]
            if not layout and "\n" in text[end:rest]:
                continue  # the line end decides
            opens = nxt in "\"'“„«‹([{¡¿「『（‘"
            if opens:
                nx = _NEXT.match(text, rest, min(size, rest + 12))
                nxt = nx.group(2)[:1]
            if begin - start <= 18 and LABEL.fullmatch(_INVISIBLE_RUN.sub("", text[start : begin + 1])):
                continue
            low = max(start, begin - 24)
            token = text[max(low, text.rfind(" ", low, begin) + 1) : begin]
            if not token.isalpha():
                token = t.group() if (t := _TOKEN.search(token)) else ""
            ordinal = len(token) <= 2 and token.isdigit() and _ORDINAL_BEFORE.search(text[max(0, begin - 12) : begin]) is not None
            key = (token, text[begin:end], opens, nxt, ordinal)
            yes = memo.get(key)
            if yes is None:
                if len(memo) > MEMO_LIMIT:
                    memo.clear()
                yes = memo[key] = score(mark_features(token, c.group(), opens, nxt, ordinal, lex), w) > 0
            if not yes:
                continue
            end = rest
        if end < size and text[end].isspace():
            end = _SPACE.match(text, end).end()
        if end >= size:
            break
        if end > start:
            start = end
            starts.append(start)
    return starts


def sentence_starts(df: DataFrame, text: str = "text", src: str = "src") -> DataFrame:
    """Rows of ``df`` with ``starts array<int>`` in place of the text; blank texts are left out."""
    layout = df.filter((F.col(src) == "pdf_page") & not_blank(text))
    plain = df.filter((F.col(src) != "pdf_page") & not_blank(text))
    parts = []
    for part, wraps in ((plain, False), (layout, True)):

        def starts(texts, wraps=wraps, memo={}):  # noqa: B006
            return pa.array([unit_starts(t, wraps, memo) for t in texts], pa.list_(pa.int32()))

        parts.append(add_column(part, "starts", "array<int>", starts, text))
    return parts[0].unionByName(parts[1])


def sentence_units(df: DataFrame, text: str = "text", src: str = "src") -> DataFrame:
    """Rows ``(src, doc_id, id, unit_no, start_off, end_off, unit)``, one for each unit of an item."""
    layout_col = F.col(src) == "pdf_page"
    kept = once_texts(df.filter(not_blank(text)))
    parts = []
    for part, wraps in ((kept.filter(~layout_col), False), (kept.filter(layout_col), True)):

        def units(texts, wraps=wraps, memo={}):  # noqa: B006
            out = []
            for t in texts:
                s = unit_starts(t, wraps, memo)
                ends = [*s[1:], len(t)]
                out.append([{"start_off": a, "end_off": a + len(t[a:b].rstrip()), "unit": t[a:b].rstrip()} for a, b in zip(s, ends)])
            return pa.array(out, pa.list_(pa.struct([("start_off", pa.int32()), ("end_off", pa.int32()), ("unit", pa.string())])))

        parts.append(add_column(part, "units", "array<struct<start_off:int,end_off:int,unit:string>>", units, text))
    both = parts[0].unionByName(parts[1])
    return both.select(*KEY, F.posexplode("units").alias("unit_no", "u")).select(*KEY, "unit_no", "u.start_off", "u.end_off", "u.unit")
