"""Problem 5: text decoded with the wrong character set.

Best-first graph search: a state is a text, an edge re-encodes it with the
character set it was wrongly read in and decodes the bytes with another one (or
resolves character references). Visited states are kept by hash; the priority
of a state is a plausibility cost, the bits that a character-bigram model needs
for its words with non-ASCII letters. The search ends when the cheapest state
left is an ordinary text, or when none is left within ``BOUND`` of the cheapest one
seen of its kind: a bound of cost, the same at every size, and no count of states or
steps. The graph is finite: decoding UTF-8 or a reference shortens the text, and a way has one change at
most of one national set for another (two in a row make one; two with UTF-8 between
them, a text misread three times, aren't looked for). A result must be ordinary text, or come from UTF-8, whose form vouches for
it, and save more than ``MARGIN`` bits. The bigram model is trained on clean text
(``train_encoding.py``) and stored beside this module.

Damage may be partial: lines are repaired on their own, the way found for all
suspect lines of a document first. U+FFFD marks a lost character; such a text is
affected, but only what is still there can be restored. Null texts and texts
without suspect characters come back unchanged; so do references that are the only
peculiarity of a text, as mark-up has them.
"""

from __future__ import annotations

import heapq
import html
import json
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import add_column

MODEL = Path(__file__).with_name("models") / "char_bigrams.json"
MARGIN = 7.0
#: States that cost so many bits more than the cheapest one seen of their kind, or so large a share more, aren't followed. One kind
#: are the ways through UTF-8 and references only, the other those with a change of national sets.
BOUND, BOUND_SHARE = 21.0, 0.05
#: Shares of what the damaged text costs that a restored one may cost at most: an ordinary text behind a change of national sets,
#: one from UTF-8 that is not ordinary yet, and one behind such a change that isn't.
NATIONAL, VOUCHED, DOUBTFUL = 0.75, 0.7, 0.5
#: Bits of a bigram that is out of the ordinary.
SUSPECT = 11.2
#: Character sets that text is wrongly read in, and that it really was in.
READ_AS = ("latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "mac-roman", "cp437", "cp850", "cp852", "koi8-r", "cp866", "cp1253", "cp1254", "cp1257")
WAS = ("cp1250", "cp1252", "iso8859-2", "mac-roman", "cp1251", "cp437", "cp850", "cp852", "koi8-r", "cp866", "cp1253", "cp1254", "cp1257")
#: Character sets of East Asia, whose characters have two bytes each, and what their bytes are usually read in.
DOUBLE, DOUBLE_READ_AS = ("cp932", "gbk", "big5", "cp949", "euc_jp"), ("latin-1", "cp1252")
#: Letters of western and northern European alphabets, plausible between letters of the same case.
_LETTERS = "áàâäãåæçðéèêëíìîïñóòôöõøœúùûüýÿþß"
#: Letters of central European, Baltic and Turkish alphabets, a little less so.
_MORE_LETTERS = frozenset("āăąćĉċčďđēėęěğġģħīįıķĺļľłńņňőŕřśşšţťūůűųźżžșț" + "ĀĂĄĆĈĊČĎĐĒĖĘĚĞĠĢĦĪĮİĶĹĻĽŁŃŅŇŐŔŘŚŞŠŢŤŪŮŰŲŹŻŽȘȚ")
_SIGN_GROUP = {c: g for g, cs in {"’": "’‘", "“": "“„«‹‘‚¡¿", "”": "”“»›’", "–": "–—―", "€": "€£¥", "±": "±×÷§¶©®™°•·←→✓★", "│": "".join(map(chr, range(0x2500, 0x2580)))}.items() for c in cs}
MEMO_LIMIT = 400_000
#: A word; the sign of a lost no-break space goes on in the next one.
_TOKEN = re.compile(r"(?:Ã |[^ \n\t])+")
_UTF8_RUN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_REFERENCE = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,8});")


@lru_cache(None)
def decoder(name: str) -> str:
    """The 256 characters of a character set; an undefined byte is the control of the same number, as lenient readers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(None)
def encoder(name: str) -> dict[str, int]:
    back = {chr(b): b for b in range(0x80, 0xA0)} if name != "latin-1" else {}
    back |= {c: b for b, c in enumerate(decoder(name))}
    return back


@lru_cache(None)
def redecode_table(read_as: str, was: str) -> dict[int, str]:
    d = decoder(was)
    return {ord(c): d[b] for c, b in encoder(read_as).items() if b >= 0x80 and d[b] != c}


Mapped = tuple[str, list[int]]


def from_utf8(text: str, read_as: str) -> Mapped:
    """Decode every run of characters that are the bytes of UTF-8 read in ``read_as``; the rest stays. With the source of each character."""
    enc = encoder(read_as)
    out: list[str] = []
    src: list[int] = []
    run: list[int] = []  # places of characters that may be bytes

    def flush() -> None:
        raw = bytes(enc[text[k]] for k in run)
        at = 0
        for m in _UTF8_RUN.finditer(raw):
            try:
                new = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            for k in run[at : m.start()]:
                out.append(text[k])
                src.append(k)
            k = m.start()
            for c in new:
                out.append(c)
                src.append(run[k])
                k += len(c.encode("utf-8"))
            at = m.end()
        for k in run[at:]:
            out.append(text[k])
            src.append(k)
        run.clear()

    for k, c in enumerate(text):
        if c >= "\x80" and c in enc:
            run.append(k)
        else:
            if run:
                flush()
            out.append(c)
            src.append(k)
    if run:
        flush()
    return "".join(out), src


def from_double(text: str, read_as: str, was: str) -> Mapped | None:
    """The text whose bytes, read in ``read_as``, are of a set of two-byte characters; None if they aren't all of it."""
    enc = encoder(read_as)
    try:
        raw = bytes(ord(c) if c < "\x80" else enc[c] for c in text)
        new = raw.decode(was)
    except (KeyError, UnicodeDecodeError):
        return None
    src, k = [], 0
    for c in new:
        src.append(k)
        k += len(c.encode(was))
    return (new, src) if k == len(raw) else None


def _unescaped(text: str) -> Mapped:
    out, src, at = [], [], 0
    for m in _REFERENCE.finditer(text):
        new = html.unescape(m.group())
        out += [text[at : m.start()], new]
        src += [*range(at, m.start()), *[m.start()] * len(new)]
        at = m.end()
    return "".join([*out, text[at:]]), [*src, *range(at, len(text))]


#: Every step, by its name: how texts change by it, and whether it is a change of one single-byte set for another.
LOST = "utf-8 read as latin-1, no-break spaces lost"
UTF8_STEPS = {r: f"utf-8 read as {r}" for r in READ_AS}
SINGLE_STEPS = {r: [f"{w} read as {r}" for w in WAS if w != r] for r in READ_AS}
DOUBLE_STEPS = {r: [f"{w} read as {r}" for w in DOUBLE] for r in DOUBLE_READ_AS}
_SINGLE = frozenset(x for xs in SINGLE_STEPS.values() for x in xs)
_DOUBLES = frozenset(x for xs in DOUBLE_STEPS.values() for x in xs)


def mapped_step(text: str, step: str) -> Mapped | None:
    """A text after a step, and the source of each of its characters."""
    if step == "references":
        return _unescaped(text)
    if step == LOST:
        return from_utf8(text.replace("Ã ", "Ã\xa0"), "cp1252")
    was, read_as = step.split(" read as ")
    if was == "utf-8":
        return from_utf8(text, read_as)
    if was in DOUBLE:
        return from_double(text, read_as, was)
    return text.translate(redecode_table(read_as, was)), list(range(len(text)))


@lru_cache(MEMO_LIMIT)
def token_step(token: str, step: str) -> str | None:
    """A token after a step. Texts repeat their words, so most are looked up."""
    if step in _SINGLE:
        was, read_as = step.split(" read as ")
        return token.translate(redecode_table(read_as, was))
    got = mapped_step(token, step)
    return got[0] if got else None


def steps_from(tokens: tuple[str, ...], changed: bool) -> list[str]:
    """The steps that can lead on from a state; ``changed``: one national set has been changed for another already."""
    odd = {c for t in tokens for c in t if c > "\x7f"}
    # what was read in a set consists of its characters, some words that were read rightly aside
    fitting = [r for r in READ_AS if 2 * len(odd & encoder(r).keys()) >= len(odd)] if odd else []
    out = [UTF8_STEPS[r] for r in fitting]
    if any("Ã " in t for t in tokens):
        out.append(LOST)
    if any("&" in t and _REFERENCE.search(t) for t in tokens):
        out.append("references")
    if not changed:
        for r in fitting:
            out += SINGLE_STEPS[r]
            if r in DOUBLE_STEPS and len(odd & encoder(r).keys()) == len(odd):
                out += DOUBLE_STEPS[r]
    return out


@lru_cache(200_000)
def symbol(c: str) -> str:
    """A character in the bigram model: large scripts are one symbol each, digits and ASCII letters fold."""
    o = ord(c)
    if o < 0x80:
        return " " if c.isspace() else "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
    if 0x80 <= o < 0xA0:
        return "CTL"
    for lo, hi, name in ((0x0600, 0x06FF, "ARAB"), (0x0900, 0x097F, "DEVA"), (0x0E00, 0x0E7F, "THAI"), (0x3040, 0x30FF, "KANA"), (0x3400, 0x9FFF, "HANI"), (0xAC00, 0xD7AF, "HANG"), (0x1F000, 0x1FAFF, "EMO"), (0xE000, 0xF8FF, "PRIV"), (0xFF00, 0xFF60, "FULL"), (0x3000, 0x303F, "CJKP")):
        if lo <= o <= hi:
            return name
    return c


@lru_cache(200_000)
def kind(s: str) -> str:
    """Back-off class of a symbol."""
    if len(s) > 1:
        return s
    name = unicodedata.name(s, "?").split()[0]
    cat = unicodedata.category(s)
    return f"{name}{cat}" if cat[0] == "L" else cat


def _class(c: str) -> str:
    """Coarse class of a neighbour in the prior: a, A (letter by case), 0, space, p (ASCII punctuation) or the character."""
    if c.isascii():
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "p"
    return "a" if c in _LETTERS else "A" if c in _LETTERS_UP else ("a" if c.islower() else "A") if c in _MORE_LETTERS else c


@lru_cache(None)
def _common_han() -> frozenset[str]:
    """The characters of the first levels of the East Asian sets, which hold what is in common use."""
    rows = ((0xB0, 0xD7, "gb2312"), (0xB0, 0xCF, "euc_jp"))
    out = {c for lo, hi, codec in rows for a in range(lo, hi + 1) for b in range(0xA1, 0xFF) if (c := bytes([a, b]).decode(codec, "ignore"))}
    return frozenset(out | {c for a in range(0xA4, 0xC7) for b in [*range(0x40, 0x7F), *range(0xA1, 0xFF)] if (c := bytes([a, b]).decode("big5", "ignore"))})


#: Bits of which character of a large script it is, which the bigrams leave out: in common use, and else.
COMMON, RARE = 8.0, 16.0
_KANA = 4.0
_LETTERS_UP = _LETTERS.replace("ß", "").replace("ÿ", "").upper()


def prior(a: str, b: str) -> float:
    """Bits of a bigram that is ordinary in clean text of any European language: signs in their usual places and
    letters beside letters of the same case. Infinite where there is no such use."""
    if a in _MORE_LETTERS and (b.isalpha() or b in " .,-") and b < "\u0250" or b in _MORE_LETTERS and (a.isalpha() or a == " ") and a < "\u0250":
        return 12.0 if not (a.islower() and b.isupper()) else math.inf
    ka, kb = _class(a), _class(b)
    if ka in "aA" and kb in "aA" or " " in (ka, kb) and (ka in "aA" or kb in "aA") or "p" in (ka, kb) and (ka in "aA" or kb in "aA"):
        return 11.0 if (ka, kb) != ("a", "A") and (kb == "A" or ka != "A" or a.isascii()) else math.inf
    word, free = "aA0", " p"
    for x, y, left in ((a, kb, True), (b, ka, False)):  # x: the sign; y: its neighbour, behind it if left
        g = _SIGN_GROUP.get(x)
        if g is None:
            continue
        if x in "’‘" and y in word or x in "“„«‹‘‚¡¿" and (y in (word if left else free) or y in "¡¿") or x in "”“»›’" and y in ("p " if left else "aA0p"):
            return 7.0
        if g == "–" and y in " 0" or g == "€" and y in " 0p" or g == "±" and y in " 0p" or g == "│" and (y == " " or y in _SIGN_GROUP and _SIGN_GROUP[y] == "│"):
            return 6.0
        other = a if not left else b
        if other in "’‘“”„«»‘‚" and g in "€–" or x in "”’" and other in _LETTERS and not left:
            return 7.0
    return math.inf


class Plausibility:
    """Bits that bigrams of symbols need, interpolated with bigrams of their classes."""

    def __init__(self, counts: dict[str, int]):
        self.pair: dict[tuple[str, str], int] = {}
        self.one: dict[str, int] = {}
        self.kpair: dict[tuple[str, str], int] = {}
        self.kone: dict[str, int] = {}
        self.size: dict[str, int] = {}
        seen: set[str] = set()
        for key, n in counts.items():
            a, b = key.split("\t")
            self.pair[a, b] = n
            self.one[a] = self.one.get(a, 0) + n
            ka, kb = kind(a), kind(b)
            self.kpair[ka, kb] = self.kpair.get((ka, kb), 0) + n
            self.kone[ka] = self.kone.get(ka, 0) + n
            seen |= {a, b}
        for s in seen:
            self.size[kind(s)] = self.size.get(kind(s), 0) + 1
        self.seen = seen
        self.memo: dict[str, float] = {}
        self.odd: dict[str, tuple[float, bool]] = {}

    def bits(self, two: str) -> float:
        got = self.memo.get(two)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            a, b = symbol(two[0]), symbol(two[1])
            ka, kb = kind(a), kind(b)
            klass = (self.kpair.get((ka, kb), 0) + 0.02) / (self.kone.get(ka, 0) + 5)
            inside = 1 / self.size.get(kb, 1) if b in self.seen else 0.02 / (self.size.get(kb, 1) + 20)
            n = self.one.get(a, 0)
            lam = n / (n + 20)
            p = lam * self.pair.get((a, b), 0) / n if n else 0.0
            got = self.memo[two] = min(prior(*two), -math.log2(p + (1 - lam) * klass * inside + 0.05 * klass * inside + 1e-7))
            if b in ("HANI", "HANG", "KANA"):
                got += _KANA if b == "KANA" else COMMON if b == "HANG" or two[1] in _common_han() else RARE
                self.memo[two] = got
            if b == "�" or a == "�":
                got = self.memo[two] = 24.0
        return got

    def word(self, word: str, budget: float = math.inf) -> tuple[float, bool]:
        """Bits of a token with non-ASCII characters, and whether it is out of the ordinary: a bigram that is rare in clean
        text, or mostly accented Latin letters, as those of another alphabet read in a western set are. Beyond the budget bits are no longer added up."""
        got = self.odd.get(word)
        if got is None:
            if len(self.odd) > MEMO_LIMIT:
                self.odd.clear()
            memo, total, worst = self.memo, 0.0, 0.0
            t = f" {word} "
            for two in map(str.__add__, t, t[1:]):
                if not two.isascii():
                    x = memo.get(two)
                    x = self.bits(two) if x is None else x
                    total += x
                    if x > worst:
                        worst = x
                    if total > budget:
                        return total, True
            odd = worst > SUSPECT
            if not odd and len(word) > 5:
                letters = [c for c in word if c.isalpha()]
                accented = sum("\x7f" < c < "\u0250" for c in letters)
                odd = accented >= 6 and accented > 0.6 * len(letters)
            got = self.odd[word] = (total, odd)
        return got

    def cost(self, text: str) -> float:
        """Bits of the words that have non-ASCII characters."""
        return sum(self.word(w)[0] for w in re.split(r"[ \n\t]+", text) if not w.isascii())

    def suspect(self, text: str) -> bool:
        """Whether some word is out of the ordinary."""
        return any(self.word(w)[1] for w in re.split(r"[ \n\t]+", text) if not w.isascii())

    def token(self, token: str, budget: float = math.inf) -> tuple[float, bool]:
        """Cost and suspicion of a token, in which a step may have put spaces."""
        if " " not in token and "\n" not in token and "\t" not in token:
            return self.word(token, budget) if not token.isascii() else (0.0, False)
        return self.cost(token), self.suspect(token)


@lru_cache(1)
def model() -> Plausibility:
    return Plausibility(json.loads(MODEL.read_text()))


def search(text: str, m: Plausibility, margin: float = MARGIN) -> tuple[str, list[str]]:
    """The cheapest text reachable from ``text`` and the steps to it; no steps if none is acceptable."""
    counts = Counter(t for t in _TOKEN.findall(text) if not t.isascii() or "&" in t)
    # the dearest tokens first, so that a bad step shows early
    first = tuple(sorted(counts, key=lambda t: -counts[t] * m.token(t)[0]))
    weights = [counts[t] for t in first]
    start = sum(w * m.token(t)[0] for w, t in zip(weights, first))
    heap = [(start, 0, first, (), False)]
    seen = {first}
    best_cost, best = start - margin, ()
    lowest = [start, start]  # without and behind a change of national sets
    limit = lambda changed: lowest[changed] + max(BOUND, BOUND_SHARE * lowest[changed])
    count, ends = 0, math.inf  # the cheapest ordinary state seen, at which the search will end
    while heap:
        bits, _, state, path, ordinary = heapq.heappop(heap)
        if path and ordinary:
            break  # popped in order of cost: an ordinary text, and none cheaper is left
        changed = any(x in _SINGLE or x in _DOUBLES for x in path)
        if path and bits > limit(changed):
            continue
        for step in steps_from(state, changed):
            national = changed or step in _SINGLE or step in _DOUBLES
            most = min(max(limit(national), best_cost), ends)
            c, fine, to = 2.0 * (len(path) + 1), True, []  # a shorter way is likelier
            for w, t in zip(weights, state):
                x = token_step(t, step)
                if x is None:
                    break
                cost, odd = m.token(x, (most - c) / w)
                c += w * cost
                if c > most:
                    break  # costs add up: it can neither be the best nor be followed, nor would its turn come
                fine = fine and not odd
                to.append(x)
            else:
                new = tuple(to)
                if new in seen:
                    continue
                seen.add(new)
                way = (*path, step)
                if c < best_cost and c < (NATIONAL if fine and national else 1.0 if fine else DOUBTFUL if national else VOUCHED) * start:
                    best_cost, best = c, way
                lowest[national] = min(lowest[national], c)
                ends = min(ends, c) if fine else ends
                if c <= limit(national):
                    count += 1
                    heapq.heappush(heap, (c, count, new, way, fine))
    return (_apply(text, best)[0], list(best)) if best else (text, [])


def _apply(text: str, steps) -> Mapped:
    """A text after steps, and the source of each of its characters."""
    src = list(range(len(text)))
    for s in steps:
        if s in _DOUBLES:  # word by word, as a line has other words too
            new, back, at = [], [], 0
            for t in _TOKEN.finditer(text):
                got = mapped_step(t.group(), s) if not t.group().isascii() else None
                if got:
                    new += [text[at : t.start()], got[0]]
                    back += [*range(at, t.start()), *(t.start() + k for k in got[1])]
                    at = t.end()
            got = "".join([*new, text[at:]]), [*back, *range(at, len(text))]
        else:
            got = mapped_step(text, s)
        text, src = got[0], [src[k] for k in got[1]]
    return text, src


def _repair(text: str, m: Plausibility) -> tuple[list[str], list[list[str]]]:
    """The lines of a text and the steps that each needs."""
    lines = text.split("\n")
    ways: list[list[str]] = [[] for _ in lines]
    bad = []
    for k, line in enumerate(lines):
        if "&" in line and _REFERENCE.search(line):
            plain = _unescaped(line)[0]
            if not plain.isascii() and m.suspect(plain):  # references are no damage by themselves
                ways[k] = ["references"]
                bad.append(k)
                continue
        if not line.isascii() and m.suspect(line):
            bad.append(k)
    if not bad:
        return lines, ways
    now = {k: _apply(lines[k], ways[k])[0] for k in bad}
    _, path = search("\n".join(now.values()), m) if len(bad) > 1 else ("", [])
    for k in bad:
        line, lead = now[k], ways[k]
        new = _apply(line, path)[0] if path else line
        if path and m.cost(new) < m.cost(line) - 2:
            ways[k] = [*lead, *path]
            if not m.suspect(new):
                continue
            line = new
        _, own = search(line, m)
        ways[k] = ([*ways[k], *own] if line is new and path else [*lead, *own]) if own else ways[k]
        if ways[k] == ["references"]:
            ways[k] = []
    return lines, ways


def repair(text: str | None, m: Plausibility | None = None) -> tuple[str | None, list[str], bool]:
    """The restored text, the steps taken, and whether characters are lost for good."""
    if text is None or text.isascii() and not _REFERENCE.search(text):
        return text, [], False
    lines, ways = _repair(text, m or model())
    lost = "�" in text
    if not any(ways):
        return text, [], lost
    return "\n".join(_apply(x, w)[0] if w else x for x, w in zip(lines, ways)), list(dict.fromkeys(s for w in ways for s in w)), lost


def repair_mapped(text: str, m: Plausibility | None = None) -> tuple[str, list[int] | None]:
    """The restored text and the source offset of each of its characters (None: the same offsets). Exact: every step tells it."""
    if text.isascii() and not _REFERENCE.search(text):
        return text, None
    lines, ways = _repair(text, m or model())
    if not any(ways):
        return text, None
    out, src, at = [], [], 0
    for line, way in zip(lines, ways):
        new, back = _apply(line, way)
        out.append(new)
        src += [at + k for k in back]
        at += len(line) + 1
        src.append(at - 1)
    new = "\n".join(out)
    return new, None if src[:-1] == list(range(len(text))) else src[:-1]


_TYPE = pa.struct([("text", pa.string()), ("steps", pa.list_(pa.string())), ("lost", pa.bool_())])
DDL = "struct<text:string,steps:array<string>,lost:boolean>"


def repair_encoding(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` with ``repaired struct<text, steps, lost>`` in place of the text."""

    def run(texts):
        return pa.array([dict(zip(("text", "steps", "lost"), repair(t))) for t in texts], _TYPE)

    return add_column(df, "repaired", DDL, run, text)
