"""Problem 2: one consistent spelling for texts that look the same.

Two passes over a text. The first maps single characters: wide and styled forms
of letters and digits, ligatures and digraph letters to the letters they stand
for, split letters (letter + mark) to the composed ones, odd spaces to the plain
one, and drops invisible characters inside words. The second looks at words:
each letter belongs to its own script and to those that have a look-alike of it;
the intersection of these sets over a word tells in which scripts the whole word
can be spelt. A word of mixed scripts takes the one script that is left (the one
of its surroundings if several are); a word of one script that stands among
words of another and can be spelt in that one takes it.

Kept as they are: words of a script of their own, two scripts joined by a hyphen,
joiners that Indic and Arabic spelling or an emoji needs, wide punctuation, Roman
numerals and codes, addresses (unless mixed), typographic quotes and dashes.
Null stays null; empty stays empty; the result is a fixed point.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import add_column

# Letters of Cyrillic and Greek and the Latin letters they look like.
CYRILLIC_LATIN = dict(zip("аеорсухіјѕһԁԛԝӏкпгАВЕКМНОРСТУХІЈЅԌԚԜҮЗЬЁёЇї", "aeopcyxijshdqwlknrABEKMHOPCTYXIJSGQWY3bËëÏï"))
GREEK_LATIN = dict(zip("οανρικυχγτεωηΑΒΕΖΗΙΚΜΝΟΡΤΥΧόάίέύ", "oavpikuxyteωnABEZHIKMNOPTYXóáíéú"))
del CYRILLIC_LATIN["З"], GREEK_LATIN["ω"], CYRILLIC_LATIN["п"], CYRILLIC_LATIN["г"]
TO = {("Cyrl", "Latn"): CYRILLIC_LATIN, ("Grek", "Latn"): GREEK_LATIN}
TO["Latn", "Cyrl"] = {v: k for k, v in CYRILLIC_LATIN.items() if k not in "ӏһԁԛԝԌԚԜҮЬіјѕІЈЅЇї"} | {"i": "і", "s": "ѕ", "j": "ј", "I": "І", "S": "Ѕ", "J": "Ј"}
TO["Latn", "Grek"] = {v: k for k, v in GREEK_LATIN.items()}
TO["Cyrl", "Grek"] = {c: TO["Latn", "Grek"][x] for c, x in CYRILLIC_LATIN.items() if x in TO["Latn", "Grek"]}
TO["Grek", "Cyrl"] = {c: TO["Latn", "Cyrl"][x] for c, x in GREEK_LATIN.items() if x in TO["Latn", "Cyrl"]}
SCRIPTS = ("Latn", "Cyrl", "Grek")
# Letters of Armenian, Cherokee and Lisu, and small capitals, and the Latin letters they look like.
TO["Armn", "Latn"] = dict(zip("օոսհցզյպՕՏՍԼ", "onuhgqjuOSUL"))
TO["Cher", "Latn"] = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡ", "ABCDEGHJKLMPSTVWZR"))
TO["Lisu", "Latn"] = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
TO["Smal", "Latn"] = dict(zip("ʙɢʜɪʟɴʀʏ", "bghilnry"))
#: Scripts whose letters are read as Latin ones only, never the other way round.
OTHERS = {"Armn": "Ա-Ֆա-և", "Cher": "Ꭰ-Ᏽꭰ-ꮿ", "Lisu": "ꓐ-ꓽ", "Smal": "ʙɢʜɪʟɴʀʏ"}
#: Look-alikes that only count inside a word of mixed scripts, being poor ones.
POOR = set("кγτεηпг")

INVISIBLE = "\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufeff\uffa0\ufe00-\ufe0f"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
STYLED = "ᴀ-ᴄᴅ-ᴋᴍᴏᴘᴛ-ᴜᴠ-ᴢ０-９Ａ-Ｚａ-ｚ\uff66-\uff9d\U0001d400-\U0001d7ffﬀ-ﬆǄ-ǌǱ-ǳ①-⑳Ⓐ-ⓩℂ-ℕℙ-ℝℤℨ-ℴĲĳſKÅ"
MARKS = "\u0300-\u033f\u0340-\u0345\u0653-\u0655\u3099\u309a"
_LETTERS = {"Latn": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "Cyrl": "Ѐ-ԯ", "Grek": "Ͱ-ͳͶ-ͽͿΆ-Ͽἀ-῿"}
#: Only texts with one of these, or with letters of two of the scripts, can change.
SUSPECT = f"[{INVISIBLE}{SPACES}{STYLED}{MARKS}]"
#: Characters that never make a text suspect: one short class, which most texts consist of.
PLAIN = "\\x00-\x9f¡-¬®-ıĴ-žƀ-ǃǍ-ǰǴ-ɏ–—‘’“”„…€•"
LATIN, OTHER = f"[{_LETTERS['Latn']}]", f"[{_LETTERS['Cyrl']}{_LETTERS['Grek']}{''.join(OTHERS.values())}]"
_CHANGE = re.compile(f"[{INVISIBLE}]+|[{SPACES}]|[{STYLED}]|[^\\s\\d][{MARKS}]+")
_ANY = re.compile(SUSPECT)
_OTHER = re.compile(OTHER)
_ALL = "".join([*_LETTERS.values(), *OTHERS.values()])
_WORD = re.compile(f"[{_ALL}][{_ALL}\u0300-\u036f]*")
_EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿⌀-⏿⬀-⯿©®™]")
_CJK = re.compile("[\u3000-〿぀-ヿ㐀-鿿＀-／：-＠]")
_ROMAN = re.compile("[IVXLCDM]+|[ІVХLСDМ]+")


@lru_cache(None)
def _small_capital(c: str) -> str:
    """The letter that a small capital is a form of, by its name."""
    name = unicodedata.name(c, "")
    return name[-1].lower() if name.startswith("LATIN LETTER SMALL CAPITAL ") and name[-2] == " " else c


def script(c: str) -> str:
    """Script of a letter; a combining mark goes with any and is looked at by nobody."""
    o = ord(c)
    if c in TO["Smal", "Latn"]:
        return "Smal"
    if 0x530 <= o < 0x590:
        return "Armn"
    if 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0:
        return "Cher"
    if 0xA4D0 <= o < 0xA500:
        return "Lisu"
    return "Latn" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "Grek" if o < 0x400 or 0x1F00 <= o < 0x2000 else "Cyrl"


def resolved(c: str, own: str, poor: bool = True) -> set[str]:
    """The scripts in which a letter can be spelt."""
    return {own} | {s for s in SCRIPTS if s != own and c in TO.get((own, s), ()) and (poor or c not in POOR and TO[own, s][c] not in POOR)}


@lru_cache(200_000)
def _word(w: str) -> tuple[str, frozenset[str], str | None]:
    """A word without its marks, its scripts, and its script if it can be spelt in no other."""
    bare = w if w.isascii() else "".join(c for c in w if not "\u0300" <= c <= "\u036f")
    own = frozenset(script(c) for c in bare)
    one = next(iter(own)) if len(own) == 1 else None
    return bare, own, one if one and any(len(resolved(c, one, False)) == 1 for c in bare) else None


def _keeps(text: str, a: int, b: int) -> bool:
    """Whether the invisible characters ``text[a:b]`` are needed by the spelling around them."""
    p, n, run = text[a - 1 : a], text[b : b + 1], text[a:b]
    if all(c in "\u200d\ufe0e\ufe0f⃣" for c in run):
        if p and p in "0123456789#*":
            return "\ufe0f" in run or "\u20e3" in run
        if p and (_EMOJI.match(p) or 0x1F3FB <= ord(p) <= 0x1F3FF):
            return True
        if p and 0x0900 <= ord(p) <= 0x0DFF:
            return p in "\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d\u0dca"
    if all(c in "\u200c\u200d" for c in run):
        if p and (p in "\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d\u0dca" or 0x0620 <= ord(p) <= 0x06FF and n and 0x0620 <= ord(n) <= 0x06FF):
            return True
    if all(c in "\u200e\u200f\u202a\u202b\u202c\u2066\u2067\u2068\u2069" for c in run):
        return not (p.isalnum() and n.isalnum())  # marks of direction between words
    return False


def characters(text: str) -> tuple[str, list[int] | None]:
    """First pass: the text and, if it changed, the source offset of every character of it."""
    if not _ANY.search(text):  # one class, a fast scan
        return text, None
    out, at, src = [], 0, None
    for m in _CHANGE.finditer(text):
        a, b = m.span()
        g = m.group()
        if a < at:
            continue
        c = g[0]
        if len(g) > 1 and unicodedata.combining(g[-1]) and unicodedata.category(c) != "Cf" and c not in "\u00ad\u034f":
            new = unicodedata.normalize("NFC", g)
            if new == g:
                new = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", g)) if re.match(f"[{STYLED}]", c) else g
        elif c.isspace() or c == "\u3000":
            new = g if c == "\u3000" and _CJK.match(text[a - 1 : a]) and _CJK.match(text[b : b + 1]) else " "
        elif re.match(f"[{INVISIBLE}]", c):
            new = g if _keeps(text, a, b) else ""
        elif "ᴀ" <= c <= "ᴢ":
            new = _small_capital(c)
        else:
            new = unicodedata.normalize("NFKC", g)
        if new == g:
            continue
        if src is None:
            src = []
        out.append(text[at:a])
        src.extend(range(at, a))
        out.append(new)
        src.extend([a] * len(new))
        at = b
    if src is None:
        return text, None
    out.append(text[at:])
    src.extend(range(at, len(text)))
    new = "".join(out)
    if not unicodedata.is_normalized("NFC", new) and re.search(f"[{MARKS}]", new):
        again, more = characters(new)  # a mark that an invisible character had kept apart
        return (again, [src[k] for k in more]) if more else (new, src)
    return new, src


def words(text: str) -> str:
    """Second pass, which keeps every offset."""
    if not _OTHER.search(text):
        return text
    found = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    known = [_word(w) for _, _, w in found]
    if len({s for x in known for s in x[1]}) < 2:
        return text
    bare, own = [x[0] for x in known], [x[1] for x in known]
    # the surroundings of a word: scripts of near words that can only be spelt in their own
    sure = [x[2] for x in known]
    out = list(text)
    for k, ((a, b, _), w, s) in enumerate(zip(found, bare, own)):
        if len(s) > 1:
            if "Smal" in s and text[a - 1 : a] in ("/", "["):
                continue  # sounds in their own notation
            can = set.intersection(*(resolved(c, script(c)) for c in w))
            if not can:
                continue
            to = next(iter(can)) if len(can) == 1 else _around(text, found, sure, k, can) or max(can, key=lambda x: (sum(script(c) == x for c in w), x == "Latn"))
        else:
            me = next(iter(s))
            if sure[k] or not (can := set.intersection(*(resolved(c, me, False) for c in w)) - {me}):
                continue
            if w.isupper() and (len(w) > 1 or not w.isalpha()) and (_ROMAN.fullmatch(w) or len(w) < 3) or text[a - 1 : a] in ("@", "_", "/", "#") or text[b : b + 1] in ("@", "_", "/") or text[a - 1 : a].isdigit() or text[b : b + 1].isdigit():
                continue
            if text[a - 1 : a] == "-" and text[a - 2 : a - 1].isalnum() or text[b : b + 1] in "-." and text[b + 1 : b + 2].isalnum():
                continue
            to = _around(text, found, sure, k, can, me)
            if not to:
                continue
        for i in range(a, b):
            c = out[i]
            if "\u0300" <= c <= "\u036f":
                continue
            f = script(c)
            if f != to:
                out[i] = TO[f, to][c]
    return "".join(out)


def _around(text: str, found: list, sure: list, k: int, can: set[str], me: str | None = None) -> str | None:
    """The script of the nearest sure words on the line, if it is one of ``can`` and no near word is of ``me``."""
    votes = []
    for step in (-1, 1):
        seen = 0
        i = k + step
        while 0 <= i < len(found) and seen < 3:
            lo, hi = (found[i][1], found[k][0]) if step < 0 else (found[k][1], found[i][0])
            if hi - lo > 80 or "\n" in text[lo:hi] and seen:
                break
            if sure[i]:
                votes.append(sure[i])
                seen += 1
            i += step
    if not votes or me in votes:
        return None
    top = max(set(votes), key=votes.count)
    return top if top in can else None


def unify(text: str | None) -> str | None:
    return text if text is None else unify_mapped(text)[0]


def unify_mapped(text: str) -> tuple[str, list[int] | None]:
    """The unified text and the source offset of each of its characters (None: the same offsets)."""
    if text.isascii():
        return text, None
    new, src = characters(text)
    spelt = words(new)
    if spelt != new and (more := characters(spelt))[1]:  # a mark on a letter that has changed its script
        return more[0], [src[k] for k in more[1]] if src else more[1]
    return spelt, src


def unify_items(df: DataFrame, text: str = "text") -> DataFrame:
    """``unified`` in place of the text. Texts without any suspect character never leave the JVM."""
    suspect = _suspect(text)
    plain = df.filter(~F.coalesce(suspect, F.lit(False))).withColumnRenamed(text, "unified")
    return plain.select([c if c != text else "unified" for c in df.columns]).unionByName(changed_items(df, text, False))


def changed_items(df: DataFrame, text: str = "text", only: bool = True) -> DataFrame:
    """Rows whose text has a suspect character, with ``unified`` in place of it; ``only`` those that change."""
    part = df.filter(_suspect(text))
    if not only:
        return add_column(part, "unified", "string", lambda ts: pa.array([unify(t) for t in ts], pa.string()), text)
    return add_column(part, "unified", "string", lambda ts: pa.array([None if (u := unify(t)) == t else u for t in ts], pa.string()), text).filter("unified IS NOT NULL")


def _suspect(text: str):
    """Whether a text can change, by single character classes, each one scan."""
    col = F.col(text)
    others = col.rlike(_java(f"[{''.join(OTHERS.values())}]"))
    cyrillic, greek = (col.rlike(_java(f"[{_LETTERS[k]}]")) for k in ("Cyrl", "Grek"))
    wide = F.octet_length(col) != F.char_length(col)  # plain ASCII can't change
    return wide & col.rlike(f"[^{PLAIN}]") & (col.rlike(_java(SUSPECT)) | (cyrillic & greek) | ((cyrillic | greek) & col.rlike(LATIN)) | others)


def _java(pattern: str) -> str:
    """Astral ranges in the form Java's regular expressions read."""
    return re.sub("[\U00010000-\U0010ffff]", lambda m: f"\\x{{{ord(m.group()):X}}}", pattern)
