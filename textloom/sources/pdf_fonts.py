"""Fonts of PDF: what the codes of a string mean and how wide they are, and fonts for text that is set here."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from functools import lru_cache, reduce
from operator import add

import numpy as np

from textloom.operators import layout as L

#: What stands for a glyph whose character cannot be known.
UNKNOWN = "\ufffd"

# Glyph names that no rule gives, by the characters in the order of their names.
_NAMED = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash"
    " zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright"
    " asciicircum underscore grave braceleft bar braceright asciitilde exclamdown cent sterling currency yen brokenbar section dieresis copyright"
    " ordfeminine guillemotleft logicalnot registered macron degree plusminus acute mu paragraph periodcentered cedilla ordmasculine"
    " guillemotright onequarter onehalf threequarters questiondown AE Eth multiply Thorn germandbls ae eth divide thorn dotlessi OE oe"
    " florin circumflex caron breve dotaccent ring ogonek tilde hungarumlaut endash emdash quoteleft quoteright quotesinglbase quotedblleft"
    " quotedblright quotedblbase dagger daggerdbl bullet ellipsis perthousand guilsinglleft guilsinglright fraction Euro trademark minus"
    " Lslash lslash Oslash oslash fi fl ff ffi ffl nbspace sfthyphen".split(),
    [*" !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~¡¢£¤¥¦§¨©ª«¬®¯°±´µ¶·¸º»¼½¾¿ÆÐ×Þßæð÷þıŒœƒˆˇ˘˙˚˛˜˝–—‘’‚“”„†‡•…‰‹›⁄€™−ŁłØø", "fi", "fl", "ff", "ffi", "ffl", "\u00a0", "\u00ad"],
))
_ACCENTS = {"acute": "\u0301", "grave": "\u0300", "dieresis": "\u0308", "circumflex": "\u0302", "tilde": "\u0303", "ring": "\u030a", "ogonek": "\u0328", "dotaccent": "\u0307", "caron": "\u030c", "cedilla": "\u0327", "commaaccent": "\u0326", "macron": "\u0304", "breve": "\u0306", "hungarumlaut": "\u030b"}
# What the codes of Adobe's standard encoding mean where they differ from ASCII.
_STANDARD = {0x27: "’", 0x60: "‘", **dict(zip(range(0xA1, 0xB0), "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ")), 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
#: Codecs of the predefined character maps of East Asian fonts.
_CJK = {"GBK": "gbk", "GB-": "gb2312", "GBpc": "gb2312", "90ms": "cp932", "90msp": "cp932", "EUC": "euc_jp", "ETen": "big5", "B5pc": "big5", "HKscs": "big5hkscs", "KSCms": "cp949", "KSC": "euc_kr"}


@lru_cache(10_000)
def glyph_name(name: str) -> str:
    """The characters of a glyph's name: by list, by number, letter with accent, with a suffix dropped."""
    base = name.split(".")[0]
    if len(base) == 1:
        return base
    if base in _NAMED:
        return _NAMED[base]
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return "".join(chr(int(m.group(1)[k : k + 4], 16)) for k in range(0, len(m.group(1)), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", base):
        return chr(int(m.group(1), 16))
    if base[1:] in _ACCENTS:
        got = unicodedata.normalize("NFC", base[0] + _ACCENTS[base[1:]])
        return got if len(got) == 1 else UNKNOWN
    if m := re.fullmatch(r"afii100(\d\d)", base):  # Cyrillic letters in their order, with Ё behind Е
        k = int(m.group(1))
        small, k = k >= 65, k - (65 if k >= 65 else 17)
        if 0 <= k < 33:
            c = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"[k]
            return c if small else c.upper()
    for case, form in (("CAPITAL", base[:1].isupper()), ("SMALL", True)):
        if form:
            try:
                return unicodedata.lookup(f"GREEK {case} LETTER {base.upper()}")
            except KeyError:
                continue
    return UNKNOWN


_BLOCK = re.compile(rb"begin(bfchar|bfrange|codespacerange|cidrange|cidchar)(.*?)end\1", re.S)
_PAIR = re.compile(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>")
_RANGE = re.compile(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", re.S)


def from_hex(b: bytes) -> bytes:
    """Bytes of hexadecimal digits with white space anywhere; a last single digit stands for itself and a zero."""
    try:
        return bytes.fromhex(b.decode("ascii"))
    except ValueError:
        h = re.sub(rb"\s", b"", b)
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode("ascii"))


def cmap(raw: bytes) -> tuple[dict[int, str], set[int]]:
    """Characters by code, and the lengths that codes have."""
    out: dict[int, str] = {}
    lengths: set[int] = set()
    text = lambda h: from_hex(h).decode("utf-16-be", "replace")
    for kind, body in _BLOCK.findall(raw):
        if kind == b"codespacerange":
            lengths |= {len(from_hex(a)) for a, _ in _PAIR.findall(body)}
        elif kind == b"bfchar":
            out.update((int.from_bytes(from_hex(a), "big"), text(b)) for a, b in _PAIR.findall(body))
        elif kind == b"bfrange":
            for a, b, c, each in _RANGE.findall(body):
                lo, hi = int.from_bytes(from_hex(a), "big"), int.from_bytes(from_hex(b), "big")
                if each:
                    out.update((lo + k, text(x)) for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f\s]*)>", each)))
                elif base := text(c):
                    out.update((lo + k, base[:-1] + chr(min(ord(base[-1]) + k, 0x10FFFF))) for k in range(min(hi - lo, 0xFFFF) + 1))
    return out, lengths


class Odd(ValueError):
    """A code that isn't one character of some width."""


class _Made(dict):
    """Values made when they are first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        self[key] = v = self.make(key)
        return v


class Font:
    """Codes of strings as ``(bytes of the code, characters, advance in thousandths)``."""

    def __init__(self, pdf=None, v=None):
        d = pdf.get(v) if pdf else None
        d = d if isinstance(d, dict) else {}
        get = pdf.get if pdf else (lambda x: x)
        self.map: dict[int, str] = {}
        self.width: dict[int, float] = {}
        self.default: float | None = None
        self.scale = 1.0
        self.codec: str | None = None
        self.two = d.get("Subtype") == "Type0"
        self.lengths = {2} if self.two else {1}
        self.known: dict[bytes, tuple[str, float, bool]] = {}
        self.chars, self.steps = _Made(lambda code: self._plain(code)[0]), {}
        tu = get(d.get("ToUnicode"))
        if isinstance(tu, tuple):
            try:
                self.map = cmap(pdf.stream(tu))[0]
            except Exception:  # a damaged map is as good as none; codes without it read as unknown below
                self.map = {}
        if self.two:
            self._composite(pdf, d, get)
        else:
            self._simple(d, get)

    def _composite(self, pdf, d: dict, get) -> None:
        kid = get((get(d.get("DescendantFonts")) or [None])[0])
        kid = kid if isinstance(kid, dict) else {}
        self.default = float(get(kid.get("DW")) or 1000)
        w, k = get(kid.get("W")) or [], 0
        while k + 1 < len(w):
            a, b = get(w[k]), get(w[k + 1])
            if isinstance(b, list):
                self.width.update((a + j, float(get(x))) for j, x in enumerate(b))
                k += 2
            else:
                self.width.update(dict.fromkeys(range(a, min(b, a + 0xFFFF) + 1), float(get(w[k + 2]))))
                k += 3
        enc = get(d.get("Encoding"))
        if isinstance(enc, tuple):
            self.lengths = cmap(pdf.stream(enc))[1] or {2}
        elif isinstance(enc, str) and not enc.startswith("Identity"):
            if re.search("UCS2|UTF16", enc):
                self.codec = "utf-16-be"
            else:
                self.codec = next((c for n, c in _CJK.items() if enc.startswith(n)), None)
                self.lengths = {1, 2} if self.codec else {2}

    def _simple(self, d: dict, get) -> None:
        enc = get(d.get("Encoding"))
        base = enc if isinstance(enc, str) else enc.get("BaseEncoding") if isinstance(enc, dict) else None
        name = str(d.get("BaseFont") or "")
        self.table = {"MacRomanEncoding": "mac-roman", "WinAnsiEncoding": "cp1252"}.get(base or "", "standard" if d.get("Subtype") == "Type1" and "FontDescriptor" not in d or base == "StandardEncoding" else "cp1252")
        self.names: dict[int, str] = {}
        at = 0
        for x in (get(enc.get("Differences")) or []) if isinstance(enc, dict) else []:
            x = get(x)
            if isinstance(x, str):
                self.names[at] = glyph_name(x)
                at += 1
            else:
                at = int(x)
        first = int(get(d.get("FirstChar")) or 0)
        self.width = {first + k: float(get(x)) for k, x in enumerate(get(d.get("Widths")) or [])}
        if d.get("Subtype") == "Type3":
            self.scale = abs(float(get((get(d.get("FontMatrix")) or [0.001])[0]))) * 1000
        if "Courier" in name and not self.width:
            self.default = 600.0

    def _char(self, code: int, raw: bytes) -> str:
        got = self.map.get(code)
        if got is not None:
            return got
        if self.two:
            if self.codec:
                try:
                    return raw.decode(self.codec)
                except UnicodeDecodeError:
                    return UNKNOWN
            return UNKNOWN
        if code in self.names:
            return self.names[code]
        if self.table == "standard":
            return _STANDARD.get(code) or (chr(code) if code < 0x7F else bytes([code]).decode("cp1252", "replace"))
        return bytes([code]).decode(self.table, "replace")

    def _learn(self, raw: bytes, step: int) -> tuple[str, float, bool]:
        """Characters and advance of a code that is met for the first time."""
        code = int.from_bytes(raw, "big")
        c = self._char(code, raw)
        adv = self.width.get(code)
        if adv is None:
            adv = self.default if self.default is not None else L.advance(c[:1] or " ")
        got = self.known[raw] = (c, adv * self.scale, step == 1 and code == 32)
        return got

    def _plain(self, code: int) -> tuple[str, float]:
        step = max(self.lengths)
        raw = code.to_bytes(step, "big")
        c, adv, _ = self.known.get(raw) or self._learn(raw, step)
        if len(c) != 1 or not adv > 0:
            raise Odd
        return c, adv

    def plain(self, s: bytes, unit: float) -> tuple[str, float, float]:
        """Characters of a string, where its last one begins, and how wide that one is, in units; ``Odd`` if a code isn't exactly
        one character of some width, or codes differ in length. Advances are added in their order, as a drawing adds them."""
        if self.lengths == {1}:
            codes, text = s, s.decode("latin-1").translate(self.chars)
        elif self.lengths == {2} and not len(s) % 2:
            codes = struct.unpack(f">{len(s) // 2}H", s)
            text = "".join(map(self.chars.__getitem__, codes))
        else:
            raise Odd
        steps = self.steps.get(unit)
        if steps is None:
            if len(self.steps) >= 64:
                self.steps.clear()
            steps = self.steps[unit] = _Made(lambda code: self._plain(code)[1] * unit)
        return text, reduce(add, map(steps.__getitem__, codes[:-1]), 0.0), steps[codes[-1]]

    def codes(self, s: bytes):
        """``(offset, length, characters, advance)`` of each code of a string."""
        k, n = 0, len(s)
        mixed = self.lengths == {1, 2}
        step, known = max(self.lengths), self.known
        while k < n:
            if mixed:
                step = 1 if s[k] < 0x80 or self.codec == "cp932" and 0xA0 <= s[k] <= 0xDF else 2
            raw = s[k : k + step]
            got = known.get(raw) or self._learn(raw, step)
            yield k, len(raw), *got
            k += step


# ---- fonts to set text in -------------------------------------------------------

#: Where a font for text beyond code page 1252 is looked for; the first that is there is embedded.
FONT_PATHS = (
    "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf",
    "/usr/share/fonts/dejavu/DejaVuSans.ttf",
    "/usr/share/fonts/truetype/liberation/LiberationSans-Regular.ttf",
    "/usr/share/fonts/truetype/noto/NotoSans-Regular.ttf",
    "/Library/Fonts/Arial Unicode.ttf",
    "C:/Windows/Fonts/arial.ttf",
)


class TrueType:
    """A font file: which glyph each character has, and how wide it is."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        n = struct.unpack_from(">H", self.data, 4)[0]
        self.tables = {}
        for k in range(n):
            tag, _, at, size = struct.unpack_from(">4sIII", self.data, 12 + 16 * k)
            self.tables[tag.decode("latin-1")] = (at, size)
        head = self.tables["head"][0]
        self.units = struct.unpack_from(">H", self.data, head + 18)[0]
        self.box = [round(v * 1000 / self.units) for v in struct.unpack_from(">4h", self.data, head + 36)]
        hhea = self.tables["hhea"][0]
        self.ascent, self.descent = (round(v * 1000 / self.units) for v in struct.unpack_from(">2h", self.data, hhea + 4))
        self.long = struct.unpack_from(">H", self.data, hhea + 34)[0]
        self.glyphs = self._cmap()
        self.name = re.sub(r"\W", "", os.path.splitext(os.path.basename(path))[0])

    def _cmap(self) -> dict[int, int]:
        at = self.tables["cmap"][0]
        out: dict[int, int] = {}
        for k in range(struct.unpack_from(">H", self.data, at + 2)[0]):
            platform, enc, off = struct.unpack_from(">HHI", self.data, at + 4 + 8 * k)
            sub = at + off
            kind = struct.unpack_from(">H", self.data, sub)[0]
            if kind == 12:
                for g in range(struct.unpack_from(">I", self.data, sub + 12)[0]):
                    lo, hi, first = struct.unpack_from(">III", self.data, sub + 16 + 12 * g)
                    out.update((c, first + c - lo) for c in range(lo, hi + 1))
            elif kind == 4 and platform in (0, 3) and enc != 5:
                n = struct.unpack_from(">H", self.data, sub + 6)[0] // 2
                part = lambda j, f="H", n=n, sub=sub: struct.unpack_from(f">{n}{f}", self.data, sub + 14 + j)
                ends, begins, deltas, offsets = part(0), part(2 * n + 2), part(4 * n + 2, "h"), part(6 * n + 2)
                for j, (e, b, d, o) in enumerate(zip(ends, begins, deltas, offsets)):
                    for c in range(b, min(e, 0xFFFE) + 1):
                        g = c + d & 0xFFFF if not o else struct.unpack_from(">H", self.data, sub + 14 + 6 * n + 2 + 2 * j + o + 2 * (c - b))[0]
                        if o and g:
                            g = g + d & 0xFFFF
                        if g:
                            out.setdefault(c, g)
        return out

    @lru_cache(5_000)
    def _glyph(self, g: int) -> bytes:
        long = struct.unpack_from(">h", self.data, self.tables["head"][0] + 50)[0]
        at = self.tables["loca"][0]
        lo, hi = struct.unpack_from(">2I", self.data, at + 4 * g) if long else (2 * x for x in struct.unpack_from(">2H", self.data, at + 2 * g))
        base = self.tables["glyf"][0]
        return self.data[base + lo : base + hi]

    def subset(self, chars: list[str]) -> bytes:
        """A font file of the glyphs of some characters: glyph ``k + 1`` is that of the character ``k``."""
        order = [0, *(self.glyphs.get(ord(c), 0) for c in chars)]
        place = {}
        bodies = []
        k = 0
        while k < len(order):
            g = bytearray(self._glyph(order[k]))
            if len(g) > 10 and struct.unpack_from(">h", g, 0)[0] < 0:  # made of other glyphs
                at, more = 10, True
                while more:
                    flags, part = struct.unpack_from(">2H", g, at)
                    if part not in place:
                        place[part] = len(order)
                        order.append(part)
                    struct.pack_into(">H", g, at + 2, place[part])
                    at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 64 else 8 if flags & 128 else 0)
                    more = bool(flags & 32)
            bodies.append(bytes(g) + bytes(-len(g) % 4))
            k += 1
        loca, at = [0], 0
        for g in bodies:
            at += len(g)
            loca.append(at)
        cut = lambda tag: bytearray(self._table(tag))
        head, hhea, maxp = cut("head"), cut("hhea"), cut("maxp")
        struct.pack_into(">h", head, 50, 1)
        struct.pack_into(">H", hhea, 34, len(order))
        struct.pack_into(">H", maxp, 4, len(order))
        metrics = b"".join(self._metrics(g) for g in order)
        parts = {"glyf": b"".join(bodies), "head": bytes(head), "hhea": bytes(hhea), "hmtx": metrics, "loca": struct.pack(f">{len(loca)}I", *loca), "maxp": bytes(maxp)}
        parts |= {t: self._table(t) for t in ("cvt ", "fpgm", "prep") if t in self.tables}
        n, power = len(parts), 1 << (len(parts).bit_length() - 1)
        out, body, at = struct.pack(">IHHHH", 0x10000, n, 16 * power, power.bit_length() - 1, 16 * (n - power)), b"", 12 + 16 * n
        for tag in sorted(parts):
            t = parts[tag] + bytes(-len(parts[tag]) % 4)
            total = int(np.frombuffer(t, ">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF
            out += struct.pack(">4sIII", tag.encode(), total, at + len(body), len(parts[tag]))
            body += t
        return out + body

    def _table(self, tag: str) -> bytes:
        at, size = self.tables[tag]
        return self.data[at : at + size]

    @lru_cache(5_000)
    def _metrics(self, glyph: int) -> bytes:
        at = self.tables["hmtx"][0]
        if glyph < self.long:
            return self.data[at + 4 * glyph : at + 4 * glyph + 4]
        return self.data[at + 4 * self.long - 4 : at + 4 * self.long - 2] + self.data[at + 4 * self.long + 2 * (glyph - self.long) :][:2]


@lru_cache(4)
def text_font(paths: tuple[str, ...] = FONT_PATHS) -> TrueType | None:
    """The first font file that is there and reads; none if there is no such file."""
    for p in paths:
        try:
            return TrueType(p)
        except (OSError, KeyError, struct.error):
            continue
    return None
