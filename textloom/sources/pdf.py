"""Text-layer PDF without a PDF library: a reader, an in-place eraser and a writer.

Read: classic and compressed cross-reference files (objects are found by scan,
object streams are opened), every general stream filter, files encrypted for an
empty password, page trees, rotated and cropped pages, simple, composite and Type 3
fonts, text operators, form XObjects at any depth. A code without a Unicode mapping
reads as U+FFFD. Whatever can't be read, a damaged stream or operator, a tree or
form that contains itself, fails the document: text that is passed over in silence
would be a leak. Not read: vertical writing (it is taken as horizontal), form
fields, annotations, scanned pages.

Written: pages of text in Helvetica where code page 1252 suffices, otherwise in an
embedded TrueType font (``pdf_fonts.FONT_PATHS``), and for characters that it lacks
in a font that is only named; all have a Unicode map, so that text is found again
whatever its script.

In place, the codes of the glyphs concerned are taken out of the strings that hold
them, in forms too (a form used elsewhere is copied for the page), the room they
took is kept, and a white box with the label is drawn over their rectangles.
Objects that nothing refers to any more are left out of the file: the text is gone
from it, not just covered.
"""

from __future__ import annotations

import difflib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import schema as S
from textloom.operators import layout as L
from textloom.sources import pdf_crypt, pdf_filters
from textloom.sources.pdf_fonts import FONT_PATHS, Font, Odd, from_hex, text_font

_OBJ = re.compile(rb"obj\b")
_OBJ_NUMBER = re.compile(rb"(\d+)\s+(\d+)\s+\Z")
_TOKEN = re.compile(rb"\s*(?:(%[^\r\n]*)|(<<|>>|\[|\]|\{|\})|(/[^\s<>\[\]()/%{}]*)|(\()|<([0-9A-Fa-f\s]*)>|([^\s<>\[\]()/%{}]+))")
_REF = re.compile(rb"(\d+)\s+(\d+)\s+R\b")
_STREAM = re.compile(rb"\s*stream(?:\r\n|\n|\r)")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_FLAT = re.compile(rb"([\s0-9.+-]*)\]")
_SPECIAL = re.compile(rb"[()\\]")
_INLINE_IMAGE_END = re.compile(rb"\sEI\b")


class Name(str):
    pass


class Ref(int):
    pass


class Op(str):
    pass


_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}


def _string(b: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that begins behind its bracket."""
    out, depth = bytearray(), 1
    while special := _SPECIAL.search(b, at):
        out += b[at : special.start()]
        at = special.start()
        c = b[at]
        if c == 0x5C:
            n = b[at + 1] if at + 1 < len(b) else 0
            if 0x30 <= n <= 0x37:
                m = _OCTAL.match(b, at + 1)
                out.append(int(m.group(), 8) & 255)
                at = m.end()
                continue
            if n == 13 and b[at + 2 : at + 3] == b"\n":
                at += 3
                continue
            if n not in (10, 13):
                out.append(_ESCAPES.get(n, n))
            at += 2
            continue
        if c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                return bytes(out), at + 1
        out.append(c)
        at += 1
    return bytes(out + b[at:]), max(at, len(b))


def _numbers(body: bytes) -> list | None:
    """The numbers of an array of nothing else; none if something isn't one."""
    try:
        return [float(w) if b"." in w else int(w) for w in body.split()]
    except ValueError:
        return None


def parse(b: bytes, at: int = 0, ops: bool = False):
    """Objects from bytes. With ``ops``: pairs ``(object, (start, end))`` to the end; else the first object and where it ends."""
    stack: list[list] = [[]]
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    token = _TOKEN.match
    while m := token(b, at):
        begin, at = m.span()
        kind = m.lastindex
        if kind == 1:
            continue
        if kind == 2:
            p = m.group(2)
            if p == b"[" and (flat := _FLAT.match(b, at)) and (v := _numbers(flat.group(1))) is not None:
                at = flat.end()
            elif p in (b"<<", b"["):
                stack.append([p])
                opened.append(begin)
                continue
            elif p in (b">>", b"]") and len(stack) > 1:
                top = stack.pop()[1:]
                begin = opened.pop()
                v = dict(zip(top[::2], top[1::2])) if p == b">>" else top
            else:
                continue
        elif kind == 3:
            n = m.group(3)
            v = Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x.group(1), 16)]), n[1:]) if b"#" in n else n[1:]).decode("latin-1"))
        elif kind == 4:
            v, at = _string(b, at)
        elif kind == 5:
            v = from_hex(m.group(5))
        else:
            w = m.group(6)
            r = _REF.match(b, m.start(6)) if not ops and w.isdigit() else None
            if r:
                v, at = Ref(int(r.group(1))), r.end()
            else:
                try:
                    v = float(w) if b"." in w else int(w)
                except ValueError:
                    v = {b"true": True, b"false": False, b"null": None}.get(w, Op(w.decode("latin-1")))
        stack[-1].append(v)
        if len(stack) == 1:
            if not ops:
                return v, at
            spans.append((begin, at))
            if v == "ID" and isinstance(v, Op):  # an inline image
                e = _INLINE_IMAGE_END.search(b, at)
                at = e.end() if e else len(b)
    return list(zip(stack[0], spans)) if ops else (None, at)


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        self.data = data
        self.where: dict[int, int] = {}
        self.packed: dict[int, object] = {}
        self.cache: dict[int, object] = {}
        self.crypt = None
        generation: dict[int, int] = {}
        for m in _OBJ.finditer(data):
            before = data[max(0, m.start() - 32) : m.start()]
            if not before[-1:].isalpha() and (n := _OBJ_NUMBER.search(before)):
                self.where[int(n.group(1))] = m.end()
                generation[int(n.group(1))] = int(n.group(2))
        self.trailer = self._trailer()
        if "Encrypt" in self.trailer:
            lock = self.trailer["Encrypt"]
            names = self.get(lock)
            if not isinstance(names, dict):
                raise ValueError("encrypted")
            self.crypt = pdf_crypt.Lock({k: self.get(v) for k, v in names.items()}, (self.get(self.trailer.get("ID")) or [b""])[0], self.get, generation)
            self.cache = {int(lock): names} if isinstance(lock, Ref) else {}
        if b"/ObjStm" in data:
            for n in list(self.where):
                d = self.get(Ref(n))
                if isinstance(d, tuple) and d[0].get("Type") == "ObjStm":
                    raw = self.stream(d)
                    first = int(self.get(d[0]["First"]))
                    nums = [int(x) for x in raw[:first].split()]
                    for num, off in zip(nums[::2], nums[1::2]):
                        if num not in self.where:
                            self.packed[num] = parse(raw, first + off)[0]
            self.cache = {k: v for k, v in self.cache.items() if v is not None}
        self.pages = self._pages()

    def _trailer(self) -> dict:
        """What all trailers of the file say together, the last one first."""
        out: dict = {}
        for m in re.finditer(rb"trailer\s*(?=<<)", self.data):
            v = parse(self.data, m.end())[0]
            out |= v if isinstance(v, dict) else {}
        if b"/XRef" in self.data:
            for n in self.where:
                v = self.get(Ref(n))
                if isinstance(v, tuple) and v[0].get("Type") == "XRef":
                    out |= {k: v[0][k] for k in ("Root", "Info", "Encrypt", "ID") if k in v[0]}
        return out

    def get(self, v):
        """The value of a reference; a stream is ``(dictionary, start of its bytes, object number)``."""
        trail = set()
        while isinstance(v, Ref):
            n = int(v)
            if n in trail:
                raise ValueError("a reference leads back to itself")
            trail.add(n)
            if n in self.cache:
                v = self.cache[n]
                continue
            if n in self.packed:
                v = self.packed[n]
            elif n in self.where:
                v, end = parse(self.data, self.where[n])
                s = _STREAM.match(self.data, end)
                if self.crypt:
                    v = self.crypt.strings(v, n)
                if s and isinstance(v, dict):
                    v = (v, s.end(), n)
            else:
                v = None
            self.cache[n] = v
        return v

    def raw_stream(self, v) -> bytes:
        """The bytes of a stream as they stand, decrypted."""
        d, at, n = v
        size = self.get(d.get("Length"))
        if isinstance(size, int) and self.data[at + size : at + size + 12].lstrip().startswith(b"endstream"):
            raw = self.data[at : at + size]
        else:
            end = self.data.find(b"endstream", at)
            if end < 0:
                raise ValueError("a stream without an end")
            raw = self.data[at:end]
            raw = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw.endswith((b"\n", b"\r")) else raw
        return self.crypt.stream(raw, d, n) if self.crypt else raw

    def stream(self, v) -> bytes:
        d = v[0]
        listed = lambda x: x if isinstance(x, list) else [x] if x is not None else []
        names = [str(self.get(x)) for x in listed(self.get(d.get("Filter", d.get("F"))))]
        parms = [{k: self.get(y) for k, y in (self.get(p) or {}).items()} for p in listed(self.get(d.get("DecodeParms", d.get("DP"))))]
        return pdf_filters.decode(self.raw_stream(v), names, parms)

    def root(self) -> tuple[int | None, dict]:
        r = self.trailer.get("Root")
        d = self.get(r)
        if isinstance(d, dict) and "Pages" in d:
            return int(r), d
        for n in [*self.where, *self.packed]:
            d = self.get(Ref(n))
            if isinstance(d, dict) and d.get("Type") == "Catalog":
                return n, d
        raise ValueError("no catalogue")

    def _pages(self) -> list[dict]:
        out: list[dict] = []
        todo: list[tuple[object, dict]] = [(self.root()[1]["Pages"], {})]
        seen: set[int] = set()
        while todo:
            v, inherited = todo.pop()
            if isinstance(v, Ref):
                if int(v) in seen:
                    raise ValueError("a page tree that contains itself")
                seen.add(int(v))
            d = self.get(v)
            if not isinstance(d, dict):
                raise ValueError("a page is missing")
            got = inherited | {k: d[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in d}
            if "Kids" in d:
                todo += [(k, got) for k in reversed(self.get(d["Kids"]) or [])]
            else:
                out.append({**got, **d, "_ref": int(v) if isinstance(v, Ref) else None})
        return out

    def _box(self, page: dict) -> tuple[float, float, float, float]:
        for key in ("CropBox", "MediaBox"):
            box = [float(self.get(x)) for x in self.get(page.get(key)) or []]
            if len(box) == 4:
                return min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
        return 0.0, 0.0, L.WIDTH, L.HEIGHT

    def _turn(self, page: dict) -> int:
        return int(self.get(page.get("Rotate")) or 0) % 360

    def size(self, page: dict) -> tuple[float, float]:
        """Width and height as the page is seen."""
        x0, y0, x1, y1 = self._box(page)
        return (y1 - y0, x1 - x0) if self._turn(page) in (90, 270) else (x1 - x0, y1 - y0)

    def matrix(self, page: dict) -> tuple:
        """From the page's own space to the page as it is seen, from the bottom left."""
        x0, y0, x1, y1 = self._box(page)
        return {90: (0, -1, 1, 0, -y0, x1), 180: (-1, 0, 0, -1, x1, y1), 270: (0, 1, -1, 0, y1, -x0)}.get(self._turn(page), (1, 0, 0, 1, -x0, -y0))

    def content(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = c if isinstance(c, list) else [page.get("Contents")] if c else []
        return b"\n".join(self.stream(v) for x in parts if isinstance(v := self.get(x), tuple))

    def form(self, res: dict, name) -> tuple | None:
        """The form that a name stands for in resources; None for an image and for nothing."""
        x = self.get((self.get(res.get("XObject")) or {}).get(name))
        return x if isinstance(x, tuple) and self.get(x[0].get("Subtype")) == "Form" else None


def _mul(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _inverse(m):
    d = m[0] * m[3] - m[1] * m[2]
    a, b, c, e = m[3] / d, -m[1] / d, -m[2] / d, m[0] / d
    return a, b, c, e, -(m[4] * a + m[5] * c), -(m[4] * b + m[5] * e)


class Glyph:
    """A character as drawn: its rectangle from the top left, its line (``u`` along, ``v`` across), and where its code stands:
    ``place`` is ``(path of forms, operator, string)``, then offset and length in it and the room that it takes."""

    __slots__ = ("c", "rect", "u0", "u1", "v", "turn", "size", "place", "k", "n", "room", "two")

    def __init__(self, c, rect, u0, u1, v, turn, size, place, k, n, room, two):
        self.c, self.rect, self.u0, self.u1, self.v, self.turn, self.size, self.place, self.k, self.n, self.room, self.two = c, rect, u0, u1, v, turn, size, place, k, n, room, two


class Run:
    """The characters of a string that follow each other without gaps on a level line, as one; attributes as those of a glyph."""

    __slots__ = ("c", "rect", "u0", "u1", "v", "turn", "size")

    def __init__(self, c, rect, u0, u1, v, size):
        self.c, self.rect, self.u0, self.u1, self.v, self.turn, self.size = c, rect, u0, u1, v, 0.0, size


def glyphs(pdf: Pdf, page: dict) -> list[Glyph]:
    """Glyphs of a page in drawing order."""
    out: list[Glyph] = []
    _Drawing(pdf, pdf.size(page)[1], out).run(pdf.content(page), pdf.get(page.get("Resources")) or {}, pdf.matrix(page), (), ())
    return out


def runs(pdf: Pdf, page: dict) -> list[Glyph | Run]:
    """What ``glyphs`` gives, with whole strings as one wherever they are plain: enough for the text of a page, and much faster."""
    out: list[Glyph | Run] = []
    _Drawing(pdf, pdf.size(page)[1], out, True).run(pdf.content(page), pdf.get(page.get("Resources")) or {}, pdf.matrix(page), (), ())
    return out


#: Fonts that are told by their dictionaries alone, which files repeat.
_FONTS: dict[bytes, Font] = {}


class _Drawing:
    def __init__(self, pdf: Pdf, height: float, out: list, whole: bool = False):
        self.pdf, self.height, self.out, self.whole = pdf, height, out, whole
        self.fonts: dict[object, Font] = {}

    def font(self, v) -> Font:
        key = int(v) if isinstance(v, Ref) else id(v)
        if key not in self.fonts:
            self.fonts[key] = self._font(v)
        return self.fonts[key]

    def _font(self, v) -> Font:
        d = self.pdf.get(v)
        if not isinstance(d, dict) or _refs(d):
            return Font(self.pdf, v)
        key = dump(d)
        if key not in _FONTS:
            if len(_FONTS) >= 256:
                _FONTS.clear()
            _FONTS[key] = Font(self.pdf, v)
        return _FONTS[key]

    def run(self, content: bytes, res: dict, ctm, path: tuple, inside: tuple) -> None:
        """Draw a content stream. ``path``: the operators that led into it; ``inside``: the forms it is in."""
        pdf, out, height, whole = self.pdf, self.out, self.height, self.whole
        fonts = pdf.get(res.get("Font")) or {}
        args: list = []
        stack: list = []
        font, size, tc, tw, th, lead, rise = Font(), 1.0, 0.0, 0.0, 1.0, 0.0, 0.0
        tm = tlm = (1, 0, 0, 1, 0, 0)
        n = -1

        def show(s: bytes, string: int) -> None:
            nonlocal tm
            if not isinstance(s, bytes):
                raise ValueError("text that is no string")
            place = (path, n, string)
            m = _mul(tm, ctm)
            long = math.hypot(m[0], m[1]) or 1.0
            dx, dy = m[0] / long, m[1] / long  # the direction of the line
            turn, two = round(math.atan2(dy, dx), 2), font.two
            ux, uy = size * m[2], size * m[3]
            tall = math.hypot(ux, uy)
            x, y = m[4] + rise * m[2], m[5] + rise * m[3]
            unit = size * th / 1000
            extra, gap = tc * th, tw * th
            loose, space = (tc * 1000 / size, tw * 1000 / size) if size else (0.0, 0.0)
            at = 0.0
            straight = not dy and not ux
            lo, hi = height - y - 0.8 * uy, height - y + 0.22 * uy
            if lo > hi:
                lo, hi = hi, lo
            across = y * dx - x * dy
            along = x * dx + y * dy
            if whole and straight and dx > 0 and unit > 0 and not extra and not gap and tall > 0.01 and abs(along) < 1e6 and s:
                try:
                    chars, at, wide = font.plain(s, unit)
                except Odd:
                    pass
                else:
                    u0, u1 = along, along + at * long + wide * long
                    out.append(Run(chars, (u0, lo, u1, hi), u0, u1, across, tall))
                    tm = _mul((1, 0, 0, 1, at + wide, 0), tm)
                    return
            for k, size_, chars, adv, is_space in font.codes(s):
                wide = adv * unit
                u0 = along + at * long
                u1 = u0 + wide * long
                if u1 < u0:
                    u0, u1 = u1, u0
                if straight and dx > 0:
                    rect = (u0, lo, u1, hi)
                else:
                    px, py = x + at * m[0], y + at * m[1]
                    ax, ay = wide * m[0], wide * m[1]
                    xs = (px - 0.22 * ux, px + 0.8 * ux, px + ax - 0.22 * ux, px + ax + 0.8 * ux)
                    ys = (py - 0.22 * uy, py + 0.8 * uy, py + ay - 0.22 * uy, py + ay + 0.8 * uy)
                    rect = (min(xs), height - max(ys), max(xs), height - min(ys))
                room = -(adv + loose + (space if is_space else 0.0))
                for c in chars:
                    out.append(Glyph(c, rect, u0, u1, across, turn, tall, place, k, size_, room, two))
                at += wide + extra + (gap if is_space else 0.0)
            tm = _mul((1, 0, 0, 1, at, 0), tm)

        for v, _ in parse(content, ops=True):
            if not isinstance(v, Op):
                args.append(v)
                continue
            n += 1
            a, args = args, []
            try:
                if v == "BT":
                    tm = tlm = (1, 0, 0, 1, 0, 0)
                elif v == "q":
                    stack.append((ctm, font, size, tc, tw, th, lead, rise))
                elif v == "Q":
                    if stack:
                        ctm, font, size, tc, tw, th, lead, rise = stack.pop()
                elif v == "cm":
                    ctm = _mul(tuple(map(float, a[-6:])), ctm)
                elif v == "Tf":
                    font, size = self.font(fonts.get(a[-2])), float(a[-1])
                elif v == "gs":
                    g = pdf.get((pdf.get(res.get("ExtGState")) or {}).get(a[-1]))
                    if isinstance(g, dict) and (f := pdf.get(g.get("Font"))):
                        font, size = self.font(f[0]), float(pdf.get(f[1]))
                elif v == "Tc":
                    tc = float(a[-1])
                elif v == "Tw":
                    tw = float(a[-1])
                elif v == "Tz":
                    th = float(a[-1]) / 100
                elif v == "TL":
                    lead = float(a[-1])
                elif v == "Ts":
                    rise = float(a[-1])
                elif v == "Tm":
                    tm = tlm = tuple(map(float, a[-6:]))
                    if len(tm) != 6:
                        raise ValueError("a matrix of other than six numbers")
                elif v in ("Td", "TD"):
                    if v == "TD":
                        lead = -float(a[-1])
                    tm = tlm = _mul((1, 0, 0, 1, float(a[-2]), float(a[-1])), tlm)
                elif v in ("T*", "'", '"'):
                    if v == '"':
                        tw, tc = float(a[-3]), float(a[-2])
                    tm = tlm = _mul((1, 0, 0, 1, 0, -lead), tlm)
                    if v != "T*":
                        show(a[-1], -1)
                elif v == "Tj":
                    show(a[-1], -1)
                elif v == "TJ":
                    for k, x in enumerate(a[-1]):
                        if isinstance(x, bytes):
                            show(x, k)
                        else:
                            tm = _mul((1, 0, 0, 1, -float(x) / 1000 * size * th, 0), tm)
                elif v == "Do" and (x := pdf.form(res, a[-1])):
                    if x[2] in inside:
                        raise ValueError("a form that draws itself")
                    own = pdf.get(x[0].get("Resources"))
                    m = tuple(float(pdf.get(y)) for y in pdf.get(x[0].get("Matrix")) or (1, 0, 0, 1, 0, 0))
                    self.run(pdf.stream(x), own if isinstance(own, dict) else res, _mul(m, ctm), (*path, n), (*inside, x[2]))
            except (IndexError, TypeError) as e:
                raise ValueError(f"operator {v} can't be read") from e


def lines(gs: list[Glyph]) -> list[list[int]]:
    """Indices of glyphs by line: same base line, going on behind the last."""
    out: list[list[int]] = []
    last = None
    for k, g in enumerate(gs):
        if last is not None and g.turn == last.turn and abs(last.v - g.v) <= 0.3 * max(last.size, 1) and -0.5 * last.size - 1 <= g.u0 - last.u1 < 8 * last.size:
            out[-1].append(k)
        else:
            out.append([k])
        last = g
    return [x for x in out if any(not gs[k].c.isspace() for k in x)]


def blocks(gs: list[Glyph]) -> list[list[list[int]]]:
    """Lines that stand under each other closely, block by block."""
    out: list[list[list[int]]] = []
    for line in lines(gs):
        g = gs[line[0]]
        if out:
            p = gs[out[-1][-1][0]]
            if p.turn == g.turn and 0 < p.v - g.v <= 1.6 * max(p.size, g.size):
                out[-1].append(line)
                continue
        out.append([line])
    return out


def page_text(gs: list[Glyph], width: float) -> tuple[str, list[int | None]]:
    """Text of a page and the glyph, or run, of each of its characters (none for separators)."""
    text: list[str] = []
    src: list[int | None] = []
    for block in blocks(gs):
        before = None
        for line in block:
            chars, at = [], []
            for n, k in enumerate(line):
                if n and gs[k].u0 - gs[line[n - 1]].u1 > 0.25 * gs[k].size and not gs[k].c[0].isspace() and not chars[-1][-1].isspace():
                    chars.append(" ")
                    at.append(None)
                chars.append(gs[k].c)
                at += [k] * len(gs[k].c)
            now = "".join(chars), min(gs[k].rect[0] for k in line), max(gs[k].rect[2] for k in line)
            if before:
                text.append(" " if L.soft_wrapped(*before, now[1], width) else "\n")
                src.append(None)
            text += chars
            src += at
            before = now
        text.append("\n")
        src.append(None)
    return "".join(text), src


# ---- writing ----------------------------------------------------------------


def _literal(s: bytes) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", s).replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


class Writer:
    """Objects of a new file, or of an addition to one."""

    def __init__(self, first: int = 1, filters: tuple[str, ...] = ("FlateDecode",)):
        self.first, self.objects, self.filters = first, [], filters

    def add(self, body: bytes) -> int:
        self.objects.append(body)
        return self.first + len(self.objects) - 1

    def stream(self, data: bytes, extra: bytes = b"") -> int:
        for f in reversed(self.filters):
            data = pdf_filters.ENCODE[f](data)
        names = b" ".join(b"/" + f.encode() for f in self.filters)
        return self.add(b"<< /Length %d %s%s>>\nstream\n" % (len(data), b"/Filter [%s] " % names if names else b"", extra) + data + b"\nendstream")


def wide_font(w: Writer, chars: str, paths: tuple[str, ...] = FONT_PATHS) -> tuple[int, dict[str, bytes]]:
    """A two-byte font for the characters of a page, with their codes: the first font file there is, embedded, or a name only.

    Widths are those that lines are filled by, so that a page reads back as it was set.
    """
    face = text_font(paths)
    need = sorted(set(chars))
    codes = {c: (k + 1).to_bytes(2, "big") for k, c in enumerate(need)}
    rows = [b"<%s> <%s>" % (v.hex().encode(), c.encode("utf-16-be").hex().encode()) for c, v in codes.items()]
    body = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(rows[k : k + 100]), b"\n".join(rows[k : k + 100])) for k in range(0, len(rows), 100))
    cmap = w.stream(b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + body + b"endcmap end end")
    widths = b"1 [%s]" % b" ".join(b"%d" % L.advance(c) for c in codes)
    if face:
        name, box, up, down = face.name.encode(), face.box, face.ascent, face.descent
        part = face.subset(need)
        file = b"/FontFile2 %d 0 R " % w.stream(part, b"/Length1 %d " % len(part))
        to_glyph = b"/CIDToGIDMap /Identity "
    else:
        name, box, up, down, file, to_glyph = b"Sans", [0, -200, 1000, 900], 900, -200, b"", b""
    desc = w.add(b"<< /Type /FontDescriptor /FontName /%s /Flags 32 /FontBBox [%d %d %d %d] /ItalicAngle 0 /Ascent %d /Descent %d /CapHeight 700 /StemV 80 %s>>" % (name, *box, up, down, file))
    kid = w.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /%s /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor %d 0 R /DW 556 /W [%s] %s>>" % (name, desc, widths, to_glyph))
    return w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /%s /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (name, kid, cmap)), codes


def _show(text: str, codes: dict[str, bytes] | None) -> bytes:
    if codes is None:
        return _literal(text.encode("cp1252", "replace"))
    return b"<" + b"".join(map(codes.__getitem__, text)).hex().encode() + b">"


def set_lines(w: Writer, ls: list[str], height: float, two: bool = False, paths: tuple[str, ...] = FONT_PATHS) -> tuple[bytes, bytes]:
    """Content and resources of a page of lines. ``two``: a two-byte font even where a simple one would do."""
    text = "".join(ls)
    codes = font = None
    if not two:
        try:
            text.encode("cp1252")
            font = w.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
        except UnicodeEncodeError:
            pass
    if font is None:
        font, codes = wide_font(w, text or " ", paths)
    out = [b"BT /F1 %g Tf 0 g %g %g Td %g TL" % (L.FONT_SIZE, L.MARGIN, height - L.MARGIN - L.FONT_SIZE, L.LINE_HEIGHT)]
    out += [(_show(x, codes) + b" Tj T*" if x else b"T*") for x in ls]
    return b"\n".join([*out, b"ET"]), b"<< /Font << /F1 %d 0 R >> >>" % font


def _file(bodies: dict[int, bytes], root: int, info: int | None = None) -> bytes:
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for n in sorted(bodies):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, bodies[n])
    x, top = len(out), max(at) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % top
    out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, top))
    out += b"trailer\n<< /Size %d /Root %d 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (top, root, b"/Info %d 0 R " % info if info else b"", x)
    return bytes(out)


def build(pages: list[list[str]], width: float = L.WIDTH, height: float = L.HEIGHT, filters: tuple[str, ...] = ("FlateDecode",), two: bool = False, form: bool = False, paths: tuple[str, ...] = FONT_PATHS) -> bytes:
    """A file of pages of lines; without any page it has one empty one.

    ``filters``: how streams are packed, outermost first; ``form``: each page draws its text through a form in a form.
    """
    w = Writer(3, filters)
    kids = []
    for ls in pages or [[]]:
        content, res = set_lines(w, [x.replace("\t", "    ") for x in ls], height, two, paths)
        if form:
            for _ in range(2):
                x = w.stream(content, b"/Type /XObject /Subtype /Form /BBox [0 0 %g %g] /Resources %s " % (width, height, res))
                content, res = b"q 1 0 0 1 0 0 cm /Fm0 Do Q", b"<< /XObject << /Fm0 %d 0 R >> >>" % x
        c = w.stream(content)
        kids.append(w.add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources %s /Contents %d 0 R >>" % (width, height, res, c)))
    tree = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return _file({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: tree} | {3 + k: b for k, b in enumerate(w.objects)}, 1)


def flow(texts: list[str]) -> bytes:
    """All texts as one, over as many pages as it takes."""
    return build(L.flow_pages(L.reflow_text(texts)))


def aligned(text: str, src: list[int | None], source: str) -> list[int | None] | None:
    """The glyph of each character of ``source``, a text that may differ a little from the page's; none if under
    nine in ten of its characters are found."""
    if text == source:
        return src
    at: list[int | None] = [None] * len(source)
    found = 0
    for i, j, n in difflib.SequenceMatcher(None, text, source, autojunk=False).get_matching_blocks():
        for k in range(n):
            at[j + k] = src[i + k]
            found += src[i + k] is not None and not source[j + k].isspace()
    solid = sum(not c.isspace() for c in source)
    return at if not solid or found >= 0.9 * solid else None


def occurrences(text: str, wanted: str) -> list[range]:
    """Every place of a text where another stands, white space of any length alike; if it stands nowhere as a whole,
    the places of its lines, provided that each has one."""

    def find(t: str) -> list[range]:
        words = t.split()
        return [range(*m.span()) for m in re.finditer(r"\s+".join(map(re.escape, words)), text)] if words else []

    if hits := find(wanted):
        return hits
    lines_ = [x for x in wanted.splitlines() if x.strip()]
    each = [find(x) for x in lines_] if len(lines_) > 1 else []
    if not each or not all(each) or any(sum(map(str.isalnum, x)) == 1 for x in lines_):
        return []
    return [r for rs in each for r in rs]


Box = tuple[L.Rect, str]


def places(gs: list[Glyph], size: tuple[float, float], source: str, changes: list[dict]) -> tuple[list[int], list[Box]] | None:
    """The glyphs of the changed spans, and labelled boxes; none if they can't be told safely.

    Spans are found by their offsets; if one can't be, all are looked for by their
    text, which takes out every occurrence on the page.
    """
    text, src = page_text(gs, size[0])
    wanted = [c for c in changes if c["source_text"].strip()]
    if any(sum(map(str.isalnum, c["source_text"])) == 1 for c in wanted):
        return None
    at = aligned(text, src, source)
    spans = []  # the text that spans are told in, the glyph of each of its characters, start, end, label
    if at is not None:
        for c in wanted:
            a, b = c["source_start"], c["source_end"]
            if any(at[k] is None and not source[k].isspace() for k in range(a, b)):
                at = None
                break
            spans.append((source, at, a, b, c["label"]))
    if at is None:
        spans = []
        for c in wanted:
            hits = occurrences(text, c["source_text"])
            if not hits:
                return None
            spans += [(text, src, r.start, r.stop, c["label"]) for r in hits]
    gone, boxes = [], []
    for t, glyph, a, b, label in spans:
        gone += [glyph[k] for k in range(a, b) if glyph[k] is not None]
        rects = L.span_rects(t, [gs[k].rect if k is not None else None for k in glyph], a, b, *size)
        boxes += [(L.expand(r, *size, 0.0), label if n == 0 else "") for n, r in enumerate(rects)]
    return gone, boxes


#: Properties of marked content that repeat its text.
_REPEATS = ("ActualText", "Alt", "E")


class _Eraser:
    """Content streams without some of their glyphs; forms concerned are copied."""

    def __init__(self, pdf: Pdf, w: Writer, gone: list[Glyph]):
        self.pdf, self.w = pdf, w
        self.gone: dict[tuple, dict[int, dict[int, Glyph]]] = {}  # (path, operator) -> string -> offset -> glyph
        for g in gone:
            path, op, string = g.place
            self.gone.setdefault((path, op), {}).setdefault(string, {})[g.k] = g
        self.within = {p[:k] for p, _ in self.gone for k in range(1, len(p) + 1)}

    def string(self, s: bytes, holes: dict[int, Glyph]) -> list[bytes]:
        """The parts of a string that stay, and the room of those that go."""
        two = any(g.two for g in holes.values())
        out, at = [], 0
        put = lambda x: out.append(b"<" + x.hex().encode() + b">" if two else _literal(x)) if x else None
        for k in sorted(holes):
            put(s[at:k])
            out.append(b"%.3f" % holes[k].room)
            at = k + holes[k].n
        put(s[at:])
        return out

    def run(self, raw: bytes, res: dict, path: tuple) -> tuple[bytes, dict]:
        out, at, n, args = bytearray(), 0, -1, []
        forms: dict[Name, Ref] = {}
        copied, drawn = set(), set()
        taken = set(self.pdf.get(res.get("XObject")) or {})
        for v, span in parse(raw, ops=True):
            if not isinstance(v, Op):
                args.append((v, span))
                continue
            n += 1
            body = None
            a = [x for x, _ in args]
            if holes := self.gone.get((path, n)):
                shown = a[-1] if isinstance(a[-1], list) else [a[-1]]
                parts = []
                for k, x in enumerate(shown):
                    h = holes.get(k if v == "TJ" else -1)
                    parts += self.string(x, h) if h else [_literal(x) if isinstance(x, bytes) else b"%g" % x]
                lead = b"%g Tw %g Tc T* " % (a[-3], a[-2]) if v == '"' else b"T* " if v == "'" else b""
                body = lead + b"[" + b" ".join(parts) + b"] TJ"
            elif v == "Do" and (*path, n) in self.within:
                x = self.pdf.form(res, a[-1])
                own = self.pdf.get(x[0].get("Resources"))
                inner, inner_res = self.run(self.pdf.stream(x), own if isinstance(own, dict) else res, (*path, n))
                kept = {k: y for k, y in x[0].items() if k not in ("Length", "Filter", "DecodeParms", "Resources", "F", "DP", "StructParents", "Metadata", "PieceInfo")}
                name = next(m for k in range(len(taken) + 1) if (m := Name(f"Tl{k}")) not in taken)
                taken.add(name)
                forms[name] = Ref(self.w.stream(inner, dump(kept | {"Resources": inner_res})[2:-2]))
                body = b"/%s Do" % name.encode()
                copied.add(a[-1])
            elif v == "Do" and a:
                drawn.add(a[-1])
            elif v in ("BDC", "DP") and a and isinstance(a[-1], dict) and any(k in a[-1] for k in _REPEATS):
                body = dump(a[-2]) + b" " + dump({k: x for k, x in a[-1].items() if k not in _REPEATS}) + b" " + v.encode()
            if body is not None:
                out += raw[at : args[0][1][0] if args else span[0]] + b" " + body + b" "
                at = span[1]
            args = []
        new = dict(res)
        if forms:
            new["XObject"] = {k: x for k, x in self.pdf.get(res.get("XObject")).items() if k not in copied - drawn} | forms
        marked = self.pdf.get(res.get("Properties"))
        if isinstance(marked, dict):
            new["Properties"] = {k: {x: y for x, y in d.items() if x not in _REPEATS} if isinstance(d := self.pdf.get(p), dict) and any(x in d for x in _REPEATS) else p for k, p in marked.items()}
        return bytes(out + raw[at:]), new


def erase(pdf: Pdf, w: Writer, page: dict, source: str, changes: list[dict]) -> tuple[bytes, dict, list[Box]] | None:
    """Content and resources without the glyphs of the changed spans, and labelled boxes; none if that isn't safe."""
    gs = glyphs(pdf, page)
    found = places(gs, pdf.size(page), source, changes)
    if found is None:
        return None
    raw, res = _Eraser(pdf, w, [gs[k] for k in found[0]]).run(pdf.content(page), pdf.get(page.get("Resources")) or {}, ())
    return raw, res, found[1]


def rewrite(data: bytes, pages: list[tuple[str, str, str, list[dict]]]) -> bytes:
    """The file with each page ``(source, target, strategy, changes)`` written by its strategy.

    Only what the pages still refer to is in it, so that no erased text stays readable.
    """
    pdf = Pdf(data)
    if len(pdf.pages) != len(pages):
        raise ValueError(S.ERROR_PDF_PAGES)
    w = Writer(max([*pdf.where, *pdf.packed], default=0) + 1)
    new: dict[int, bytes] = {}
    for page, (source, target, strategy, changes) in zip(pdf.pages, pages):
        if strategy == "unchanged":
            continue
        if page["_ref"] is None:
            raise ValueError("a page that is no object")
        width, height = pdf.size(page)
        got = erase(pdf, w, page, source, [c for c in changes if c["tag"] != "insert"]) if strategy == "redact" else None
        seen = b"%.4f %.4f %.4f %.4f %.4f %.4f cm\n" % _inverse(pdf.matrix(page))  # what follows is told on the page as it is seen
        if got is None:
            ls = L.wrap(target, width - 2 * L.MARGIN)
            if len(ls) * L.LINE_HEIGHT > height - 2 * L.MARGIN:
                return flow([p[1] for p in pages])
            content, res = set_lines(w, ls, height)
            content = b"q\n" + seen + content + b"\nQ"
        else:
            raw, res_d, boxes = got
            font = w.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
            draw = []
            for (x0, y0, x1, y1), label in boxes:
                draw.append(b"1 g %.2f %.2f %.2f %.2f re f" % (x0, height - y1, x1 - x0, y1 - y0))
                if label:
                    draw.append(b"BT /TlLabel %.2f Tf 0 g %.2f %.2f Td %s Tj ET" % (L.font_size((x0, y0, x1, y1)), x0 + 0.75, height - y1 + 0.28 * (y1 - y0), _literal(label.encode("ascii"))))
            content = b"q\n" + raw + b"\nQ\nq\n" + seen + b"\n".join(draw) + b"\nQ"
            res = dump({**res_d, "Font": dict(pdf.get(res_d.get("Font")) or {}) | {Name("TlLabel"): Ref(font)}})
        c = w.stream(content)
        keep = {k: v for k, v in page.items() if k not in ("_ref", "Contents", "Resources", "PieceInfo", "Thumb")}
        new[page["_ref"]] = dump(keep)[:-2] + b"/Resources %s /Contents %d 0 R >>" % (res, c)
    added = {w.first + k: b for k, b in enumerate(w.objects)}
    root, info = pdf.root()[0], pdf.trailer.get("Info")
    bodies: dict[int, bytes] = {}
    todo = [root, *([int(info)] if isinstance(info, Ref) and pdf.get(info) is not None else [])]
    while todo:  # what is still referred to
        n = todo.pop()
        if n in bodies:
            continue
        if n in new or n in added:
            body = new.get(n) or added[n]
            refs = _REF.findall(body.split(b"stream\n", 1)[0])
            todo += [int(a) for a, _ in refs]
        else:
            v = pdf.get(Ref(n))
            if isinstance(v, tuple):
                raw = pdf.raw_stream(v)
                body = dump({**v[0], "Length": len(raw)}) + b"\nstream\n" + raw + b"\nendstream"
                todo += _refs({k: x for k, x in v[0].items() if k != "Length"})
            else:
                body = dump(v)
                todo += _refs(v)
        bodies[n] = body
    return _file(bodies, root, int(info) if isinstance(info, Ref) and int(info) in bodies else None)


def _refs(v) -> list[int]:
    if isinstance(v, Ref):
        return [int(v)]
    if isinstance(v, dict):
        return [r for x in v.values() for r in _refs(x)]
    if isinstance(v, list):
        return [r for x in v for r in _refs(x)]
    return []


def dump(v) -> bytes:
    """Bytes of an object."""
    if isinstance(v, dict):
        return b"<< " + b" ".join(dump(Name(k)) + b" " + dump(x) for k, x in v.items()) + b" >>"
    if isinstance(v, list):
        return b"[" + b" ".join(map(dump, v)) + b"]"
    if isinstance(v, Ref):
        return b"%d 0 R" % int(v)
    if isinstance(v, Name):
        return b"/" + re.sub(rb"[^!-~]|[#/()<>\[\]{}%]", lambda m: b"#%02X" % m.group()[0], v.encode("latin-1"))
    if isinstance(v, bytes):
        return _literal(v)
    if v is None or isinstance(v, bool):
        return {None: b"null", True: b"true", False: b"false"}[v]
    return repr(v).encode() if not isinstance(v, str) else v.encode("latin-1")


# ---- tables -----------------------------------------------------------------

_PAGE_PA = pa.struct([("page", pa.int32()), ("text", pa.string()), ("width", pa.float64()), ("height", pa.float64())])
PAGE = "struct<page:int,text:string,width:double,height:double>"


def read_pages(data: bytes) -> list[tuple[str, float, float]]:
    pdf = Pdf(data)
    return page_texts(pdf)


def page_texts(pdf: Pdf) -> list[tuple[str, float, float]]:
    """Text, width and height of each page."""
    return [(page_text(runs(pdf, p), pdf.size(p)[0])[0], *pdf.size(p)) for p in pdf.pages]


def documents(blobs: DataFrame) -> DataFrame:
    """Blobs ``(doc_id, content, ...)`` with ``pages array<struct<page, text, width, height>>`` and ``error``: a file that
    can't be read, or has no text, has no pages."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema.fields), f"pages array<{PAGE}>", "error string"])
    return blobs.mapInArrow(reading(blobs.columns), fields)


def reading(have: list[str]):
    """The step of ``documents`` over batches of such columns."""

    def run(batches):
        for b in L.parts(batches):
            pages, errors = [], []
            for data in b.column(have.index("content")):
                got, err = None, None
                try:
                    got = [{"page": k, "text": t, "width": w, "height": h} for k, (t, w, h) in enumerate(read_pages(data.as_py() or b""))]
                    if all(not p["text"].strip() for p in got):
                        got, err = None, S.ERROR_PDF_OCR
                except Exception:
                    err = S.ERROR_PDF
                pages.append(got)
                errors.append(err)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pages, pa.list_(_PAGE_PA)), pa.array(errors, pa.string())], names=[*have, "pages", "error"])

    return run


def page_table(docs: DataFrame) -> DataFrame:
    """Page rows of ``documents``; one with an ``error`` for a file without pages."""
    rows = docs.select("doc_id", "error", F.explode_outer("pages").alias("p"))
    return rows.select("doc_id", "p.page", F.col("p.text").alias("source_text"), "p.text", "p.width", "p.height", "error")


def pages(blobs: DataFrame) -> DataFrame:
    """``(doc_id, content)`` to page rows."""
    return page_table(documents(blobs.select("doc_id", "content")).drop("content"))


def chars(blobs: DataFrame) -> DataFrame:
    """``(doc_id, content)`` to glyph rows with their block, line and rectangle; unreadable files give none."""
    kind = pa.schema([("doc_id", pa.string()), *((c, pa.int32()) for c in ("page", "block", "line", "ord")), ("c", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))])

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                try:
                    pdf = Pdf(data.as_py() or b"")
                    for n, p in enumerate(pdf.pages):
                        gs = glyphs(pdf, p)
                        for i, block in enumerate(blocks(gs)):
                            for j, line in enumerate(block):
                                rows += [(doc, n, i, j, o, gs[k].c, *gs[k].rect) for o, k in enumerate(line)]
                except Exception:
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return blobs.select("doc_id", "content").mapInArrow(run, S.PDF_CHAR)


def segments(page_rows: DataFrame) -> DataFrame:
    """Segments of the pages that aren't blank; pages keep their numbers."""
    from textloom.functions.text import is_blank

    shown = page_rows.filter(F.col("text").isNotNull() & ~is_blank("text"))
    none = F.lit(None)
    return shown.select(
        "doc_id", F.concat(F.lit("p"), F.col("page").cast("string")).alias("id"), "text", F.concat(F.lit("page:"), F.col("page").cast("string")).alias("part"), F.col("page").alias("index"),
        none.cast("string").alias("container_id"), none.cast("int").alias("paragraph_index"), none.cast("array<int>").alias("run_indices"),
    )


def write(docs: DataFrame, paths: tuple[str, ...] = FONT_PATHS) -> DataFrame:
    """``data`` and ``error`` in place of ``content`` and ``edited``, for rows ``(doc_id, content, edited, ...)``.

    ``edited``: each page as ``struct<page, source_text, text, strategy, ops>``. A file none of
    whose pages changed comes out as its own bytes; a document without a file is set anew
    from its texts, each over as many pages as it takes. Rows without pages give no data.
    """
    have = [c for c in docs.columns if c not in ("content", "edited")]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in have), "data binary", "save_error string"])
    return docs.mapInArrow(writing(docs.columns, paths), fields)


def writing(ins: list[str], paths: tuple[str, ...] = FONT_PATHS):
    """The step of ``write`` over batches of such columns."""
    have = [c for c in ins if c not in ("content", "edited")]

    def run(batches):
        for b in L.parts(batches):
            out, errors = [], []
            for data, ps in zip(b.column(ins.index("content")), b.column(ins.index("edited")).to_pylist()):
                data, got, err = data.as_py(), None, None
                try:
                    if ps is None:
                        got = None
                    elif data and all(p["strategy"] == "unchanged" for p in ps):
                        got = data
                    elif not data:
                        got = build([ls for p in ps for ls in L.flow_pages(p["text"] or "")], paths=paths)
                    elif any(p["strategy"] == "reflow" for p in ps):
                        got = flow([p["text"] for p in ps])
                    else:
                        got = rewrite(data, [(p["source_text"], p["text"], p["strategy"], p["ops"] or []) for p in ps])
                except Exception as e:
                    err = str(e) if str(e) == S.ERROR_PDF_PAGES else S.ERROR_PDF_SAVE
                out.append(got)
                errors.append(err)
            yield pa.RecordBatch.from_arrays([*(b.column(ins.index(c)) for c in have), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[*have, "data", "save_error"])

    return run
