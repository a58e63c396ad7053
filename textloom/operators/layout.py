"""Page geometry: wrapping, pages, soft wraps, and rectangles of spans.

These rules are used where pages are parsed and written, in Arrow batches, and
there only; the table functions at the end apply the same functions to columns.
Rectangles are tuples ``(x0, y0, x1, y1)`` from the top left of the page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# The page that texts are set on, in points.
WIDTH, HEIGHT, MARGIN, FONT_SIZE, LINE_HEIGHT = 595.0, 842.0, 48.0, 10.0, 12.5
LINES_PER_PAGE = 58

#: Advance widths of Helvetica for the codes 32 to 126, in thousandths of the size.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
DEFAULT_WIDTH = 556
Rect = tuple[float, float, float, float]


def advance(c: str) -> int:
    """Advance of a character; one that the table lacks is as wide as a digit, a wide East Asian one a full square."""
    o = ord(c)
    return HELVETICA[o - 32] if 32 <= o <= 126 else 1000 if 0x2E80 <= o <= 0xFFDC else DEFAULT_WIDTH


_ADVANCE = {chr(k): advance(chr(k)) for k in range(0x3000)}


@lru_cache(100_000)
def text_width(text: str) -> int:
    """Sum of the advances, in thousandths of the size. Words repeat, so most are looked up."""
    get = _ADVANCE.get
    return sum([get(c) or advance(c) for c in text])


def split_word(word: str, most: int) -> list[str]:
    """Pieces of a word that is wider than a line, at least one character each."""
    out, now, width = [], "", 0
    for c in word:
        w = advance(c)
        if now and width + w > most:
            out.append(now)
            now, width = "", 0
        now, width = now + c, width + w
    return [*out, now]


def wrap_line(line: str, width: float = WIDTH - 2 * MARGIN, size: float = FONT_SIZE) -> list[str]:
    """Lines of at most a width, filled greedily; a blank line is one empty line. The tail of a cut word goes on as a line."""
    most = int(width * 1000 / size)
    space = HELVETICA[0]
    out: list[str] = []
    now: list[str] = []
    used = 0
    for word in line.split():
        w = text_width(word)
        if now and used + space + w <= most:
            now.append(word)
            used += space + w
            continue
        if now:
            out.append(" ".join(now))
        if w > most:
            *whole, word = split_word(word, most)
            out += whole
            w = text_width(word)
        now, used = [word], w
    return [*out, " ".join(now)]


def wrap(text: str, width: float = WIDTH - 2 * MARGIN) -> list[str]:
    """Lines of a text; blank ones stay."""
    return [x for line in text.split("\n") for x in wrap_line(line, width)]


def flow_pages(text: str) -> list[list[str]]:
    """Pages of lines that a text flows over: a form feed begins a page, every page holds ``LINES_PER_PAGE`` lines."""
    out = []
    for section in text.replace("\r\n", "\n").replace("\r", "\n").split("\f"):
        ls = wrap(section)
        out += [ls[k : k + LINES_PER_PAGE] for k in range(0, len(ls), LINES_PER_PAGE)]
    return out


def reflow_text(texts: list[str]) -> str:
    """The pages of a document joined by line ends, their own last ones trimmed."""
    return "\n".join(t.rstrip("\n") for t in texts)


def fits_page(text: str, width: float = WIDTH, height: float = HEIGHT) -> bool:
    """Whether a text, wrapped, fits the box of its page."""
    n = 0
    for line in text.split("\n"):
        n += len(wrap_line(line, width - 2 * MARGIN))
        if n * LINE_HEIGHT > height - 2 * MARGIN:
            return False
    return True


def soft_wrapped(text: str, x0: float, x1: float, next_x0: float, width: float) -> bool:
    """Whether a line from ``x0`` to ``x1`` goes on in the next one."""
    t = text.rstrip()
    return bool(t) and t[-1] not in ".!?:;" and (x1 >= width - 12 or abs(x0 - next_x0) <= 24 and x1 - x0 >= 0.72 * width)


def same_line(a: Rect, b: Rect) -> bool:
    tol = max(2.0, 0.45 * min(a[3] - a[1], b[3] - b[1]))
    return abs(a[1] - b[1]) <= tol or abs(a[3] - b[3]) <= tol


def expand(r: Rect, width: float, height: float, by: float = 0.75) -> Rect:
    """A rectangle grown on every side, inside the page."""
    return max(0.0, r[0] - by), max(0.0, r[1] - by), min(width, r[2] + by), min(height, r[3] + by)


def merge_lines(rects: list[Rect], width: float, height: float) -> list[Rect]:
    """Rectangles joined line by line, in reading order; each is compared with the grown rectangle before it."""
    out: list[Rect] = []
    for r in sorted(rects, key=lambda r: (round(r[1], 1), r[0])):
        if out and same_line(out[-1], r):
            a = out[-1]
            out[-1] = min(a[0], r[0]), min(a[1], r[1]), max(a[2], r[2]), max(a[3], r[3])
        else:
            out.append(r)
    return [expand(r, width, height) for r in out]


def span_rects(text: str, rects: list[Rect | None], start: int, end: int, width: float, height: float) -> list[Rect]:
    """Merged rectangles of a span, given one for each character; white space has none and is passed over. A span with any
    other character unplaced gives none."""
    solid = [r for c, r in zip(text[start:end], rects[start:end]) if not c.isspace()]
    return [] if any(r is None for r in solid) else merge_lines(solid, width, height)


def font_size(r: Rect) -> float:
    return max(5.0, min(10.0, 0.7 * (r[3] - r[1])))


# ---- tables -----------------------------------------------------------------


#: Rows that are made at a time: what is made of a row may be many times larger than the row.
_AT_A_TIME = 256


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so few rows that what is made of them stays small."""
    for b in batches:
        for k in range(0, b.num_rows, _AT_A_TIME):
            yield b.slice(k, _AT_A_TIME)


def column_step(name: str, kind: pa.DataType, fn: Callable, *columns: str) -> Callable:
    """The step of ``with_column`` over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            values = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns))
            new = pa.array([None if any(v is None for v in vs) else fn(*vs) for vs in values], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=[*b.schema.names, name])

    return run


def with_column(df: DataFrame, name: str, ddl: str, kind: pa.DataType, fn: Callable, *columns: str) -> DataFrame:
    """``df`` with a column made row by row in Arrow batches; ``fn`` takes the values of ``columns``, null where one is null."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` {ddl}"])
    return df.mapInArrow(column_step(name, kind, fn, *columns), fields)


RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
RECT_PA = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])


def merged_boxes(df: DataFrame, rects: str, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """``boxes`` of a column of rectangles, with the label size each takes."""
    kind = pa.list_(pa.struct([*((k, pa.float64()) for k in ("x0", "y0", "x1", "y1")), ("size", pa.float64())]))

    def merge(rs: list[dict]) -> list[dict]:
        got = merge_lines([(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rs], width, height)
        return [{**dict(zip(("x0", "y0", "x1", "y1"), r)), "size": font_size(r)} for r in got]

    return with_column(df, "boxes", "array<struct<x0:double,y0:double,x1:double,y1:double,size:double>>", kind, merge, rects)


def flowed(df: DataFrame, text: str) -> DataFrame:
    """``pages array<array<string>>``: the lines of each page that a text flows over."""
    return with_column(df, "pages", "array<array<string>>", pa.list_(pa.list_(pa.string())), flow_pages, text)
