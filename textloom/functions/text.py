"""Column expressions over names, bytes and texts. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import schema as S

#: White space as Python's str.isspace sees it, for Java's regular expressions.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(c), f"{SPACE}+", " "))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def suffix(filename: Column | str) -> Column:
    """The last dotted part of the base name, in small letters; '' if there is none or the name starts with its only dot."""
    base = F.element_at(F.split(F.coalesce(col(filename), F.lit("")), "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def stem(filename: Column | str) -> Column:
    base = F.element_at(F.filter(F.split(col(filename), "/"), lambda x: x != ""), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def normalize_mime(content_type: Column | str) -> Column:
    return F.lower(strip(F.element_at(F.split(F.coalesce(col(content_type), F.lit("")), ";"), 1)))


def _mime_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in S.TEXT_MIME_BY_EXTENSION.items() for x in kv])


def text_extension(sfx: Column) -> Column:
    return F.when(sfx.isin(list(S.TEXT_MIME_BY_EXTENSION)), sfx).otherwise(".txt")


def text_content_type(sfx: Column, content_type: Column | str) -> Column:
    ct = col(content_type)
    return F.coalesce(F.element_at(_mime_map(), sfx), F.when(normalize_mime(ct).startswith("text/"), ct), F.lit(S.TXT_MIME))


def output_extension(filename: Column | str) -> Column:
    return text_extension(suffix(filename))


def output_filename(filename: Column | str, extension: Column | str, infix: str = S.OUTPUT_INFIX) -> Column:
    """A safe name for the result: ``{stem}.{infix}.{extension}``."""
    base = stem(F.coalesce(F.nullif(col(filename), F.lit("")), F.lit("document")))
    safe = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("document")), F.lit(f".{infix}."), F.regexp_replace(col(extension) if not isinstance(extension, str) else F.lit(extension), r"^\.+", ""))


def is_pdf(content: Column | str) -> Column:
    return F.startswith(col(content), F.expr("X'255044462D'"))


def is_zip(content: Column | str) -> Column:
    return F.startswith(col(content), F.expr("X'504B'"))


def _number(b: Column, at: int) -> Column:
    """Four bytes from the 1-based place ``at`` as a number, the low byte first; null for 0xFFFFFFFF, which says that the number is elsewhere."""
    h = F.concat(*(F.hex(F.substring(b, at + k, 1)) for k in (3, 2, 1, 0)))
    return F.nullif(F.conv(h, 16, 10).cast("bigint"), F.lit(0xFFFFFFFF))


def has_entries(content: Column | str, *names: str) -> Column:
    """Whether bytes are a zip package with all of these entries, told by its table of contents. Stays on the JVM."""
    b = col(content)

    def listed(end: Column) -> Column:
        size, start = _number(end, 13), _number(end, 17)
        table = F.coalesce(F.substring(b, (start + 1).cast("int"), size.cast("int")), b)
        return let(F.decode(table, "ISO-8859-1"), _all)

    def _all(t: Column) -> Column:
        out = F.lit(True)
        for n in names:
            size = len(n)
            out = out & t.rlike(rf"(?s)PK\x01\x02.{{24}}\x{size & 255:02x}\x{size >> 8:02x}.{{16}}\Q{n}\E")
        return out

    plain_end = F.substring(b, -22, 22)
    tail = F.decode(F.substring(b, -65557, 65557), "ISO-8859-1")
    late = F.encode(F.regexp_extract(tail, r"(?s).*(PK\x05\x06.{18}).*", 1), "ISO-8859-1")  # a comment stands behind it
    end = F.when(F.startswith(plain_end, F.expr("X'504B0506'")), plain_end).otherwise(late)
    return F.when(is_zip(b) & (F.octet_length(b) >= 22), let(end, lambda e: F.when(F.octet_length(e) == 22, listed(e)).otherwise(False))).otherwise(False)


#: What the upper half of code page 1250 holds, from 0x80; the five undefined bytes are spaces.
_CP1250 = (
    "€ ‚ „…†‡ ‰Š‹ŚŤŽŹ ‘’“”•–— ™š›śťžź"
    " ˇ˘Ł¤Ą¦§¨©Ş«¬­®Ż°±˛ł´µ¶·¸ąş»Ľ˝ľż"
    "ŔÁÂĂÄĹĆÇČÉĘËĚÍÎĎĐŃŇÓÔŐÖ×ŘŮÚŰÜÝŢß"
    "ŕáâăäĺćçčéęëěíîďđńňóôőö÷řůúűüýţ˙"
)
_CP1250_FROM = "".join(chr(0x80 + k) for k in range(128) if k not in (1, 3, 8, 16, 24))
_CP1250_TO = "".join(c for k, c in enumerate(_CP1250) if k not in (1, 3, 8, 16, 24))


def _cp1250_ok(latin: Column) -> Column:
    return ~latin.rlike(r"[\x{81}\x{83}\x{88}\x{90}\x{98}]")


def decode_single_byte(content: Column) -> Column:
    """Code page 1250 where every byte is defined in it, else Latin-1 (which never fails)."""
    latin = F.decode(content, "ISO-8859-1")
    return F.when(_cp1250_ok(latin), F.translate(latin, _CP1250_FROM, _CP1250_TO)).otherwise(latin)


def _utf16(content: Column) -> Column:
    """UTF-16 with its mark, or null where it is not valid: odd length or a lone half of a pair.

    A half of a pair has a byte of 0xD8 to 0xDF; only where such a byte occurs are the units looked at one by one.
    """
    little = F.startswith(content, F.expr("X'FFFE'"))
    body = F.substring(content, 3, 1 << 30)

    def lone(hx: Column) -> Column:
        units = F.regexp_replace(hx, "(.{4})", "$1,")
        big = F.when(little, F.regexp_replace(units, "(..)(..),", "$2$1,")).otherwise(units)
        return let(big, lambda x: x.rlike("(?:^|,)D[89AB]..(?!,D[C-F]..)|(?:^|(?<!D[89AB]..),)D[C-F]..,") | x.rlike("^D[C-F]"))

    halves = F.decode(body, "ISO-8859-1").rlike(r"[\x{d8}-\x{df}]")
    ok = (F.octet_length(content) % 2 == 0) & ~F.when(halves, lone(F.hex(body))).otherwise(False)
    return F.when(ok, F.when(little, F.decode(body, "UTF-16LE")).otherwise(F.decode(body, "UTF-16BE")))


def decode_text(content: Column | str) -> Column:
    """Text of unknown encoding: UTF-16 by its mark, UTF-8 (a mark is dropped), code page 1250, Latin-1."""

    def single(b: Column) -> Column:
        return let(F.decode(b, "ISO-8859-1"), lambda x: F.when(_cp1250_ok(x), F.translate(x, _CP1250_FROM, _CP1250_TO)).otherwise(x))

    b = col(content)
    marked = F.startswith(b, F.expr("X'FFFE'")) | F.startswith(b, F.expr("X'FEFF'"))
    utf8 = let(b.cast("string"), lambda s: F.when(F.is_valid_utf8(s), F.when(s.startswith("\ufeff"), F.substring(s, F.lit(2), F.length(s))).otherwise(s)))
    return F.coalesce(F.when(marked, _utf16(b)), utf8, single(b))


#: Characters that print: letters, marks, numbers, punctuation, symbols and the plain space; and line ends and tabs.
_NO_PRINT = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \r\n\t]"


def printable_ratio(text: Column | str) -> Column:
    """Share of printable characters; null for an empty text."""
    t = col(text)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, _NO_PRINT, "")) / F.length(t))


def looks_like_text(content: Column | str) -> Column:
    """Whether the first bytes read as text: no NUL, and nearly all characters print."""
    b = F.substring(col(content), 1, S.SNIFF_BYTES)
    s = b.cast("string")
    latin = F.decode(b, "ISO-8859-1")
    utf8 = F.is_valid_utf8(s)
    share = F.when(utf8, printable_ratio(F.regexp_replace(s, "^\\x{feff}", ""))).otherwise(printable_ratio(decode_single_byte(b)))
    least = F.when(utf8 | _cp1250_ok(latin), 0.9).otherwise(0.95)
    return ~F.contains(b, F.expr("X'00'")) & F.coalesce(share >= least, F.lit(False))


#: What marks a text as redacted.
LABEL_PATTERN = "\\[[A-ZĄĆĘŁŃÓŚŹŻ][A-ZĄĆĘŁŃÓŚŹŻ0-9_]*\\]"


def looks_like_redaction(text: Column | str) -> Column:
    t = col(text)
    return t.contains("****") | (t.contains("<") & t.contains(">")) | t.rlike(LABEL_PATTERN)


def requires_reflow(source: Column, replacement: Column, redaction: Column) -> Column:
    """Whether a replacement may not fit where its source stood."""
    a, b = collapse(source), collapse(replacement)
    return ~redaction & (b != "") & ((F.length(b) > F.length(a)) | b.rlike(r"[^\x00-\x7F]") | (replacement.contains("\n") & ~source.contains("\n")))


def redaction_label(text: Column | str) -> Column:
    """The label drawn over a redacted place: at most 64 ASCII characters, else asterisks."""
    t = collapse(text)
    return F.when(t == "", "").when((F.length(t) > 64) | t.rlike(r"[^\x00-\x7F]"), "****").otherwise(t)


def unsafe_short_source(text: Column | str) -> Column:
    """A single letter or digit: too short to be looked for safely."""
    return F.length(F.regexp_replace(col(text), r"[^\p{L}\p{N}]", "")) == 1


def search_candidates(text: Column | str) -> Column:
    t = col(text)
    return F.filter(F.array_distinct(F.array(strip(t), collapse(t))), lambda x: x != "")
