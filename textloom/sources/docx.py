"""Word packages: paragraphs out of bytes, edits back into bytes.

A package is read with the standard library only. Every paragraph of the body,
of body tables, of each section's header and footer and of text boxes becomes a
row with its address, its runs and its inline pieces; ids are given while the
package is read, so that reading needs no shuffle. Writing changes the affected
paragraphs of the parts concerned and copies every other entry byte for byte.

Rules where formats leave room: a merged table cell counts once, at its first
grid column; a header or footer that a section inherits is listed again under
that section; a missing one is not made up; both copies of a box that a document
carries twice are listed. Packages with document type declarations, with parts
beyond ``MAX_PART`` bytes or ``MAX_RATIO`` times their packed size are refused.
Nested tables, tables in boxes, notes and comments are not read.

An edit counts in the visible text. One that would replace text inside an opaque
piece (a link, a content control) fails its document instead of leaving that text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.dom import minidom

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import schema as S

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAX_PART, MAX_RATIO = 200_000_000, 400
_BOXES = {"txbxContent", "textbox", "txbx"}
BODY, TABLE, STORY, BOX = 0, 1, 2, 3


class Unreadable(ValueError):
    pass


def _kids(node):
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE]


def _is(node, name: str) -> bool:
    return node.localName == name and node.namespaceURI == W


def _attr(node, name: str, ns: str = W) -> str:
    return node.getAttributeNS(ns, name)


def _own_text(node) -> str:
    return "".join(c.data for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE))


def _descend(node):
    for c in _kids(node):
        yield c
        yield from _descend(c)


class Package:
    """A read package: its entries, and the parts that were parsed."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = self.zip.namelist()
            if "word/document.xml" not in self.names:
                raise Unreadable("no main part")
            self.doms: dict[str, minidom.Document] = {}
            self.main = self.dom("word/document.xml")
        except Unreadable:
            raise
        except Exception as e:
            raise Unreadable(str(e)) from e

    def read(self, name: str) -> bytes:
        info = self.zip.getinfo(name)
        if info.file_size > MAX_PART or info.file_size > MAX_RATIO * max(1024, info.compress_size):
            raise Unreadable("part too large")
        return self.zip.read(name)

    def dom(self, name: str) -> minidom.Document:
        if name not in self.doms:
            raw = self.read(name)
            if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                raise Unreadable("document type declaration")
            self.doms[name] = minidom.parseString(raw)
        return self.doms[name]

    def targets(self) -> dict[str, str]:
        name = "word/_rels/document.xml.rels"
        if name not in self.names:
            return {}
        out = {}
        for r in _kids(self.dom(name).documentElement):
            t = r.getAttribute("Target")
            out[r.getAttribute("Id")] = t.lstrip("/") if t.startswith("/") else f"word/{t}"
        return out

    def stories(self) -> Iterator[tuple[int, int, int, int, str, str, object]]:
        """``(rank, i1, i2, i3, prefix, part label, container)`` in reading order."""
        body = next(c for c in _kids(self.main.documentElement) if _is(c, "body"))
        yield BODY, 0, 0, 0, "body", "word/document.xml", body
        tables = [c for c in _kids(body) if _is(c, "tbl")]
        for t, tbl in enumerate(tables):
            for r, tr in enumerate(c for c in _kids(tbl) if _is(c, "tr")):
                at = 0
                for tc in (c for c in _kids(tr) if _is(c, "tc")):
                    props = [p for pr in _kids(tc) if _is(pr, "tcPr") for p in _kids(pr)]
                    span = next((int(_attr(p, "val") or 1) for p in props if _is(p, "gridSpan")), 1)
                    goes_on = any(_is(p, "vMerge") and _attr(p, "val") != "restart" for p in props)
                    if not goes_on:
                        yield TABLE, t, r, at, f"table:{t}:r:{r}:c:{at}", "word/document.xml", tc
                    at += span
        rels = self.targets()
        sections = [s for p in _kids(body) if _is(p, "p") for pr in _kids(p) if _is(pr, "pPr") for s in _kids(pr) if _is(s, "sectPr")] + [s for s in _kids(body) if _is(s, "sectPr")]
        held = {"header": None, "footer": None}
        for n, s in enumerate(sections):
            for k, what in enumerate(("header", "footer")):
                for ref in _kids(s):
                    if _is(ref, f"{what}Reference") and _attr(ref, "type") in ("default", ""):
                        held[what] = rels.get(ref.getAttributeNS(R, "id"))
                if held[what] in self.names:
                    yield STORY, n, k, 0, f"{what}:{n}", f"word/{what}.xml", self.dom(held[what]).documentElement
        for n, host in enumerate(self.boxes()):
            yield BOX, n, 0, 0, f"txbx:{n}", "word/document.xml", host

    def boxes(self) -> list:
        """Hosts of text-box paragraphs that hold some text, in document order, each once."""
        out, done = [], set()  # of identities; the tree keeps its nodes alive
        for node in _descend(self.main.documentElement):
            if node.localName not in _BOXES or id(node) in done:
                continue
            host = node
            if node.localName != "txbxContent":
                host = next((c for c in _descend(node) if c.localName == "txbxContent"), node)
                if id(host) in done:
                    continue
            done.add(id(host))
            if any(c.localName == "t" and _own_text(c).strip() for c in [host, *_descend(host)]):
                out.append(host)
        return out


def paragraphs_of(container, skip_boxes: bool) -> list:
    """Paragraphs of a container in order, those of content controls too; boxes and tables are other stories."""
    out = []
    for c in _kids(container):
        if skip_boxes and c.localName in _BOXES:
            continue
        if _is(c, "p"):
            out.append(c)
        elif _is(c, "sdt"):
            for x in _kids(c):
                if _is(x, "sdtContent"):
                    out += paragraphs_of(x, skip_boxes)
    return out


def _width(node) -> str:
    return "\t" if _is(node, "tab") else "\n" if _is(node, "br") or _is(node, "cr") else ""


def visible(node) -> str:
    """Characters that an opaque element shows; nested boxes are left out."""
    out = [_own_text(node) if _is(node, "t") else _width(node)]
    out += [visible(c) for c in _kids(node) if c.localName not in _BOXES]
    return "".join(out)


def _run_with(doc, rpr, child):
    run = doc.createElementNS(W, _prefix(child, "r"))
    if rpr is not None:
        run.appendChild(rpr.cloneNode(True))
    run.appendChild(child.cloneNode(True))
    return run


def _prefix(node, name: str) -> str:
    p = node.prefix if node.namespaceURI == W else "w"
    return f"{p}:{name}" if p else name


def inline(p) -> list[tuple[str, str, object, object]]:
    """Pieces ``(kind, text, rpr, element)`` of a paragraph."""
    out = []
    for c in _kids(p):
        if _is(c, "pPr"):
            continue
        if not _is(c, "r"):
            out.append(("opaque", visible(c), None, c))
            continue
        rpr = next((x for x in _kids(c) if _is(x, "rPr")), None)
        for x in _kids(c):
            if _is(x, "rPr"):
                continue
            if _is(x, "t"):
                if t := _own_text(x):
                    out.append(("text", t, rpr, None))
                continue
            boxed = x.localName in _BOXES or any(d.localName in _BOXES for d in _descend(x))
            out.append(("opaque", "" if boxed else _width(x), None, _run_with(p.ownerDocument, rpr, x)))
    return out


def runs(p) -> list[dict]:
    out = []
    for k, r in enumerate(c for c in _kids(p) if _is(c, "r")):
        rpr = next((x for x in _kids(r) if _is(x, "rPr")), None)
        out.append({"idx": k, "text": "".join(_own_text(x) if _is(x, "t") else _width(x) for x in _kids(r)), "rpr": rpr.toxml() if rpr is not None else None})
    return out


def read_paragraphs(data: bytes) -> list[dict]:
    """Rows of the paragraphs of a package, in reading order, empty ones included."""
    pkg = Package(data)
    out: list[dict] = []
    shown = 0
    for rank, i1, i2, i3, prefix, part, container in pkg.stories():
        for k, p in enumerate(paragraphs_of(container, rank != BOX)):
            pieces = inline(p)
            text = "".join(t for _, t, _, _ in pieces)
            shown += text != ""
            out.append({
                "story_rank": rank, "i1": i1, "i2": i2, "i3": i3, "local_idx": k, "paragraph_index": len(out), "segment_no": shown - 1 if text else None, "container_id": f"{prefix}:p:{k}", "part": part,
                "visible_text": text, "runs": runs(p),
                "inline": [{"kind": kind, "text": t, "rpr": r.toxml() if r is not None else None, "element": e.toxml() if e is not None else None} for kind, t, r, e in pieces],
            })
    return out


# ---- writing ----------------------------------------------------------------


def replace_range(pieces: list, start: int, end: int, text: str) -> list:
    """The same rule as the array expression, on pieces; raises where opaque text would be touched."""
    n = sum(len(t) for _, t, _, _ in pieces)
    if not 0 <= start < end <= n:
        raise ValueError("invalid offsets")
    out, at, put = [], 0, False
    for kind, t, rpr, el in pieces:
        a, b = at, at + len(t)
        at = b
        if kind == "opaque" or b <= start or a >= end or not t:
            if kind == "opaque" and t and a < end and b > start:
                raise ValueError("edit touches opaque text")
            out.append((kind, t, rpr, el))
            continue
        lo, hi = max(start, a) - a, min(end, b) - a
        if lo:
            out.append((kind, t[:lo], rpr, el))
        if not put:
            put = True
            if text:
                out.append(("text", text, rpr, None))
        if hi < len(t):
            out.append((kind, t[hi:], rpr, el))
    if not put:
        raise ValueError("no run is affected")
    return out


def replace_all(pieces: list, text: str) -> list:
    """Whole text replaced: it takes the formatting of the first text; tabs and breaks go, other opaque text fails."""
    for kind, t, _, el in pieces:
        if kind == "opaque" and t.strip("\t\n"):
            raise ValueError("edit touches opaque text")
    first = next((rpr for kind, _, rpr, _ in pieces if kind == "text"), None)
    kept = [x for x in pieces if x[0] == "opaque" and not x[1]]
    return ([("text", text, first, None)] if text else []) + kept


def rebuild(p, pieces: list) -> None:
    """The children of a paragraph, its properties aside, made anew from pieces."""
    doc = p.ownerDocument
    clones = [(k, t, r.cloneNode(True) if r is not None else None, e.cloneNode(True) if e is not None else None) for k, t, r, e in pieces]
    for c in list(p.childNodes):
        if not (c.nodeType == c.ELEMENT_NODE and _is(c, "pPr")):
            p.removeChild(c)
    for kind, text, rpr, el in clones:
        if kind == "opaque":
            if el is not None:
                p.appendChild(el)
            continue
        if not text:
            continue
        run = doc.createElementNS(W, _prefix(p, "r"))
        if rpr is not None:
            run.appendChild(rpr)
        t = doc.createElementNS(W, _prefix(p, "t"))
        if text[:1].isspace() or text[-1:].isspace():
            t.setAttribute("xml:space", "preserve")
        t.appendChild(doc.createTextNode(text))
        run.appendChild(t)
        p.appendChild(run)


def write_edits(data: bytes, edits: list[dict], strict: bool = False) -> bytes:
    """The package after ordered edits; raises ``ValueError`` where one cannot be made."""
    pkg = Package(data)
    place, ids, n = {}, {}, 0
    for rank, _, _, _, prefix, _, container in pkg.stories():
        for k, p in enumerate(paragraphs_of(container, rank != BOX)):
            cid = f"{prefix}:p:{k}"
            pieces = inline(p)
            place[cid] = [p, pieces, False]
            if any(t for _, t, _, _ in pieces):
                ids[f"s{n}"] = cid
                n += 1
    named = set(ids.values())
    twins: dict[int, list] = {}  # an inherited header is listed more than once
    for slot in place.values():
        twins.setdefault(id(slot[0]), []).append(slot)
    for e in edits:
        cid = e["container_id"] or ids.get(e["id"] or "")
        if cid not in named:
            if strict:
                raise ValueError("unknown edit target")
            continue
        slot = place[cid]
        pieces, text = slot[1], e["text"] or ""
        total = sum(len(t) for _, t, _, _ in pieces)
        a = e["start_offset"]
        b = e["end_offset"]
        whole = a is None and b is None or (a or 0) == 0 and b in (None, total) and total
        new = replace_all(pieces, text) if whole else replace_range(pieces, a or 0, total if b is None else b, text)
        for s in twins[id(slot[0])]:
            s[1], s[2] = new, True
    if not any(s[2] for s in place.values()):
        return data
    for p, pieces, changed in place.values():
        if changed:
            rebuild(p, pieces)
    touched = {id(s[0].ownerDocument) for s in place.values() if s[2]}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info in pkg.zip.infolist():
            dom = pkg.doms.get(info.filename)
            if dom is not None and id(dom) in touched:
                body = dom.documentElement.toxml().encode("utf-8")
                z.writestr(info, b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + body)
            else:
                z.writestr(info, pkg.zip.read(info.filename), compress_type=info.compress_type)
    return out.getvalue()


# ---- tables -----------------------------------------------------------------

_RUN_PA = pa.struct([("idx", pa.int32()), ("text", pa.string()), ("rpr", pa.string())])
_INLINE_PA = pa.struct([("kind", pa.string()), ("text", pa.string()), ("rpr", pa.string()), ("element", pa.string())])
_SCHEMA_PA = pa.schema([("doc_id", pa.string()), *((c, pa.int32()) for c in ("story_rank", "i1", "i2", "i3", "local_idx", "paragraph_index", "segment_no")), ("container_id", pa.string()), ("part", pa.string()), ("visible_text", pa.string()), ("runs", pa.list_(_RUN_PA)), ("inline", pa.list_(_INLINE_PA)), ("error", pa.string())])


def paragraphs(blobs: DataFrame) -> DataFrame:
    """``(doc_id, content)`` to paragraph rows; an unreadable package gives one row with an ``error``."""

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows = read_paragraphs(data.as_py() or b"")
                except Exception:
                    rows = [{"error": S.ERROR_DOCX}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "error": None, **r} for r in rows], schema=_SCHEMA_PA)

    return blobs.select("doc_id", "content").mapInArrow(run, S.PARAGRAPH)


def segments(par: DataFrame) -> DataFrame:
    """Segments of paragraphs that show some text, with the ids that the reader gave them in reading order."""
    used = F.transform(F.filter("runs", lambda r: r["text"] != ""), lambda r: r["idx"])
    return par.filter("segment_no IS NOT NULL").select(
        "doc_id", F.concat(F.lit("s"), F.col("segment_no").cast("string")).alias("id"), F.col("visible_text").alias("text"), "part",
        F.col("local_idx").alias("index"), "container_id", "paragraph_index", used.alias("run_indices"),
    )


def resolve(par: DataFrame, wanted: DataFrame, by: str = "container_id") -> DataFrame:
    """Paragraphs for ``wanted (doc_id, container_id)`` or ``(doc_id, paragraph_index)``; null where there is none."""
    return wanted.select("doc_id", by).join(par, ["doc_id", by], "left")


def inline_pieces(par: DataFrame, wanted: DataFrame) -> DataFrame:
    """``inline`` of the wanted paragraphs, an empty array for unknown ones."""
    return resolve(par, wanted).select("doc_id", "container_id", F.coalesce("inline", F.array().cast(f"array<{S.INLINE}>")).alias("inline"))


def indexed_paragraphs(par: DataFrame) -> DataFrame:
    return par.filter("error IS NULL").select("doc_id", "paragraph_index", "container_id", "visible_text")


def write(blobs: DataFrame, edits: DataFrame, strict: bool = False) -> DataFrame:
    """Blobs ``(doc_id, content, ...)`` with ``data`` and ``error`` in place of ``content``: packages after their edits. Only edits are
    shuffled beside their package."""
    e = F.struct("seq", "container_id", "id", "text", "start_offset", "end_offset")
    grouped = edits.groupBy("doc_id").agg(F.array_sort(F.collect_set(e)).alias("_edits"))
    joined = blobs.join(grouped, "doc_id", "left")
    have, ins = [c for c in blobs.columns if c != "content"], joined.columns
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema.fields if f.name != "content"), "data binary, error string"])

    def run(batches):
        for b in batches:
            out, errors = [], []
            for data, es in zip(b.column(ins.index("content")), b.column(ins.index("_edits")).to_pylist()):
                got, err = None, None
                try:
                    got = write_edits(data.as_py() or b"", es or [], strict)
                except Unreadable:
                    err = S.ERROR_DOCX
                except ValueError as x:
                    err = str(x)
                out.append(got)
                errors.append(err)
            yield pa.RecordBatch.from_arrays([*(b.column(ins.index(c)) for c in have), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[*have, "data", "error"])

    return joined.mapInArrow(run, fields)


# ---- small packages, for tests and for texts that become documents -----------

_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_BAD_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def make_package(body: str, extra: dict[str, str] | None = None, rels: str = "") -> bytes:
    """A package of a body's mark-up, of further parts, and of relations of the main part."""
    doc = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document xmlns:w="{W}" xmlns:r="{R}" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"><w:body>{body}</w:body></w:document>'
    parts = {"[Content_Types].xml": _TYPES, "_rels/.rels": _RELS, "word/document.xml": doc, **(extra or {})}
    if rels:
        parts["word/_rels/document.xml.rels"] = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text.encode("utf-8"), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def escape(text: str) -> str:
    """A text as mark-up; characters that XML has not are left out."""
    return _BAD_XML.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def package_of_text(text: str) -> bytes:
    """A package with a paragraph for each line of a text."""
    return make_package("".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' if x else "<w:p/>" for x in text.split("\n")))
