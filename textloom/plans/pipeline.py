"""Load documents into segments, edit them, and write them back as bytes.

Each stage is a DataFrame to DataFrame function. Kinds part after detection, so
that a binary column is read only by the parser of its kind. Failures are rows
with an ``error``; documents with a failed edit give no bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schema as S
from textloom.functions import text as T
from textloom.operators import detect as D
from textloom.operators import diff, edits as E
from textloom.sources import docx, pdf


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Blobs ``(doc_id, filename, content_type, content)`` of the files under a path; the path is the doc_id."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    files = reader.load(path)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), "content")


def text_documents(found: DataFrame) -> DataFrame:
    """Detected blobs of kind text as ``(doc_id, filename, content_type, text)``."""
    t = found.filter("detected.kind = 'text'")
    return t.select("doc_id", D.default_filename(F.col("detected")).alias("filename"), F.col("detected.content_type").alias("content_type"), T.decode_text("content").alias("text"))


def text_segments(docs: DataFrame) -> DataFrame:
    """One segment for each text document, an empty one too."""
    none = F.lit(None)
    return docs.select("doc_id", F.lit("s0").alias("id"), "text", F.lit("text").alias("part"), F.lit(0).alias("index"), none.cast("string").alias("container_id"), none.cast("int").alias("paragraph_index"), none.cast("array<int>").alias("run_indices"))


class Loaded:
    """Detected blobs with the tables their formats give. Each kind's files are parsed in one stage."""

    def __init__(self, blobs: DataFrame):
        self.found = D.detect(blobs.select("doc_id", "filename", "content_type", "content"))
        self.texts = text_documents(self.found)
        named = self.found.select("doc_id", "filename", D.default_filename(F.col("detected")).alias("stored"), "detected.kind", "content")
        self.docx_blobs = named.filter("kind = 'docx'").drop("kind")
        self.pdf_blobs = named.filter("kind = 'pdf'").drop("kind")
        self.paragraphs = docx.paragraphs(self.docx_blobs)
        self.pdfs = pdf.documents(self.pdf_blobs)
        self.pages = pdf.page_table(self.pdfs)

    @property
    def segments(self) -> DataFrame:
        return text_segments(self.texts).unionByName(docx.segments(self.paragraphs)).unionByName(pdf.segments(self.pages))

    @property
    def positions(self) -> DataFrame:
        """``(doc_id, pos, id)``: the place of each segment in its document's list of texts, as the readers know it."""
        of_text = self.texts.select("doc_id", F.lit(0).alias("pos"), F.lit("s0").alias("id"))
        of_docx = self.paragraphs.filter("segment_no IS NOT NULL").select("doc_id", F.col("segment_no").alias("pos"), F.concat(F.lit("s"), F.col("segment_no").cast("string")).alias("id"))
        shown = F.filter("pages", lambda p: ~T.is_blank(p["text"]))
        of_pdf = self.pdfs.select("doc_id", F.posexplode(shown).alias("pos", "p")).select("doc_id", "pos", F.concat(F.lit("p"), F.col("p.page").cast("string")).alias("id"))
        return of_text.unionByName(of_docx).unionByName(of_pdf)

    @property
    def errors(self) -> DataFrame:
        own = self.found.filter("detected.error IS NOT NULL").select("doc_id", F.col("detected.error").alias("error"))
        return own.unionByName(self.paragraphs.filter("error IS NOT NULL").select("doc_id", "error")).unionByName(self.pdfs.filter("error IS NOT NULL").select("doc_id", "error"))


def load(blobs: DataFrame) -> Loaded:
    return Loaded(blobs)


def text_bytes(docs: DataFrame) -> DataFrame:
    """Outputs of text documents: always UTF-8; name and media type follow the stored name's extension."""
    ext = T.output_extension("filename")
    kept = [c for c in docs.columns if c not in ("filename", "content_type", "text")]
    return docs.select(*kept, T.output_filename("filename", ext).alias("filename"), T.text_content_type(ext, F.lit(None).cast("string")).alias("content_type"), F.encode("text", "UTF-8").alias("data"))


def edits_by_position(loaded: Loaded, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits that put ``texts (doc_id, pos, new_text)`` in the place of each document's segments, and ``(doc_id, error)`` of the
    documents that have another number of segments than of texts."""
    given = texts.select("doc_id", F.col("pos").cast("int").alias("pos"), F.struct("new_text").alias("_t"))
    both = loaded.positions.join(given, ["doc_id", "pos"], "full")
    counts = both.groupBy("doc_id").agg(F.count("id").alias("have"), F.count("_t").alias("given")).filter("given > 0 AND have != given")
    wrong = counts.select("doc_id", F.concat(F.lit("expected "), F.col("have").cast("string"), F.lit(" text segments, got "), F.col("given").cast("string")).alias("error"))
    none = F.lit(None)
    edits = both.filter("id IS NOT NULL AND _t IS NOT NULL").select("doc_id", F.col("pos").alias("seq"), none.cast("string").alias("container_id"), "id", F.col("_t.new_text").alias("text"), none.cast("int").alias("start_offset"), none.cast("int").alias("end_offset"))
    return edits, wrong


def edited_pages(docs: DataFrame, edits: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Read PDF documents with ``edited``, their pages after the edits, how each is written back, and ``failed``.

    The edits of a document come to it in one row, or are there already, in a column ``edits`` as
    ``edits.by_document`` makes it. Every file is read once: rows with and without edits don't part.
    """
    page_id = lambda p: F.concat(F.lit("i:p"), p["page"].cast("string"))
    of_page = lambda p: F.filter("_edits", lambda e: e["target"] == page_id(p))
    folded = lambda p: F.when(T.is_blank(p["text"]), F.struct(p["text"].alias("text"), F.lit(None).cast("string").alias("error"))).otherwise(E.fold(p["text"], of_page(p)))
    joined = docs.withColumnRenamed("edits", "_edits") if edits is None else docs.join(E.by_document(edits).withColumnRenamed("edits", "_edits"), "doc_id", "left")
    joined = joined.withColumn("_f", F.when(F.col("_edits").isNotNull(), F.transform("pages", folded)))
    known = F.transform(F.filter("pages", lambda p: ~T.is_blank(p["text"])), page_id)
    unknown = F.exists("_edits", lambda e: ~F.array_contains(known, e["target"])) if strict else F.lit(False)
    error = F.coalesce(F.get(F.filter(F.transform("_f", lambda x: x["error"]), lambda x: x.isNotNull()), F.lit(0)), F.when(unknown, E.TARGET_ERROR))
    page = lambda p, t: F.struct(p["page"].alias("page"), p["text"].alias("source_text"), t.alias("text"), p["width"].alias("width"), p["height"].alias("height"))
    new = F.when(F.col("_f").isNotNull(), F.zip_with("pages", "_f", lambda p, x: page(p, x["text"]))).otherwise(F.transform("pages", lambda p: page(p, p["text"])))
    out = joined.withColumn("failed", error).withColumn("edited", new).drop("_f", "_edits", "pages")
    return diff.compare_pages(out)


def render(loaded: Loaded, edits: DataFrame, strict: bool = False, failures: DataFrame | None = None) -> DataFrame:
    """``(doc_id, filename, content_type, data, error)`` of all documents after their edits.

    ``strict``: a document with an edit of an unknown target fails. ``failures (doc_id, error)``: documents that have failed
    already. Beside each document come its edits, in one row; nothing else is joined.
    """
    grouped = E.by_document(edits)
    mine = F.filter("edits", lambda e: e["target"] == "i:s0")
    other = F.exists("edits", lambda e: e["target"] != "i:s0") if strict else F.lit(False)
    folded = loaded.texts.join(grouped, "doc_id", "left").withColumn("_f", F.when(F.size(mine) > 0, E.fold(F.col("text"), mine)))
    t = folded.select("doc_id", "filename", "content_type", F.coalesce("_f.text", "text").alias("text"), F.coalesce("_f.error", F.when(other, E.TARGET_ERROR)).alias("error"))
    out = text_bytes(t).select("doc_id", "filename", "content_type", "data", "error")
    w = docx.write(loaded.docx_blobs, edits, strict)
    words = w.select("doc_id", T.output_filename("filename", "docx").alias("filename"), F.lit(S.DOCX_MIME).alias("content_type"), "data", "error")
    p = pdf.write(edited_pages(loaded.pdfs, edits, strict))
    pdfs = p.select("doc_id", T.output_filename("stored", "pdf").alias("filename"), F.lit(S.PDF_MIME).alias("content_type"), "data", F.coalesce("error", "failed", "save_error").alias("error"))
    out = out.unionByName(words).unionByName(pdfs)
    if failures is not None:
        bad = failures.groupBy("doc_id").agg(F.min("error").alias("_bad"))
        out = out.join(bad, "doc_id", "left").withColumn("error", F.coalesce("_bad", "error")).drop("_bad")
    return out.withColumn("data", F.when(F.col("error").isNull(), F.col("data")))


def save_files(outputs: DataFrame, folder: str) -> None:
    """Write each output's bytes under a folder of any file system that Spark knows, as parquet of ``(doc_id, filename, content_type,
    data)``: the committer makes repeated and lost tasks leave whole files only. ``export_files`` turns them into single files."""
    outputs.filter("data IS NOT NULL").select("doc_id", "filename", "content_type", "data").write.mode("overwrite").parquet(folder)


def export_files(outputs: DataFrame, folder: str) -> DataFrame:
    """Write each output as a file of its own: ``(doc_id, path)`` of what was written. Lazy: the rows must be read.

    Files are written through the file system library of Arrow, which knows shared mounts, HDFS, S3 and GCS by
    the address of the folder. A file is written beside its place first and moved there, so that a repeated task leaves whole files only.
    """
    import pyarrow as pa

    def run(batches):
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            done = []
            for r in b.to_pylist():
                to = f"{base}/{hash_text(r['doc_id']):016x}-{r['filename']}"
                part = f"{to}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(r["data"])
                system.move(part, to)
                done.append({"doc_id": r["doc_id"], "path": to})
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("doc_id", pa.string()), ("path", pa.string())]))

    return outputs.filter("data IS NOT NULL").select("doc_id", "filename", "data").mapInArrow(run, "doc_id string, path string")


def hash_text(text: str) -> int:
    """A hash that is the same in every process."""
    import hashlib

    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
