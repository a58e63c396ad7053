"""Type detection: one projection on the JVM, cheap tests first; a package is told by its table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import schema as S
from textloom.functions import text as T


def is_word_package(content: Column) -> Column:
    return T.has_entries(content, "[Content_Types].xml", "word/document.xml")


def detected(filename: Column, content_type: Column, content: Column, word: Column) -> Column:
    """Struct of the detected type. A signature beats metadata, metadata beats the content; else ``error``."""
    sfx, mime = T.suffix(filename), T.normalize_mime(content_type)

    def found(kind, ext, ct, source):
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(filename.alias("filename"), lit(kind).alias("kind"), lit(ext).alias("extension"), lit(ct).alias("content_type"), lit(source).alias("source"), F.lit(None).cast("string").alias("error"))

    def failed(message: str):
        none = F.lit(None).cast("string")
        return F.struct(filename.alias("filename"), none.alias("kind"), none.alias("extension"), none.alias("content_type"), none.alias("source"), F.lit(message).alias("error"))

    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), failed(S.ERROR_EMPTY))
        .when(word, found("docx", ".docx", S.DOCX_MIME, "signature"))
        .when(T.is_pdf(content), found("pdf", ".pdf", S.PDF_MIME, "signature"))
        .when((mime == S.DOCX_MIME) | (sfx == ".docx"), found("docx", ".docx", S.DOCX_MIME, "metadata"))
        .when((mime == S.PDF_MIME) | (sfx == ".pdf"), found("pdf", ".pdf", S.PDF_MIME, "metadata"))
        .when(sfx.isin(list(S.TEXT_MIME_BY_EXTENSION)) | mime.startswith("text/"), found("text", T.text_extension(sfx), T.text_content_type(sfx, content_type), "metadata"))
        .when(T.looks_like_text(content), found("text", ".txt", S.TXT_MIME, "content"))
        .otherwise(failed(S.ERROR_TYPE))
    )


def detect(blobs: DataFrame) -> DataFrame:
    """Blobs ``(doc_id, filename, content_type, content)`` with ``detected``."""
    return blobs.withColumn("detected", detected(F.col("filename"), F.col("content_type"), F.col("content"), F.coalesce(is_word_package(F.col("content")), F.lit(False))))


def default_filename(det: Column) -> Column:
    """The given name, or ``document`` with the detected extension."""
    return F.coalesce(F.nullif(det["filename"], F.lit("")), F.concat(F.lit("document"), det["extension"]))
