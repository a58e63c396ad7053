"""Queries of the training-data operators, with the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import KEY, items, once, once_texts
from textloom.llm.encoding import repair_encoding
from textloom.llm.leakage import leaked_items, without_leaks
from textloom.llm.lookalikes import changed_items, unify_items
from textloom.llm.mixing import Mixture
from textloom.llm.personal import mention_rows, redact
from textloom.llm.sentences import sentence_starts, sentence_units
from textloom.llm.splitting import split_items, split_oversized
from textloom.llm.subjects import assign
from textloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items cut into more than one piece, hence larger than the limit of their source."""
    cut = split_oversized(items(spark, d, "segment", "pdf_page"), table(spark, d, "split_limit"))
    return once(cut.filter(F.size("pieces") > 1).select(*KEY))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every item as its ordered pieces."""
    got = split_items(once_texts(items(spark, d, "segment", "pdf_page")), table(spark, d, "split_limit"))
    return got.select(*KEY, F.explode("pieces").alias("p")).select(*KEY, "p.*")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the unifying spelling changes."""
    return once(changed_items(items(spark, d, "segment", "pdf_page")).select(*KEY))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every item in its consistent spelling."""
    return unify_items(once_texts(items(spark, d, "segment", "pdf_page")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each mention of a person's data."""
    return mention_rows(items(spark, d, "segment", "pdf_page", "text_doc"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every item with a typed placeholder for each mention."""
    return redact(once_texts(items(spark, d, "segment", "pdf_page", "text_doc")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The first offset of each sentence unit."""
    got = once(sentence_starts(items(spark, d, "segment", "pdf_page")))
    return got.select(*KEY, F.explode("starts").alias("start_off"))


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    """Every item as its ordered sentence units."""
    return sentence_units(items(spark, d, "segment", "pdf_page"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were decoded wrongly, whole or in part."""
    got = repair_encoding(items(spark, d, "text_doc"))
    return got.filter((F.size("repaired.steps") > 0) | F.col("repaired.lost")).select("doc_id").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their restored text and the steps that restored it."""
    got = repair_encoding(once_texts(items(spark, d, "text_doc")))
    return got.filter((F.size("repaired.steps") > 0) | F.col("repaired.lost")).select("doc_id", "repaired.*")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an evaluation passage, with each of its items."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents without the leaked spans."""
    return without_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The drawn records, one row for each copy."""
    got = Mixture(table(spark, d, "documents"), table(spark, d, "mix_target")).records
    return got.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("epoch"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_target")).shares


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return assign(table(spark, d, "documents"), table(spark, d, "doc_label"), table(spark, d, "subject_area"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document with each of its subject areas."""
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each subject, and the summed posterior."""
    got = _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("posterior"), 3).alias("mass"))
    return table(spark, d, "subject_area").select("subject").join(got, "subject", "left").na.fill(0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_unified, p3_found, p3_redacted, p4_found, p4_units, p5_found, p5_repaired, p6_found, p6_clean, p7_mixture, p7_shares, p8_found, p8_composition)}

_BOTH = "(SELECT 'segment' AS src, doc_id, id, text FROM segment UNION ALL SELECT 'pdf_page', doc_id, 'p' || page, text FROM pdf_page)"

ORACLE: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT i.src, doc_id, id FROM {_BOTH} i JOIN split_limit l ON l.src = i.src WHERE strlen(text) > max_bytes",
}
