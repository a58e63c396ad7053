"""Inputs shared by the item operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import bounded_rows, table

#: How the ``id`` of an item is made from the row of each source table.
ITEM_ID = {"segment": "id", "pdf_page": "concat('p', page)", "text_doc": "'s0'"}
KEY = ["src", "doc_id", "id"]


def items(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    """Rows ``(src, doc_id, id, text)`` of the named tables, unions of narrow scans.

    Redelivered rows are still in; callers drop repeats of the key from their
    (narrower) results, so that texts need not be shuffled.
    """
    out = None
    for src in sources:
        one = table(spark, sf_dir, src).selectExpr(f"'{src}' AS src", "doc_id", f"{ITEM_ID[src]} AS id", "text")
        out = one if out is None else out.unionByName(one)
    return out


def once(df: DataFrame) -> DataFrame:
    """One row for each item: a redelivered row carries the same text, so any of the copies serves."""
    return df.dropDuplicates(KEY)


#: Bits of the map of repeated keys; 2 MB at most come to the driver and go out again, however many rows there are.
MAP_BITS = 1 << 24


def once_texts(df: DataFrame) -> DataFrame:
    """One row for each item, without shuffling the texts of items that come once.

    Keys alone are counted first; those that come more than once set a bit in a map of fixed size
    that every task gets. Rows whose bit isn't set are certainly alone and stay where they are; only
    the others, a few ordinary ones by chance among them, are shuffled. If very many keys are repeated the map fills
    up and all rows are shuffled, as they would be anyway.
    """
    spark = df.sparkSession
    bit = F.pmod(F.xxhash64(*KEY), F.lit(MAP_BITS))
    repeated = df.select(bit.alias("bit"), *KEY).groupBy("bit", *KEY).count().filter("count > 1").select(F.col("bit"))
    maps = repeated.groupBy(F.bitmap_bucket_number(F.col("bit")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit"))).alias("_map"))
    rows = bounded_rows(maps, MAP_BITS // 32_768 + 2, "map of repeated keys")
    known = spark.createDataFrame([(r["_bucket"], r["_map"]) for r in rows], "_bucket bigint, _map binary")
    at = F.bitmap_bit_position(F.col("_bit"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number(F.col("_bit"))).join(F.broadcast(known), "_bucket", "left")
    marked = marked.withColumn("_again", F.col("_map").isNotNull() & (F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1))
    alone = marked.filter(~F.coalesce("_again", F.lit(False))).select(*df.columns)
    return alone.unionByName(once(marked.filter(F.coalesce("_again", F.lit(False))).select(*df.columns)))


def add_column(df: DataFrame, name: str, ddl: str, fn: Callable[[list[str | None]], pa.Array], text: str = "text", keep_text: bool = False) -> DataFrame:
    """Append a column made by ``fn`` from the texts of an Arrow batch, dropping the text unless kept.

    ``fn`` is called once a batch with a Python list and returns an Arrow array
    of the same length; other columns pass through Arrow untouched.
    """
    kept = [c for c in df.columns if keep_text or c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = fn(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + [new], names=[*kept, name])

    return df.mapInArrow(run, ", ".join([*fields, f"`{name}` {ddl}"]))


def not_blank(col: str = "text"):
    return F.col(col).rlike(r"(?U)\S")
