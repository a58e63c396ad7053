"""Documents as a stream: new files are detected and become segments as they arrive.

Nothing is kept between batches, so no watermark is needed; the file source's
log and the sink's commit make every file count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import detect
from textloom.plans import pipeline

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), "content")


def arriving_texts(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Text documents of the arriving files, as segments; a plan without state."""
    return pipeline.text_segments(pipeline.text_documents(detect.detect(arriving_files(spark, path, per_batch))))


def segments_to(spark: SparkSession, path: str, out: str, checkpoint: str, per_batch: int = 1000):
    """A query that writes the segments of every kind of file to a table partitioned by batch, and ends when none is left."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch has a folder of its own, so that a repeated batch replaces itself
        pipeline.load(batch).segments.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving_files(spark, path, per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
