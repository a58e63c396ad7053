"""Problem 7: mix sources to target shares of tokens.

Every record gets a hash-random key; the top bits of the key, as many as the
number of records asks for, are its bucket, so buckets are ranges of the order. Token sums of ``(source, bucket)`` give each
bucket's offset (a prefix sum over a bounded table), a window inside the bucket
the rest. So a source of any size is ordered and cut in parallel, and no task
holds more than a bucket. Each source is cut at its exact budget: whole epochs
first, then the records whose running sum stays within the remainder.

The total is the largest for which every source that has tokens can give its
share within its repeat cap; sources without tokens are left out and the other
shares keep their proportions. Both shares are reported. Records without a
listed source, and records without tokens, are not drawn; null caps mean 1.
"""

from __future__ import annotations

import base64
import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import add_column
from textloom.session import bounded_rows, checkpoint_dir

#: The public pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that a bucket is to hold; the number of buckets follows from the rows there are.
BUCKET_ROWS = 50_000
_cache: dict = {}


def tokenizer_dir() -> str:
    """Folder of the public tokenizers' vocabularies; ``TEXTLOOM_TOKENIZERS`` overrides it."""
    return os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")


def encoding(path: str):
    """The byte-level BPE of the vocabulary file at ``path``, loaded once a worker."""
    if path not in _cache:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cache[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _cache[path]


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``tokens bigint`` in place of the text; a null text has none."""
    path = vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"

    def count(texts):
        enc = encoding(path)
        return pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())

    return add_column(df, "tokens", "bigint", count, text)


def source_key(col: str = "source"):
    """One spelling for each source: letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


class Mixture:
    """A drawn mixture: ``records (doc_id, source, tokens, copies)`` and ``shares``, one row for each target."""

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, total: int | None = None):
        spark = docs.sparkSession
        checkpoint_dir(spark)
        want = {}
        for r in bounded_rows(targets.select(source_key().alias("source"), F.col("source").alias("name"), "target_share", "max_repeat"), 10_000, "mixture targets"):
            if r.source and r.target_share and r.target_share > 0:
                want[r.source] = (r.name, float(r.target_share), int(1 if r.max_repeat is None else r.max_repeat))
        key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"))
        recs = docs.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("source"), F.col(text).alias("text")).filter(F.col("source").isin(list(want)))
        recs = with_token_counts(recs).filter("tokens > 0").withColumn("k", key)
        recs = recs.checkpoint()  # counted once; the passes below read the narrow result
        bits = min(30, max(4, math.ceil(math.log2(max(1, recs.count() / BUCKET_ROWS)))))
        recs = recs.withColumn("bucket", F.shiftrightunsigned("k", 64 - bits).cast("int"))
        sums = recs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        have = {r.source: r.n for r in bounded_rows(sums.groupBy("source").agg(F.sum("n").alias("n")), 10_000, "sources")}
        listed = sum(want[s][1] for s in have)
        most = min((have[s] * want[s][2] * listed / want[s][1] for s in have), default=0)
        whole = most if total is None else min(total, most)
        self.total = int(whole)
        rows = [(s, *want[s], have.get(s, 0), min(int(whole * want[s][1] / listed + 1e-6), have[s] * want[s][2]) if s in have else 0) for s in want]
        plan = spark.createDataFrame(rows or [("", "", 0.0, 0, 0, 0)], "source string, name string, target_share double, max_repeat int, available bigint, budget bigint")
        inside = Window.partitionBy("source", "bucket").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        run = recs.withColumn("upto", F.sum("tokens").over(inside)).join(offsets, ["source", "bucket"]).join(F.broadcast(plan), "source")
        copies = F.expr("budget div available + CASE WHEN upto + offset <= budget % available THEN 1 ELSE 0 END").cast("int")
        self.records = run.withColumn("copies", copies).filter("copies > 0").select("doc_id", F.col("name").alias("source"), "tokens", "copies")
        used = self.records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"), F.sum("copies").cast("bigint").alias("records"))
        everything = Window.partitionBy(F.lit(1))
        self.shares = (
            plan.filter("name <> ''").select(F.col("name").alias("source"), "target_share", "max_repeat", F.col("available").alias("available_tokens"))
            .join(used, "source", "left").na.fill(0, ["used_tokens", "most_copies", "records"])
            .withColumn("actual_share", F.round(F.col("used_tokens") / F.sum("used_tokens").over(everything), 6))
        )
