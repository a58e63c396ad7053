"""Row numbers inside groups of any size.

A group is cut into ranges of a numeric key. Counts by (group, range), which are few
and partly aggregated before they are shuffled, give each range its offset; rows are
numbered inside their range only. So a group that holds a tenth or a third of all
rows is spread over as many tasks as it has ranges, and the one wide shuffle is by
(group, range).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the key in a range.
RANGE = 4096


def number_rows(df: DataFrame, group: str, key: str, *ties: str, name: str = "n") -> DataFrame:
    """``df`` with the 0-based number ``name`` (bigint) of each row of its ``group`` in the order of ``key`` (an integer; null comes
    first) and ``ties``. Rows equal in all of these are numbered in any order."""
    ranged = df.withColumn("_r", F.coalesce(F.floor(F.col(key) / RANGE), F.lit(-(1 << 40))))
    counts = ranged.groupBy(group, "_r").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_r").alias("_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_r").orderBy(F.col(key).asc_nulls_first(), *ties)
    placed = ranged.withColumn("_k", F.row_number().over(inside))
    joined = placed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_q")))
    return joined.withColumn(name, (F.col("_k") - 1 + F.col("_o")).cast("bigint")).select(*df.columns, name)
