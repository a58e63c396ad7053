"""Session and table helpers shared by every plan."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession


def local_session(cpus: int = 8, app: str = "textloom") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Rows of a table whose size is fixed by its meaning (a parameter table).

    Fetches at most ``limit + 1`` rows and raises beyond the limit, so nothing
    that grows with the data can reach the driver through here.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is not a parameter table")
    return rows


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Where none is set a local session gets a private one; a cluster
    session raises, as a folder of the driver's machine would be of no use to its executors."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            got = jvm.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            got = tempfile.mkdtemp(prefix="textloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(got)
    return got
