"""Reliable checkpoints: cut lineage in storage every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHUFFLED_ROWS = 80_000_000  # lines whose shuffles are on disk at once


def slices(rows: int) -> int:
    """In how many slices, one after the other, a step moves a table of so many lines."""
    return max(1, -(-rows // SHUFFLED_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset (tests) a new temporary folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfield-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def durable(df: DataFrame) -> DataFrame:
    """Row-exact reliable checkpoint; partition boundaries are frozen with the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside go as each of them ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def stored(df: DataFrame, name: str = "table", *more: DataFrame) -> DataFrame:
    """Columnar variant: write Parquet in the shared folder and read it back.

    The rows are read from there, so the shuffles of the writing are deleted after it. ``more``: frames of the same columns, written one after
    the other into the same table, so that only one's shuffles are on disk at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        for part in (df, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
