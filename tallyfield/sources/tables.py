"""Table sinks and readers: Parquet, CSV, views, cached predictions, provenance gate."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = (), compression: str | None = None) -> str:
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    cols = list(partition_by)
    (writer.partitionBy(*cols) if cols else writer).parquet(path)
    return path


def read_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def persist_table(df: DataFrame, root: str, name: str, aliases: Iterable[str] = ()) -> DataFrame:
    """Full-refresh table under ``root`` plus temp views for the name and its aliases."""
    write_parquet(df, f"{root}/{name}")
    kept = df.sparkSession.read.parquet(f"{root}/{name}")
    for view in (name, *aliases):
        kept.createOrReplaceTempView(view)
    return kept


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header. The partition count is left to Spark; result tables come out as one file anyway."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def path_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _filesystem(spark, path)
    return int(fs.getContentSummary(p).getLength())


def export_tables(spark: SparkSession, tables: Iterable[str], out_dir: str,
                  max_bytes: int | None = None) -> dict[str, int | None]:
    """Copy the registered views to ZSTD Parquet; a missing view is reported as ``None``, not an error."""
    sizes: dict[str, int | None] = {}
    for name in tables:
        if not spark.catalog.tableExists(name):
            sizes[name] = None
            continue
        target = f"{out_dir}/{name}.parquet"
        write_parquet(spark.table(name), target, compression="zstd")
        sizes[name] = path_bytes(spark, target)
    total = sum(s for s in sizes.values() if s)
    if max_bytes is not None and total > max_bytes:
        raise ValueError(f"exported {total} bytes, more than the allowed {max_bytes}")
    return sizes


def register_directory(spark: SparkSession, directory: str) -> list[str]:
    """A temp view for every ``*.parquet`` entry of a directory."""
    fs, p = _filesystem(spark, directory)
    names = []
    for status in fs.listStatus(p):
        leaf = status.getPath().getName()
        stem, ext = os.path.splitext(leaf)
        if ext == ".parquet":
            spark.read.parquet(status.getPath().toString()).createOrReplaceTempView(stem)
            names.append(stem)
    return sorted(names)


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Stored result if a complete one exists, else compute, write and read it back."""
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        write_parquet(compute(), path)
    return spark.read.parquet(path)


class ProvenanceError(ValueError):
    pass


def verify_record(record: DataFrame, expected_mode: str, expected_rows: int, source: str,
                  barred_words: Iterable[str] = ("test_synthetic", "synthetic_test")) -> dict[str, str]:
    """Gate before publishing a (metric, value) record: source, panel size, code version and mode must hold."""
    needed = ("source_script", "panel_row_count", "code_version", "assignment_mode")
    data = {r["metric"]: r["value"] for r in record.where(F.col("metric").isin(*needed)).groupBy("metric").agg(F.max("value").alias("value")).collect()}
    if data.get("source_script") != source:
        raise ProvenanceError(f"source is {data.get('source_script')!r}, expected {source!r}")
    if int(data.get("panel_row_count") or 0) != expected_rows:
        raise ProvenanceError(f"panel has {data.get('panel_row_count')} rows, expected {expected_rows}")
    version = data.get("code_version") or ""
    if len(version) < 7 or version == "unknown_commit":
        raise ProvenanceError("code version missing")
    barred = F.lit(False)
    for word in barred_words:
        barred = barred | F.contains(F.lower(F.col("value").cast("string")), F.lit(word))
    for r in record.where(barred).limit(1).collect():
        raise ProvenanceError(f"{r['metric']}={r['value']!r} comes from a test fixture")
    if data.get("assignment_mode") != expected_mode:
        raise ProvenanceError(f"assignment mode is {data.get('assignment_mode')!r}, expected {expected_mode!r}")
    return data
