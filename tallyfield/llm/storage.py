"""Intermediate tables of the operators, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.durable import shared_dir


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet and read back: cuts the lineage, prunes columns, and gives Spark the real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator, deleted as soon as later ones, already written, replace them.

    A kept table has no lineage, so nothing is recomputed from a deleted one.
    """

    def __init__(self, spark) -> None:
        self.spark, self.paths = spark, {}

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


def joined_by_digest(rows: DataFrame, facts: DataFrame, salts: int = 8) -> DataFrame:
    """rows(doc_id, digest, ...) with the facts(digest, ...) of their texts, one row each, or NULLs. Same plan at every size.

    Rows are dealt by digest and a salt of their id, so a text with very many copies is not one task; the small facts go to every salt.
    """
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return salted.join(spread.hint("merge"), ["digest", "salt"], "left").drop("salt")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
