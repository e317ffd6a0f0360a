"""Sinks and stored tables on the test tables: written to the shared folder and read back (S2, S7-S12)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.durable import shared_dir
from tallyfield.operators import evaluation, warehouse
from tallyfield.plans.frames import T0, Frames, code_version
from tallyfield.plans.panel_queries import customers, panel_beside, policy_panel, weekly
from tallyfield.plans.sqltext import DIM_CUSTOMERS, RAW, STG
from tallyfield.sources import tables

QUERIES = {}
ORACLES = {}
# the tables every data folder holds
TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
          "orders", "pages", "part", "region", "supplier")


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Frames(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def fresh(f: Frames, name: str) -> str:
    return f"{shared_dir(f.spark)}/{name}-{uuid.uuid4().hex}"


@query("s2_parquet_sink", f"WITH {RAW} SELECT * FROM raw")
def s2(f):
    return f.spark.read.parquet(tables.write_parquet(f.raw(), fresh(f, "raw")))


def _row_counts(f: Frames, names) -> DataFrame:
    parts = None
    for n in names:
        one = f.spark.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _count_sql(names):
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in names)


@query("s7_zstd_export", f"""WITH {STG}, {DIM_CUSTOMERS}, fact_orders AS (SELECT * FROM stg WHERE NOT is_return)
  SELECT 'dim_customers' AS table_name, count(*) AS row_count, FALSE AS skipped FROM dim_customers
  UNION ALL SELECT 'fact_orders', count(*), FALSE FROM fact_orders UNION ALL SELECT 'pred_clv_summary', CAST(0 AS BIGINT), TRUE""")
def s7(f):
    """Two tables are there, one is missing and is skipped."""
    stg = f.stg()
    warehouse.dim_customers(stg).createOrReplaceTempView("dim_customers")
    warehouse.order_lines(stg).createOrReplaceTempView("fact_orders")
    f.spark.catalog.dropTempView("pred_clv_summary")
    out = fresh(f, "export")
    sizes = tables.export_tables(f.spark, ["dim_customers", "fact_orders", "pred_clv_summary"], out)
    parts = None
    for name, size in sizes.items():
        one = (f.spark.range(1).select(F.lit(0).cast("bigint").alias("row_count")) if size is None
               else f.spark.read.parquet(f"{out}/{name}.parquet").agg(F.count(F.lit(1)).alias("row_count")))
        one = one.select(F.lit(name).alias("table_name"), "row_count", F.lit(size is None).alias("skipped"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("s8_csv_sink", f"WITH {STG}, {DIM_CUSTOMERS} SELECT * FROM dim_customers")
def s8(f):
    dim = warehouse.dim_customers(f.stg())
    path = tables.write_csv(dim, fresh(f, "csv"))
    return f.spark.read.schema(dim.schema).option("header", True).csv(path)


@query("s9_persisted_table_alias", f"WITH {STG}, {DIM_CUSTOMERS} SELECT * FROM dim_customers")
def s9(f):
    tables.persist_table(warehouse.dim_customers(f.stg()), fresh(f, "warehouse"), "dim_customers", ["customers_alias"])
    return f.spark.table("customers_alias")


@query("s10_register_directory", _count_sql(TABLES))
def s10(f):
    names = tables.register_directory(f.spark, f.sf_dir)
    return _row_counts(f, names)


@query("s11_read_or_compute", f"WITH {STG}, {DIM_CUSTOMERS} SELECT customer_id, total_spend FROM dim_customers")
def s11(f):
    """The second call must find the stored result: its builder would fail."""
    path = fresh(f, "cache")
    tables.read_or_compute(f.spark, path, lambda: warehouse.dim_customers(f.stg()).select("customer_id", "total_spend"))

    def never() -> DataFrame:
        raise AssertionError("the stored result was not used")
    return tables.read_or_compute(f.spark, path, never)


@query("s12_provenance_gate")
def s12(f):
    panel = policy_panel(f)
    record = evaluation.assignment_benchmark(panel, T0, "stratified_random", code_version(), "benchmark", beside=panel_beside(f))
    # the expected size does not come from the panel: every customer of the split has one row for each week since its first
    last = F.lit(weekly(f).agg(F.max("week_date")).first()[0])
    weeks = (F.date_diff(last, F.col("first_week")) / F.lit(7)).cast("long") + 1
    expected = customers(f).agg(F.sum(weeks)).first()[0]
    data = tables.verify_record(record, "stratified_random", expected, "benchmark")
    return f.spark.createDataFrame(sorted(data.items()), "metric string, value string")
