"""Reporting queries over the star schema and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.numeric import money_sum, month_of, round_half


def executive_kpis(orders: DataFrame, returns: DataFrame, dim_cust: DataFrame) -> DataFrame:
    customers = dim_cust.agg(F.count(F.lit(1)).alias("total_customers"), money_sum("total_spend").alias("__net"))
    by_invoice = orders.groupBy("invoice_no").agg(money_sum("line_total").alias("v"))
    sold = by_invoice.agg(F.struct(F.count(F.lit(1)).alias("n"), money_sum("v").alias("v")))
    refunds = returns.agg(money_sum(F.abs("line_total")))
    return customers.withColumn("__s", sold.scalar()).select(
        "total_customers", F.col("__s.n").alias("total_orders"), round_half("__s.v", 2).alias("gross_revenue"),
        round_half("__net", 2).alias("net_revenue"), round_half(refunds.scalar(), 2).alias("returns_value"))


def monthly_revenue(orders: DataFrame, before: str | None = None) -> DataFrame:
    """Revenue and distinct orders per month; ``before`` drops a partial final month."""
    if before:
        orders = orders.where(F.col("invoice_date") < F.lit(before).cast("timestamp_ntz"))
    return (orders.groupBy(month_of("invoice_date").cast("timestamp_ntz").alias("month"))
            .agg(round_half(money_sum("line_total"), 2).alias("monthly_revenue"),
                 F.count_distinct("invoice_no").alias("order_count"))
            .orderBy("month"))


def top_countries(dim_cust: DataFrame, limit: int = 8) -> DataFrame:
    return (dim_cust.groupBy("country")
            .agg(F.count("customer_id").alias("customer_count"), round_half(money_sum("total_spend"), 2).alias("total_spend"))
            .orderBy(F.desc("customer_count"), "country").limit(limit))


def dataset_facts(orders: DataFrame, returns: DataFrame, dim_cust: DataFrame, scores: DataFrame) -> DataFrame:
    o = orders.agg(F.count(F.lit(1)).alias("order_lines"), F.min("invoice_date").alias("min_date"),
                   F.max("invoice_date").alias("max_date"))
    r = returns.agg(F.count(F.lit(1)))
    c = dim_cust.agg(F.count(F.lit(1)))
    s = scores.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("p_alive").alias("p")))
    return (o.withColumn("return_lines", r.scalar()).withColumn("total_customers", c.scalar())
            .withColumn("__s", s.scalar())
            .select("order_lines", "return_lines", (F.col("order_lines") + F.col("return_lines")).alias("total_lines"),
                    "min_date", "max_date", "total_customers", F.col("__s.n").alias("scored_customers"),
                    round_half("__s.p", 6).alias("mean_p_alive")))


def lookup_result(results: DataFrame, cohort: str, outcome: str, model: str) -> DataFrame:
    return results.where((F.col("Cohort") == cohort) & (F.col("Outcome_Metric") == outcome)
                         & (F.col("Estimator_Model") == model))


def cohort_gap(results: DataFrame, model: str, cohorts: Sequence[str],
               share_outcome: str = "active_last_90d") -> DataFrame:
    """Estimates of two cohorts side by side; share outcomes also in percentage points."""
    return (results.where(F.col("Cohort").isin(*cohorts) & (F.col("Estimator_Model") == model))
            .withColumn("att_pp", F.when(F.col("Outcome_Metric") == share_outcome, F.col("Estimated_ATT") * F.lit(100.0))))
