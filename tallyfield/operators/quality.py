"""Data-quality operators. A check is a DataFrame of failing rows; a report is one row per check."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfield.functions.numeric import money_sum, round_half
from tallyfield.functions.ordering import exact_percentiles

REPORT_COLUMNS = ("check_name", "table_name", "column_name", "failing_rows")


class QualityError(ValueError):
    pass


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values held by more than one row."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1))


def not_accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str | None = None) -> DataFrame:
    """Child rows whose key is missing in the parent. Distinct keys first: a hot key is compared once."""
    parent_column = parent_column or column
    missing = (child.where(F.col(column).isNotNull()).select(column).distinct()
               .join(parent.select(F.col(parent_column).alias("__p")), F.col(column) == F.col("__p"), "left_anti"))
    return child.join(missing, column, "left_semi")


def orphan_count(child: DataFrame, column: str, parent: DataFrame, parent_column: str | None = None) -> DataFrame:
    """Number of orphan rows without touching the fact rows twice: keys are counted, then looked up."""
    parent_column = parent_column or column
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    return (keys.join(parent.select(F.col(parent_column).alias("__p")), F.col(column) == F.col("__p"), "left_anti")
            .agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("failing_rows")))


def revenue_identity(dim_customers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Customers whose net spend is not gross minus returns."""
    net = round_half(F.col("gross_spend") - F.col("return_spend"), 2)
    return (dim_customers
            .select("customer_id", "gross_spend", "return_spend", "total_spend", net.alias("calculated_net_spend"))
            .where(F.abs(F.col("total_spend") - F.col("calculated_net_spend")) > tolerance))


def check_row(name: str, table: str, column: str, failing: DataFrame) -> DataFrame:
    """One report row; ``failing`` is either failing rows or a one-row frame with ``failing_rows``."""
    if failing.columns == ["failing_rows"]:
        count = failing.select(F.col("failing_rows").cast("bigint").alias("failing_rows"))
    else:
        count = failing.agg(F.count(F.lit(1)).alias("failing_rows"))
    return count.select(F.lit(name).alias("check_name"), F.lit(table).alias("table_name"),
                        F.lit(column).alias("column_name"), "failing_rows")


def null_counts(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """All not-null checks of a table in one scan."""
    counted = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failing_rows"))
                               for c in columns]))
    return counted.select(rows.alias("r")).select(
        F.lit("not_null").alias("check_name"), F.lit(table).alias("table_name"), "r.column_name", "r.failing_rows")


def union_reports(parts: Iterable[DataFrame]) -> DataFrame:
    merged = None
    for part in parts:
        merged = part if merged is None else merged.unionByName(part)
    return merged.withColumn("status", F.when(F.col("failing_rows") == 0, "pass").otherwise("fail"))


def star_schema_report(stg: DataFrame, stg_cust: DataFrame, lines: DataFrame, dim_cust: DataFrame,
                       dim_prod: DataFrame, orders: DataFrame, returns: DataFrame) -> DataFrame:
    """The full set of schema checks: nulls, keys, accepted values, foreign keys, revenue identity."""
    parts = [
        null_counts(stg, "stg_orders", ["customer_id", "is_return"]),
        check_row("accepted_values", "stg_orders", "is_return", not_accepted(stg, "is_return", [True, False])),
        null_counts(stg_cust, "stg_customers", ["customer_id"]),
        check_row("unique", "stg_customers", "customer_id", duplicates(stg_cust, "customer_id")),
        null_counts(lines, "int_orders", ["transaction_id"]),
        check_row("unique", "int_orders", "transaction_id", duplicates(lines, "transaction_id")),
        null_counts(dim_cust, "dim_customers", ["customer_id"]),
        check_row("unique", "dim_customers", "customer_id", duplicates(dim_cust, "customer_id")),
        null_counts(dim_prod, "dim_products", ["stock_code"]),
        check_row("unique", "dim_products", "stock_code", duplicates(dim_prod, "stock_code")),
        null_counts(orders, "fact_orders", ["order_id", "customer_id", "stock_code"]),
        check_row("unique", "fact_orders", "order_id", duplicates(orders, "order_id")),
        check_row("relationships", "fact_orders", "customer_id", orphan_count(orders, "customer_id", dim_cust)),
        check_row("relationships", "fact_orders", "stock_code", orphan_count(orders, "stock_code", dim_prod)),
        null_counts(returns, "fact_returns", ["return_id", "customer_id", "stock_code"]),
        check_row("unique", "fact_returns", "return_id", duplicates(returns, "return_id")),
        check_row("relationships", "fact_returns", "customer_id", orphan_count(returns, "customer_id", dim_cust)),
        check_row("relationships", "fact_returns", "stock_code", orphan_count(returns, "stock_code", dim_prod)),
        check_row("revenue_identity", "dim_customers", "total_spend", revenue_identity(dim_cust)),
    ]
    return union_reports(parts)


def report_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("total_checks"),
                      F.count(F.when(F.col("status") == "pass", 1)).alias("passed_checks"),
                      F.count(F.when(F.col("status") != "pass", 1)).alias("failed_checks"),
                      F.sum("failing_rows").cast("bigint").alias("failing_rows"))


def table_assertions(tables: dict[str, DataFrame], raw: DataFrame, min_rows: int, min_last_date: str,
                     date: str = "InvoiceDate", required: Sequence[str] = (
                         "dim_customers", "dim_products", "fact_orders", "fact_returns")) -> DataFrame:
    """Required tables present, enough raw rows, last date late enough, no null customer, no orphan line."""
    spark = raw.sparkSession
    parts = [check_row("required_table", name, "",
                       spark.range(0 if name in tables else 1)) for name in required]
    bounds = raw.agg(F.count(F.lit(1)).alias("n"), F.max(date).alias("last"))
    parts.append(check_row("min_rows", "raw", "", bounds.where(F.col("n") < min_rows)))
    parts.append(check_row("min_last_date", "raw", date,
                           bounds.where(F.col("last").isNull() | (F.col("last") < F.lit(min_last_date).cast("timestamp_ntz")))))
    if "fact_orders" in tables:
        parts.append(check_row("not_null", "fact_orders", "customer_id", not_null(tables["fact_orders"], "customer_id")))
        if "dim_customers" in tables:
            parts.append(check_row("relationships", "fact_orders", "customer_id", orphan_count(
                tables["fact_orders"], "customer_id", tables["dim_customers"])))
    return union_reports(parts)


def require_clean(report: DataFrame) -> DataFrame:
    """Raise when any check failed (the report has one row per check)."""
    failed = report.where(F.col("failing_rows") > 0).select("check_name", "table_name", "column_name", "failing_rows").collect()
    if failed:
        raise QualityError("; ".join(f"{r[0]} {r[1]}.{r[2]}: {r[3]} rows" for r in failed))
    return report


def revenue_reconciliation(orders: DataFrame, returns: DataFrame, dim_cust: DataFrame) -> DataFrame:
    """Fact and dimension totals side by side with their differences."""
    gross = orders.agg(money_sum("line_total"))
    refunds = returns.agg(money_sum(F.abs("line_total") if "line_total" in returns.columns else F.col("return_amount")))
    dims = dim_cust.agg(money_sum("gross_spend").alias("__g"), money_sum("return_spend").alias("__r"), money_sum("total_spend").alias("__n"))
    base = dims.select(gross.scalar().alias("__fg"), refunds.scalar().alias("__fr"), "__g", "__r", "__n")
    return base.select(
        round_half("__fg", 2).alias("fact_gross"), round_half("__fr", 2).alias("fact_returns"),
        round_half(F.col("__fg") - F.col("__fr"), 2).alias("fact_net"),
        round_half("__g", 2).alias("dim_gross"), round_half("__r", 2).alias("dim_returns"),
        round_half("__n", 2).alias("dim_net"),
        round_half(F.col("__g") - F.col("__r") - F.col("__n"), 2).alias("dim_difference"),
        round_half(F.col("__fg") - F.col("__fr") - F.col("__n"), 2).alias("fact_dim_difference"))


def prediction_validity(df: DataFrame, value: str, frequency: str = "frequency") -> DataFrame:
    """NaN / infinite / negative counts and min, median, max, for all rows and split by F = 0 and F > 0."""
    v = F.col(value).cast("double")
    infinite = v.isin(float("inf"), float("-inf"))
    labelled = df.select(
        v.alias("__v"),
        F.explode(F.array(F.lit("all"), F.when(F.col(frequency) == 0, "f0").otherwise("fpos"))).alias("stratum"))
    counts = labelled.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.when(F.isnan("__v") | F.col("__v").isNull(), 1)).alias("nan_count"),
        F.count(F.when(F.col("__v").isin(float("inf"), float("-inf")), 1)).alias("inf_count"),
        F.count(F.when(F.col("__v") < 0, 1)).alias("negative_count"),
        F.min("__v").alias("min_value"), F.max("__v").alias("max_value"))
    medians = exact_percentiles(labelled, "__v", {"median_value": 0.5}, ["stratum"])
    return counts.join(medians, "stratum", "left").select(
        "stratum", "row_count", "nan_count", "inf_count", "negative_count", "min_value", "median_value", "max_value")


def require_valid(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float | None = None) -> DataFrame:
    """Raise if any value is NULL, NaN, infinite or out of range; never repaired silently. One counting pass."""
    def bad(c: str) -> Column:
        v = F.col(c).cast("double")
        wrong = v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")) | (v < low)
        return wrong | (v > high) if high is not None else wrong

    row = df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in columns]).first()
    found = {c: row[c] for c in columns if row[c]}
    if found:
        raise QualityError(f"invalid predictions: {found}")
    return df


def result_differences(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("Estimator_Model", "Cohort", "Outcome_Metric"),
                       values: Sequence[str] = ("Estimated_ATT", "True_ATT"), tolerance: float = 1e-5) -> DataFrame:
    """Rows of two result tables that differ by more than the tolerance; two missing values are equal."""
    o = old.select(*keys, *[F.nanvl(F.col(v), F.lit(None).cast("double")).alias(f"{v}_committed") for v in values])
    n = new.select(*keys, *[F.nanvl(F.col(v), F.lit(None).cast("double")).alias(f"{v}_regenerated") for v in values])
    joined = o.join(n, list(keys), "inner")
    differs = None
    for v in values:
        a, b = F.col(f"{v}_committed"), F.col(f"{v}_regenerated")
        joined = joined.withColumn(f"{v}_difference", F.when(a.isNull() & b.isNull(), F.lit(0.0)).otherwise(F.abs(a - b)))
        d = F.coalesce(F.col(f"{v}_difference") > tolerance, F.lit(True))
        differs = d if differs is None else differs | d
    return joined.where(differs)


def calibration_frames(frames: DataFrame, first_orders: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Per cutoff: rows, distinct customers, customers first seen by the cutoff, and whether the size is monotone.

    ``frames``: (cutoff, customer_id); ``first_orders``: (customer_id, first_date). One row per cutoff.
    """
    per_customer = frames.groupBy("cutoff", "customer_id").agg(F.count(F.lit(1)).alias("c"))
    sizes = per_customer.groupBy("cutoff").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_customers"))
    reached = F.explode(F.array(*[
        F.when(F.col("first_date") <= F.lit(c).cast("timestamp_ntz"), F.lit(c)) for c in cutoffs]))
    seen = (first_orders.select(reached.alias("cutoff")).where(F.col("cutoff").isNotNull())
            .groupBy("cutoff").agg(F.count(F.lit(1)).alias("n_first_orders")))
    w = Window.orderBy("cutoff")  # one row per cutoff
    return (sizes.join(seen, "cutoff", "left")
            .withColumn("n_first_orders", F.coalesce("n_first_orders", F.lit(0)))
            .withColumn("previous_n", F.lag("n_customers").over(w))
            .select("cutoff", "n_rows", "n_customers", "n_first_orders",
                    (F.col("n_rows") == F.col("n_customers")).alias("unique_ids"),
                    (F.col("n_customers") <= F.col("n_first_orders")).alias("within_first_orders"),
                    F.coalesce(F.col("n_customers") >= F.col("previous_n"), F.lit(True)).alias("monotone")))
