"""As-of RFM matrices and time-based calibration/holdout frames."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.numeric import money_sum, round_half
from tallyfield.functions.special import student_t_two_sided
from tallyfield.operators.warehouse import customer_rfm, order_grain, order_lines, rfm_from_orders


def _ts(text: str):
    """A cutoff is midnight of its day: orders later that day fall after it."""
    return F.lit(text).cast("timestamp_ntz")


def rfm_as_of(lines: DataFrame, cutoff: str) -> DataFrame:
    """RFM of order lines dated up to the cutoff; age ends at the cutoff."""
    return rfm_from_orders(order_grain(lines.where(F.col("invoice_date") <= _ts(cutoff))), _ts(cutoff))


def rfm_matrix(stg: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Whole-table matrix, or the as-of one when a cutoff is given."""
    return customer_rfm(stg) if cutoff is None else rfm_as_of(order_lines(stg), cutoff)


def effective_cutoff(lines: DataFrame, cutoff: str) -> str:
    """The cutoff, or the midpoint of the dates when nothing lies before it. One row reaches the driver."""
    row = lines.agg(F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi")).first()
    if row["lo"] is None or row["lo"] <= datetime.fromisoformat(cutoff):
        return cutoff
    return (row["lo"] + (row["hi"] - row["lo"]) / 2).strftime("%Y-%m-%d")


def holdout_split(lines: DataFrame, calibration_end: str, holdout_end: str | None = None,
                  adjust: bool = True) -> DataFrame:
    """RFM up to the calibration end, joined with purchases and spend in (calibration end, holdout end].

    Customers without holdout orders keep zeros. One pass: order grain is aggregated once for both periods.
    """
    if adjust:
        calibration_end = effective_cutoff(lines, calibration_end)
    if holdout_end is None:
        holdout_end = lines.agg(F.max("invoice_date")).first()[0].isoformat(sep=" ")
    orders = (lines.where(F.col("invoice_date") <= F.greatest(_ts(holdout_end), _ts(calibration_end)))
              .withColumn("__cal", F.col("invoice_date") <= _ts(calibration_end))
              .groupBy("customer_id", "invoice_no")
              .agg(F.min(F.when(F.col("__cal"), F.col("invoice_date"))).alias("order_date"),
                   money_sum(F.when(F.col("__cal"), F.col("line_total"))).alias("order_value"),
                   F.max((~F.col("__cal") & (F.col("invoice_date") <= _ts(holdout_end))).cast("int")).alias("h"),
                   money_sum(F.when(~F.col("__cal") & (F.col("invoice_date") <= _ts(holdout_end)),
                                    F.col("line_total"))).alias("h_value")))
    per = orders.groupBy("customer_id").agg(
        F.count("order_date").alias("total_orders"),
        F.min("order_date").alias("__first"), F.max("order_date").alias("__last"),
        money_sum("order_value").alias("__sum"), F.min("order_value").alias("__min"),
        F.sum("h").alias("__h"), money_sum("h_value").alias("__hv")).where(F.col("total_orders") > 0)
    n = F.col("total_orders")
    recency = F.greatest(F.lit(0.0), F.date_diff("__last", "__first").cast("double"))
    age = F.date_diff(_ts(calibration_end), F.col("__first")).cast("double")
    days = (datetime.fromisoformat(holdout_end) - datetime.fromisoformat(calibration_end)).days
    return per.select(
        "customer_id", (n - 1).alias("frequency"), recency.alias("recency"), F.greatest(age, recency).alias("T"),
        round_half(F.col("__sum") / n, 2).alias("monetary_value"),
        round_half(F.when(n > 1, (F.col("__sum") - F.col("__min")) / (n - 1)).otherwise(0.0), 2).alias("monetary_value_repeat"),
        round_half("__sum", 2).alias("total_monetary"), n.alias("total_orders"),
        F.col("__h").alias("actual_holdout_purchases"),
        F.coalesce(round_half("__hv", 2), F.lit(0.0)).alias("actual_holdout_spend"),
        F.lit(days).alias("holdout_duration_days"),
        F.lit(calibration_end).alias("calibration_end_date"), F.lit(holdout_end).alias("holdout_end_date"))


def monetary_column(df: DataFrame) -> str:
    return "monetary_value_repeat" if "monetary_value_repeat" in df.columns else "monetary_value"


def frequency_monetary_correlation(rfm: DataFrame) -> DataFrame:
    """Pearson r between repeat frequency and repeat value over repeat customers."""
    m = monetary_column(rfm)
    return (rfm.where((F.col("frequency") > 0) & (F.col(m) > 0))
            .agg(F.count(F.lit(1)).alias("n"), F.corr(F.col("frequency").cast("double"), m).alias("r"))
            .select("n", F.coalesce("r", F.lit(0.0)).alias("pearson_r")))


def independence_check(rfm: DataFrame) -> dict[str, float | int | bool]:
    """The correlation with its two-sided p-value and the verdict (p > 0.05 or |r| < 0.2)."""
    row = frequency_monetary_correlation(rfm).first()
    n, r = int(row["n"]), float(row["pearson_r"])
    if n <= 2:
        p = 1.0
    elif abs(r) >= 1.0:
        p = 0.0
    else:
        p = student_t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)
    return {"n": n, "pearson_r": r, "p_value": p, "independent": p > 0.05 or abs(r) < 0.2}
