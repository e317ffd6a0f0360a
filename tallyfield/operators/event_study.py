"""Event study around the policy date with the joint pre-trend test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyfield.functions.special import chi2_sf

# fixed values: half-width multiplier of the intervals and floor of a pre-period variance
HALF_WIDTH = 1.96
VARIANCE_FLOOR = 1e-8


def relative_week(time: str, t0: str, max_leads: int, max_lags: int):
    """floor(days / 7), tails pooled. Floor, not truncation: the day before t0 belongs to week -1."""
    week = F.floor(F.date_diff(F.col(time), F.lit(t0).cast("date")) / 7).cast("int")
    return F.greatest(F.lit(-max_leads), F.least(F.lit(max_lags), week))


def cells(panel: DataFrame, t0: str, outcome: str, treatment: str = "is_treated", time: str = "week_date",
          max_leads: int = 10, max_lags: int = 26) -> DataFrame:
    """Mean, count and standard deviation per relative week and arm; at most leads + lags + 1 rows."""
    y, arm = F.col(outcome).cast("double"), F.col(treatment)
    return (panel.groupBy(relative_week(time, t0, max_leads, max_lags).alias("rel_week"))
            .agg(*[agg(F.when(arm == a, y)).alias(f"{name}_{a}") for a in (1, 0)
                   for name, agg in (("mean", F.avg), ("count", F.count), ("std", F.stddev_samp))]))


def _with_base(cell: DataFrame) -> DataFrame:
    pre = F.col("rel_week") < 0
    d = cell.select(
        "rel_week", (F.col("mean_1") - F.col("mean_0")).alias("diff"),
        (F.col("std_1") ** 2 / F.col("count_1") + F.col("std_0") ** 2 / F.col("count_0")).alias("v"))
    w = Window.partitionBy()  # leads + lags + 1 rows in all
    k = F.count(F.when(pre, 1)).over(w)
    return (d.withColumn("K", k)
            .withColumn("base", F.coalesce(F.avg(F.when(pre, F.col("diff"))).over(w), F.lit(0.0)))
            .withColumn("var_base", F.coalesce(F.sum(F.when(pre, F.col("v"))).over(w) / F.nullif(k * k, F.lit(0)), F.lit(0.0))))


def event_study(cell: DataFrame) -> DataFrame:
    """Effects relative to the mean pre-period gap, with delta-method errors."""
    d = _with_base(cell)
    pre_var = F.when(F.col("K") > 1, (F.lit(1.0) - F.lit(2.0) / F.col("K")) * F.col("v") + F.col("var_base")) \
        .otherwise(F.col("var_base"))
    variance = F.when(F.col("rel_week") >= 0, F.col("v") + F.col("var_base")) \
        .otherwise(F.greatest(F.lit(VARIANCE_FLOOR), pre_var))
    out = d.select("rel_week", (F.col("diff") - F.col("base")).alias("beta"), F.sqrt(variance).alias("se"),
                   (F.col("rel_week") >= 0).cast("int").alias("is_post"))
    half = F.lit(HALF_WIDTH) * F.col("se")
    return out.select("rel_week", "beta", "se", (F.col("beta") - half).alias("ci_lower"),
                      (F.col("beta") + half).alias("ci_upper"), "is_post")


@F.pandas_udf(T.DoubleType())
def _chi2_tail(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(x), int(k)) for x, k in zip(stat, df)])


def event_summary(cell: DataFrame) -> DataFrame:
    """Joint pre-trend test, and mean post effect with its standard error.

    The quadratic form of the pre-period deviations in the inverse of their covariance equals the
    inverse-variance-weighted spread of the raw gaps, so no matrix is needed. In the post-period
    covariance every off-diagonal entry is the variance of the base, which sums in closed form.
    """
    d = _with_base(cell)
    pre, post = F.col("rel_week") < 0, F.col("rel_week") >= 0
    inv = F.lit(1.0) / F.nullif(F.col("v"), F.lit(0.0))
    agg = d.agg(
        F.count(F.when(pre, 1)).alias("n_pre"), F.count(F.when(post, 1)).alias("n_post"),
        F.max("base").alias("base"), F.max("var_base").alias("var_base"),
        F.sum(F.when(pre, inv)).alias("s0"), F.sum(F.when(pre, inv * F.col("diff"))).alias("s1"),
        F.collect_list(F.when(pre, F.struct(inv.alias("w"), F.col("diff").alias("x")))).alias("gaps"),  # <= max_leads
        F.avg(F.when(post, F.col("diff"))).alias("post_gap"), F.sum(F.when(post, F.col("v"))).alias("post_v"))
    centre = F.col("s1") / F.col("s0")
    stat = F.aggregate("gaps", F.lit(0.0), lambda acc, g: acc + g["w"] * (g["x"] - centre) * (g["x"] - centre))
    many = F.col("n_pre") > 1
    m = F.col("n_post")
    out = agg.select(
        "n_pre", "n_post", F.when(many, stat).otherwise(F.lit(0.0)).alias("joint_test_stat"),
        F.when(many, F.col("n_pre") - 1).otherwise(F.lit(1)).alias("joint_test_df"),
        F.when(m > 0, F.col("post_gap") - F.col("base")).otherwise(F.lit(0.0)).alias("mean_post_att"),
        F.when(m > 0, F.sqrt(F.col("post_v") / (m * m) + F.col("var_base"))).otherwise(F.lit(0.0)).alias("mean_post_se"))
    out = out.withColumn("joint_test_pval", F.when(F.col("n_pre") > 1, _chi2_tail("joint_test_stat", "joint_test_df")).otherwise(1.0))
    return out.withColumn("parallel_trends_pass", F.col("joint_test_pval") >= 0.05)
