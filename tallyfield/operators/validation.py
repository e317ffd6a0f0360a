"""Holdout validation: baselines, error metrics, ranking, calibration, targeting, portfolio views.

A prediction frame has one row per (cutoff, customer); every table here is an aggregate of it, for all
cutoffs at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.config import DEFAULTS, Settings
from tallyfield.functions.durable import stored
from tallyfield.functions.numeric import decile_label, pct_error, qcut_bin, ratio
from tallyfield.functions.ordering import exact_percentiles, group_row_number, value_ranks
from tallyfield.operators.scoring import (BetaGeometric, GammaGamma, ParetoNbd, expected_order_value, expected_purchases,
                                          p_alive, pareto_p_alive)

# fixed values: baselines by name; naive3 uses the holdout mean of one-time buyers, so it looks ahead
BASELINES = ("naive1", "naive2", "naive3")
# fixed values: inactivity rules in days
INACTIVITY_DAYS = (60, 90, 180, 270)
# fixed values: columns of the customer-level export
EXPORT_COLUMNS = (
    "customer_id", "frequency", "recency", "T", "monetary_value", "monetary_value_repeat", "expected_order_value",
    "actual_purchases", "actual_revenue", "predicted_purchases", "predicted_revenue", "p_alive",
    "naive1_purchases", "naive1_revenue", "naive2_purchases", "naive2_revenue", "naive3_purchases", "naive3_revenue",
    "mbgnbd_predicted_purchases", "mbgnbd_predicted_revenue", "mbgnbd_p_alive",
    "paretonbd_predicted_purchases", "paretonbd_predicted_revenue", "paretonbd_p_alive")
# fixed values: (model name, column prefix)
MODELS = (("BG/NBD", ""), ("MBG/NBD", "mbgnbd_"), ("Pareto/NBD", "paretonbd_"))


def with_baselines(frames: DataFrame, keys: Sequence[str] = ("cutoff",), settings: Settings = DEFAULTS) -> DataFrame:
    """Carry-forward forecasts of purchases. ``frames`` holds holdout splits with ``holdout_duration_days``."""
    days = F.col("holdout_duration_days").cast("double")
    f = F.col("frequency").cast("double")
    f0 = stored(frames.where(F.col("frequency") == 0).groupBy(*keys)
                .agg(F.avg(F.col("actual_holdout_purchases").cast("double")).alias("__f0")), "f0-rates")  # one row for each key, of known size
    linear = f / F.greatest(F.lit(1.0), F.col("T")) * days
    rate = F.coalesce(F.col("__f0") / days, F.lit(settings.fallback_f0_rate))
    return (frames.join(f0, list(keys), "left")
            .withColumn("naive1_purchases", linear)
            .withColumn("naive2_purchases", f * (days / F.lit(365.0)))
            .withColumn("naive3_purchases", F.when(F.col("frequency") == 0, rate * days).otherwise(linear))
            .drop("__f0"))


def predictions_at(frame: DataFrame, days: int, bg: BetaGeometric, gg: GammaGamma, mbg: BetaGeometric, pareto: ParetoNbd) -> DataFrame:
    """Three models' purchases, revenue and P(alive) for one holdout split."""
    value = F.when(F.col("frequency") > 0, expected_order_value(gg)).otherwise(F.col("monetary_value"))
    return (frame.withColumn("expected_order_value", value)
            .withColumn("predicted_purchases", expected_purchases(bg, [days])[0])
            .withColumn("p_alive", p_alive(bg))
            .withColumn("mbgnbd_predicted_purchases", expected_purchases(mbg, [days])[0])
            .withColumn("mbgnbd_p_alive", p_alive(mbg))
            .withColumn("paretonbd_predicted_purchases", expected_purchases(pareto, [days])[0])
            .withColumn("paretonbd_p_alive", pareto_p_alive(pareto)))


def export_frame(scored: DataFrame, keys: Sequence[str] = ("cutoff",)) -> DataFrame:
    """The 24-column customer export (plus the keys): revenue is purchases times the unified order value."""
    value = F.col("expected_order_value")
    df = (scored.withColumn("actual_purchases", F.col("actual_holdout_purchases"))
          .withColumn("actual_revenue", F.col("actual_holdout_spend")))
    for prefix in [p for _, p in MODELS]:
        df = df.withColumn(f"{prefix}predicted_revenue", F.col(f"{prefix}predicted_purchases") * value)
    for b in BASELINES:
        df = df.withColumn(f"{b}_revenue", F.col(f"{b}_purchases") * value)
    return df.select(*keys, *EXPORT_COLUMNS, "holdout_duration_days")


def _forecasts(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: one row per customer and forecaster, with its purchases and revenue."""
    names = [("BG/NBD", "predicted")] + [(b, b) for b in BASELINES]
    rows = F.explode(F.array(*[
        F.struct(F.lit(label).alias("model"), F.col(f"{c}_purchases").alias("p"), F.col(f"{c}_revenue").alias("r"))
        for label, c in names]))
    return preds.select(*keys, "customer_id", "frequency", F.col("actual_purchases").cast("double").alias("ap"),
                        F.col("actual_revenue").alias("ar"), rows.alias("f")).select("*", "f.*").drop("f")


def error_metrics(preds: DataFrame, keys: Sequence[str] = ("cutoff",)) -> DataFrame:
    """MAE, RMSE, correlation and totals per forecaster, and the model's MAE / RMSE gain over each baseline."""
    keys = list(keys)

    def errors(a: str, b: str) -> list[Column]:
        d = F.col(a) - F.col(b)
        return [F.avg(F.abs(d)), F.sqrt(F.avg(d * d))]

    mae_p, rmse_p = errors("ap", "p")
    mae_r, rmse_r = errors("ar", "r")
    spread = (F.stddev_pop("ap") > 0) & (F.stddev_pop("p") > 0)
    per = _forecasts(preds, keys).groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("customers"), mae_p.alias("mae_purchases"), rmse_p.alias("rmse_purchases"),
        mae_r.alias("mae_revenue"), rmse_r.alias("rmse_revenue"),
        F.when(spread, F.corr("ap", "p")).otherwise(F.lit(0.0)).alias("pearson_r"),
        F.sum("ap").alias("total_actual_purchases"), F.sum("p").alias("total_predicted_purchases"),
        F.sum("ar").alias("total_actual_revenue"), F.sum("r").alias("total_predicted_revenue"))
    per = (per.withColumn("purchases_error_pct", pct_error("total_predicted_purchases", "total_actual_purchases"))
           .withColumn("revenue_error_pct", pct_error("total_predicted_revenue", "total_actual_revenue")))
    model = per.where(F.col("model") == "BG/NBD").select(
        *keys, *[F.col(c).alias(f"__{c}") for c in ("mae_purchases", "rmse_purchases", "mae_revenue", "rmse_revenue")])
    out = per.join(model, keys)
    for c in ("mae_purchases", "rmse_purchases", "mae_revenue", "rmse_revenue"):
        gain = (F.lit(1.0) - F.col(f"__{c}") / F.greatest(F.lit(1e-5), F.col(c))) * F.lit(100.0)
        out = out.withColumn(f"{c}_gain_pct", F.when(F.col("model") != "BG/NBD", gain))
    return out.drop(*[f"__{c}" for c in ("mae_purchases", "rmse_purchases", "mae_revenue", "rmse_revenue")])


def with_cohorts(df: DataFrame, out: str = "cohort") -> DataFrame:
    """Each row twice: in 'all' and in 'f0' or 'fpos'."""
    return df.withColumn(out, F.explode(F.array(F.lit("all"), F.when(F.col("frequency") == 0, "f0").otherwise("fpos"))))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str]) -> DataFrame:
    """Rank correlation with average ties per group; 0 when either side does not vary.

    Equal (x, y) pairs are counted first, then each distinct value looks up its rank once.
    """
    groups = list(groups)
    pairs = df.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("c"))

    def ranks(col: str, name: str) -> DataFrame:
        centred = F.col("below") + (F.col("cnt") + 1) / 2 - (F.col("n") + 1) / 2
        return value_ranks(df, col, groups).select(*groups, col, centred.alias(name))

    joined = pairs.join(ranks(x, "rx"), [*groups, x]).join(ranks(y, "ry"), [*groups, y])
    sums = joined.groupBy(*groups).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("c") * F.col("ry") * F.col("ry")).alias("yy"))
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0))
    return sums.select(*groups, "n", rho.alias("spearman_rho"))


def top_capture(df: DataFrame, score: str, actual: str, groups: Sequence[str], share: float = 0.10,
                key: str = "customer_id") -> DataFrame:
    """Share of the actuals held by the top ceil(share * n) rows by score; ties by key."""
    groups = list(groups)
    ranked = group_row_number(df.withColumn("__neg", -F.col(score)), groups, ["__neg", key], out="__rn", size_out="__n")
    top = F.col("__rn") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("__n")))
    a = F.col(actual).cast("double")
    return ranked.groupBy(*groups).agg(
        (F.sum(F.when(top, a).otherwise(0.0)) / F.greatest(F.lit(1.0), F.sum(a)) * F.lit(100.0)).alias("top_capture_pct"))


def cohort_comparison(preds: DataFrame, keys: Sequence[str] = ("cutoff",)) -> DataFrame:
    """Model against carry-forward by cohort: MAEs, Spearman, top-decile capture.

    For one-time buyers a third score, newest first (-T), shows what tenure alone would rank.
    """
    keys = list(keys)
    base = with_cohorts(preds)
    no_revenue = F.lit(None).cast("double")
    scores = F.explode(F.filter(F.array(
        F.struct(F.lit("BG/NBD").alias("score_name"), F.col("predicted_purchases").alias("score"), F.col("predicted_revenue").alias("rev")),
        F.struct(F.lit("naive2").alias("score_name"), F.col("naive2_purchases").alias("score"), F.col("naive2_revenue").alias("rev")),
        F.when(F.col("cohort") == "f0", F.struct(F.lit("tenure").alias("score_name"), (-F.col("T")).alias("score"), no_revenue.alias("rev")))),
        lambda s: s.isNotNull()))
    long = base.select(*keys, "cohort", "customer_id", F.col("actual_purchases").cast("double").alias("ap"),
                       F.col("actual_revenue").alias("ar"), scores.alias("s")).select("*", "s.*").drop("s")
    groups = [*keys, "cohort", "score_name"]
    model = F.col("score_name") != "tenure"
    mae = long.groupBy(*groups).agg(
        F.avg(F.when(model, F.abs(F.col("ap") - F.col("score")))).alias("mae_purchases"),
        F.avg(F.when(model, F.abs(F.col("ar") - F.col("rev")))).alias("mae_revenue"))
    rho = spearman(long, "score", "ap", groups)
    cap = top_capture(long, "score", "ap", groups)
    return mae.join(rho, groups).join(cap, groups).select(
        *groups, "n", "mae_purchases", "mae_revenue", "spearman_rho", "top_capture_pct")


def decile_table(preds: DataFrame, keys: Sequence[str] = ("cutoff",), by: str = "predicted_purchases") -> DataFrame:
    keys = list(keys)
    ranked = group_row_number(preds, keys, [by, "customer_id"], out="__rn", size_out="__n")
    return (ranked.withColumn("decile_rank", decile_label(qcut_bin("__rn", F.col("__n"), 10)))
            .groupBy(*keys, "decile_rank").agg(
                F.count(F.lit(1)).alias("customer_count"),
                F.avg(F.col("actual_purchases").cast("double")).alias("avg_actual_purchases"),
                F.avg("predicted_purchases").alias("avg_predicted_purchases"),
                F.avg("actual_revenue").alias("avg_actual_spend"), F.avg("predicted_revenue").alias("avg_predicted_spend")))


def rolling_origin(preds: DataFrame) -> DataFrame:
    """Actual against predicted purchases and revenue per cutoff, overall and by cohort."""
    return (with_cohorts(preds, "segment").groupBy("cutoff", "segment").agg(
        F.count(F.lit(1)).alias("customers"), F.max("holdout_duration_days").alias("holdout_days"),
        F.sum(F.col("actual_purchases").cast("double")).alias("actual_purchases"),
        F.sum("predicted_purchases").alias("predicted_purchases"),
        F.sum("actual_revenue").alias("actual_revenue"), F.sum("predicted_revenue").alias("predicted_revenue"))
        .withColumn("purchases_error_pct", pct_error("predicted_purchases", "actual_purchases"))
        .withColumn("revenue_error_pct", pct_error("predicted_revenue", "actual_revenue")))


def matched_targeting(preds: DataFrame, days: Sequence[int] = INACTIVITY_DAYS) -> DataFrame:
    """Recency rule against the same number of customers picked by P(alive): precision and recall of both."""
    bought = (F.col("actual_purchases") > 0).cast("bigint")
    idle = F.col("T") - F.col("recency")
    sizes = stored(preds.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bought).alias("positives"),
        *[F.count(F.when(idle <= d, 1)).alias(f"k{d}") for d in days],
        *[F.sum(F.when(idle <= d, bought).otherwise(0)).alias(f"tp{d}") for d in days]), "cutoff-sizes")
    ranked = group_row_number(preds.select(
        "cutoff", "customer_id", bought.alias("b"), (-F.col("p_alive")).alias("__a"), (-F.col("predicted_purchases")).alias("__p")),
        ["cutoff"], ["__a", "__p", "customer_id"], out="__rn")
    picked = (ranked.join(sizes, "cutoff").groupBy("cutoff").agg(
        *[F.sum(F.when(F.col("__rn") <= F.col(f"k{d}"), F.col("b")).otherwise(0)).alias(f"pa{d}") for d in days]))
    wide = sizes.join(picked, "cutoff")
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("inactive_days"), F.col(f"k{d}").alias("matched_size"),
                                        F.col(f"tp{d}").alias("tp"), F.col(f"pa{d}").alias("pa")) for d in days]))
    flat = wide.select("cutoff", "n", "positives", rows.alias("r")).select("*", "r.*").drop("r")

    def pct(a: str, b: str) -> Column:
        return F.coalesce(ratio(a, b) * F.lit(100.0), F.lit(0.0))

    return (flat.select("cutoff", "inactive_days", "matched_size", pct("matched_size", "n").alias("cohort_share_pct"),
                        pct("tp", "matched_size").alias("recency_precision"), pct("tp", "positives").alias("recency_recall"),
                        pct("pa", "matched_size").alias("p_alive_precision"), pct("pa", "positives").alias("p_alive_recall"))
            .withColumn("delta_precision", F.col("p_alive_precision") - F.col("recency_precision"))
            .withColumn("delta_recall", F.col("p_alive_recall") - F.col("recency_recall")))


def model_comparison(preds: DataFrame) -> DataFrame:
    """Per cutoff and model: MAEs overall and by cohort, totals, share with P(alive) above 0.8."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"{p}predicted_purchases").alias("p"),
                 F.col(f"{p}predicted_revenue").alias("r"), F.col(f"{p}p_alive").alias("a")) for name, p in MODELS]))
    long = preds.select("cutoff", "frequency", F.col("actual_purchases").cast("double").alias("ap"),
                        F.col("actual_revenue").alias("ar"), rows.alias("m")).select("*", "m.*").drop("m")
    dp, dr = F.abs(F.col("ap") - F.col("p")), F.abs(F.col("ar") - F.col("r"))
    once = F.col("frequency") == 0
    return long.groupBy("cutoff", "model").agg(
        F.avg(dp).alias("mae_purchases"), F.avg(F.when(once, dp)).alias("mae_purchases_f0"),
        F.avg(F.when(~once, dp)).alias("mae_purchases_fpos"), F.avg(dr).alias("mae_revenue"),
        F.avg(F.when(once, dr)).alias("mae_revenue_f0"), F.avg(F.when(~once, dr)).alias("mae_revenue_fpos"),
        F.sum("ap").alias("total_actual_purchases"), F.sum("p").alias("total_predicted_purchases"),
        F.sum("ar").alias("total_actual_revenue"), F.sum("r").alias("total_predicted_revenue"),
        (F.avg((F.col("a") > 0.8).cast("double")) * F.lit(100.0)).alias("share_alive_pct"))


def holdout_record(preds: DataFrame, calibration_end: str, holdout_end: str, correlation: float | Column,
                   p_value: float | Column, settings: Settings = DEFAULTS) -> DataFrame:
    """The one-row validation record of a single cutoff."""
    ap = F.col("actual_purchases").cast("double")
    aggs = [F.max("holdout_duration_days").alias("holdout_days"), F.sum(ap).alias("total_actual_purchases"),
            F.sum("predicted_purchases").alias("total_predicted_purchases"),
            F.sum("actual_revenue").alias("total_actual_revenue"), F.sum("predicted_revenue").alias("total_predicted_revenue"),
            F.corr(ap, F.col("predicted_purchases")).alias("pearson_r")]
    for name, c in (("", "predicted"), *[(f"{b}_", b) for b in BASELINES]):
        d = ap - F.col(f"{c}_purchases")
        aggs += [F.avg(F.abs(d)).alias(f"{name}mae_purchases"), F.sqrt(F.avg(d * d)).alias(f"{name}rmse_purchases")]
        if name:
            aggs.append(F.sum(f"{c}_purchases").alias(f"{name}total_purchases"))
    one = preds.agg(*aggs).withColumn("volume_error_pct", pct_error("total_predicted_purchases", "total_actual_purchases"))
    for b in BASELINES:
        one = one.withColumn(f"{b}_volume_error_pct", pct_error(f"{b}_total_purchases", "total_actual_purchases"))
    as_col = [c if isinstance(c, Column) else F.lit(float(c)) for c in (correlation, p_value)]
    return (one.withColumn("mae", F.col("mae_purchases")).withColumn("rmse", F.col("rmse_purchases"))
            .withColumn("estimation_method", F.lit(settings.estimation_method))
            .withColumn("calibration_end_date", F.lit(calibration_end)).withColumn("observation_end_date", F.lit(calibration_end))
            .withColumn("holdout_end_date", F.lit(holdout_end))
            .withColumn("freq_monetary_corr", as_col[0]).withColumn("freq_monetary_pval", as_col[1]))


def tenure_calibration(preds: DataFrame, keys: Sequence[str] = ("cutoff",), bins: int = 5) -> DataFrame:
    """One-time buyers in quantile bins of age: mean actual against mean predicted purchases."""
    keys = list(keys)
    once = preds.where(F.col("frequency") == 0)
    edges = stored(exact_percentiles(once, "T", {f"e{i}": i / bins for i in range(1, bins)}, keys), "tenure-edges")
    bin_no = F.lit(1)
    for i in range(1, bins):
        bin_no = bin_no + (F.col("T") > F.col(f"e{i}")).cast("int")
    actual = F.avg(F.col("actual_purchases").cast("double"))
    predicted = F.avg("predicted_purchases")
    return (once.join(edges, keys).withColumn("tenure_bin", bin_no).groupBy(*keys, "tenure_bin").agg(
        F.count(F.lit(1)).alias("customers"), actual.alias("mean_actual"), predicted.alias("mean_predicted"))
        .withColumn("relative_error", F.abs(F.col("mean_actual") - F.col("mean_predicted"))
                    / F.nullif(F.col("mean_predicted"), F.lit(0.0))))


# ------------------------------------------------------------------ portfolio views

def portfolio_kpis(scores: DataFrame, dim_cust: DataFrame) -> DataFrame:
    total = dim_cust.agg(F.count(F.lit(1)))
    return (scores.agg(F.avg("clv_12m").alias("mean_clv_12m"), F.sum("clv_12m").alias("total_clv_12m"),
                       F.avg("p_alive").alias("mean_p_alive"),
                       F.avg((F.col("p_alive") > 0.8).cast("double")).alias("share_alive"),
                       F.count(F.lit(1)).alias("scored_customers"))
            .withColumn("returns_only_customers", total.scalar() - F.col("scored_customers")))


def histogram(df: DataFrame, column: str, low: Column, high: Column, bins: int = 40) -> DataFrame:
    """Counts in ``bins`` equal bins of [low, high]; the last bin is closed."""
    at = F.floor((F.col(column) - low) / (high - low) * F.lit(float(bins))).cast("int") + 1
    return (df.withColumn("bin", F.least(F.lit(bins), F.greatest(F.lit(1), at)))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("customers")))


def alive_histogram(scores: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(scores, "p_alive", F.lit(0.0), F.lit(1.0), bins)


def value_histogram(scores: DataFrame, column: str = "clv_12m", quantile: float = 0.98, bins: int = 40) -> DataFrame:
    """Histogram of the values below their 98th percentile."""
    cut = exact_percentiles(scores, column, {"cut": quantile}).scalar()
    return histogram(scores.where(F.col(column) < cut), column, F.lit(0.0), cut, bins)


# fixed values: frequency bins (label, low, high) and recency bins (label, upper day)
FREQUENCY_BINS = (("0", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3–5", 3, 5), ("6–10", 6, 10), ("11–25", 11, 25),
                  ("26–50", 26, 50), ("51+", 51, None))
RECENCY_BINS = (("0–60d", 60), ("61–150d", 150), ("151–300d", 300), ("301–450d", 450), ("451–600d", 600), ("601+d", None))


def alive_heatmap(scores: DataFrame, recency_bins=RECENCY_BINS) -> DataFrame:
    """Mean P(alive) and count per frequency x recency cell; empty cells are kept."""
    f = F.col("frequency")
    f_bin = F.lit(None).cast("string")
    for label, low, high in reversed(FREQUENCY_BINS):
        f_bin = F.when((f >= low) if high is None else f.between(low, high), label).otherwise(f_bin)
    r_bin = F.lit(None).cast("string")
    for label, upper in reversed(recency_bins):
        r_bin = F.lit(label) if upper is None else F.when(F.col("recency") <= upper, label).otherwise(r_bin)
    cells = (scores.withColumn("f_bin", f_bin).withColumn("r_bin", r_bin)
             .groupBy("f_bin", "r_bin").agg(F.avg("p_alive").alias("mean_p_alive"), F.count(F.lit(1)).alias("customers")))
    grid = scores.sparkSession.createDataFrame(
        [(a[0], b[0]) for a in FREQUENCY_BINS for b in recency_bins], "f_bin string, r_bin string")
    return grid.join(cells, ["f_bin", "r_bin"], "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


def customer_horizons(scores: DataFrame, customer_id: int | None = None) -> DataFrame:
    """One row per customer and horizon: value, bounds (when present), expected purchases."""
    if customer_id is not None:
        scores = scores.where(F.col("customer_id") == customer_id)
    have = set(scores.columns)

    def pick(c: str) -> Column:
        return F.col(c) if c in have else F.lit(None).cast("double")

    rows = F.explode(F.array(*[
        F.struct(F.lit(label).alias("forecast_horizon"), pick(f"clv_{m}m").alias("expected_clv"),
                 pick(f"clv_{m}m_lower").alias("clv_lower"), pick(f"clv_{m}m_upper").alias("clv_upper"),
                 pick(f"expected_purchases_{m}m").alias("expected_repeat_purchases"))
        for m, label in ((12, "12 Months (1 Year)"), (24, "24 Months (2 Years)"))]))
    return scores.select("customer_id", rows.alias("h")).select("customer_id", "h.*")
