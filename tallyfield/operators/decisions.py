"""Decision layer: value segments, win-back return, waiver policy, guardrails, margin scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.config import DEFAULTS, Settings
from tallyfield.functions.numeric import round_half
from tallyfield.functions.ordering import exact_percentiles

# fixed values: segment labels, thresholds and the observed window
SEGMENTS = (
    "1. VIP Retention & Loyalty (High CLV / High P(Alive))",
    "2. Win-Back Priority (High CLV / Low P(Alive))",
    "3. Cross-Sell / Upsell (Lower CLV / High P(Alive))",
    "4. Low-Cost Nurturing (Lower CLV / Low P(Alive))",
)
VALUE_QUANTILE = 0.70
ALIVE_CUT = 0.75
OBSERVED_WEEKS = 27
MAX_WEEKS = 52
# fixed values: result-table labels the policy reads
DID_MODEL = "TWFE DiD (PanelOLS)"
TOP_COHORT = "Quintile 5 (Top Spend)"
WITHIN_WINDOW = "Empirically validated window (<= 27 weeks)"
BEYOND_WINDOW = "Extrapolation of estimated effect (> 27 weeks)"


def with_segments(scores: DataFrame) -> DataFrame:
    """Four quadrants: value at or above its 70th percentile x P(alive) at or above 0.75."""
    cut = exact_percentiles(scores, "clv_12m", {"cut": VALUE_QUANTILE}).scalar()
    marked = scores.withColumn("__cut", cut)
    high, likely = F.col("clv_12m") >= F.col("__cut"), F.col("p_alive") >= ALIVE_CUT
    label = (F.when(high & likely, SEGMENTS[0]).when(high, SEGMENTS[1]).when(likely, SEGMENTS[2]).otherwise(SEGMENTS[3]))
    return marked.withColumn("strategy_segment", label).drop("__cut")


def segment_summary(segmented: DataFrame) -> DataFrame:
    per = segmented.groupBy("strategy_segment").agg(
        F.count("customer_id").alias("customer_count"), F.avg("clv_12m").alias("avg_12m_clv"), F.sum("clv_12m").alias("total_12m_clv"),
        F.avg("p_alive").alias("avg_p_alive"), F.avg("expected_purchases_12m").alias("avg_expected_orders"))
    total = segmented.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("clv_12m").alias("v"))).scalar()
    return (per.withColumn("__t", total)
            .withColumn("pct_of_customers", round_half(F.col("customer_count") / F.col("__t.n") * F.lit(100.0), 1))
            .withColumn("pct_of_portfolio_val", round_half(F.col("total_12m_clv") / F.col("__t.v") * F.lit(100.0), 1))
            .drop("__t"))


def average_effect(panel: DataFrame | None, settings: Settings = DEFAULTS) -> Column:
    """Mean observed minus counterfactual weekly spend of treated customers after the policy; a default without a panel."""
    if panel is None:
        return F.lit(settings.fallback_att)
    hit = panel.where((F.col("is_treated") == 1) & (F.col("is_post_period") == 1))
    return hit.agg(F.coalesce(F.avg(F.col("observed_weekly_spend") - F.col("counterfactual_weekly_spend")),
                              F.lit(settings.fallback_att))).scalar()


def winback_roi(summary: DataFrame, att: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Return of a win-back campaign on the high-value, low-P(alive) segment (the first segment when it is empty)."""
    wanted = F.when(F.col("strategy_segment") == SEGMENTS[1], 0).otherwise(1)
    # four rows at most
    target = summary.orderBy(wanted, "strategy_segment").limit(1).withColumn("__att", att)
    n = F.col("customer_count").cast("double")
    cost = n * F.lit(settings.campaign_cost)
    revenue = n * F.lit(settings.winback_rate) * (F.col("avg_12m_clv") + F.col("__att") * F.lit(settings.winback_weeks))
    margin = revenue * F.lit(settings.gross_margin)
    return target.select(
        F.lit("High-Value Customer Win-Back").alias("Campaign_Strategy"), F.lit("High CLV + Low P(Alive)").alias("Target_Cohort"),
        F.col("customer_count").alias("Targeted_Customers"), cost.alias("Campaign_Cost"),
        revenue.alias("Est_Incremental_Gross_Revenue"), margin.alias("Gross_Margin_Dollar"), (margin - cost).alias("Net_Financial_Impact"),
        ((margin - cost) / F.greatest(F.lit(1.0), cost) * F.lit(100.0)).alias("ROI_Percent"))


def top_treated_count(panel: DataFrame | None, settings: Settings = DEFAULTS) -> Column:
    if panel is None:
        return F.lit(settings.fallback_n_q5).cast("bigint")
    return panel.where((F.col("spend_quintile") == 5) & (F.col("is_treated") == 1)).agg(F.count_distinct("customer_id")).scalar()


def waiver_policy(results: DataFrame, n_q5: Column, waived_share: float | Column = 0.5, weeks: int = OBSERVED_WEEKS,
                  margin: float | None = None, settings: Settings = DEFAULTS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Margin and retention effect of waiving the policy for a share of the top spenders.

    Net margin change is margin x share x customers x weeks x (-ATT); the interval bounds swap sides.
    """
    horizon = min(MAX_WEEKS, max(1, int(weeks)))
    rows = results.where((F.col("Cohort") == TOP_COHORT) & (F.col("Estimator_Model") == DID_MODEL))

    def value(metric: str, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("Outcome_Metric") == metric, F.col(c))), F.lit(0.0))

    one = rows.groupBy(*keys).agg(
        value("weekly_spend_winsor", "Estimated_ATT").alias("att_q5_spend"), value("weekly_spend_winsor", "ci_lower").alias("ci_lower_spend"),
        value("weekly_spend_winsor", "ci_upper").alias("ci_upper_spend"), value("active_last_90d", "Estimated_ATT").alias("att_q5_active90"),
        value("active_last_90d", "ci_lower").alias("ci_lower_active90"), value("active_last_90d", "ci_upper").alias("ci_upper_active90"))
    share = waived_share if isinstance(waived_share, Column) else F.lit(float(waived_share))
    m = F.lit(settings.gross_margin if margin is None else margin)
    one = (one.withColumn("waived_share", share).withColumn("gross_margin_pct", m).withColumn("weeks", F.lit(horizon))
           .withColumn("n_q5", n_q5).withColumn("is_extrapolation", F.lit(horizon > OBSERVED_WEEKS))
           .withColumn("extrapolation_label", F.lit(BEYOND_WINDOW if horizon > OBSERVED_WEEKS else WITHIN_WINDOW)))
    factor = F.col("gross_margin_pct") * F.col("waived_share") * F.col("n_q5") * F.col("weeks")
    keep = F.lit(1.0) - F.col("waived_share")
    return (one.withColumn("net_margin_change_central", factor * -F.col("att_q5_spend"))
            .withColumn("net_margin_change_low", factor * -F.col("ci_upper_spend"))
            .withColumn("net_margin_change_high", factor * -F.col("ci_lower_spend"))
            .withColumn("q5_retention_effect", keep * F.col("att_q5_active90"))
            .withColumn("q5_retention_effect_worst", keep * F.col("ci_lower_active90")))


def sensitivity_curve(results: DataFrame, n_q5: Column, steps: int = 21, weeks: int = OBSERVED_WEEKS,
                      settings: Settings = DEFAULTS) -> DataFrame:
    """The waiver policy over evenly spaced shares from 0 to 1."""
    shares = F.explode(F.array(*[F.lit(i / (steps - 1)) for i in range(steps)]))
    curve = waiver_policy(results, n_q5, shares, weeks, settings=settings)
    return curve.select(
        (F.col("waived_share") * F.lit(100.0)).alias("waiver_share_pct"), "net_margin_change_central", "net_margin_change_low",
        "net_margin_change_high", (F.col("q5_retention_effect") * F.lit(100.0)).alias("active_share_impact_pp"))


def guardrail_status(value_pp: Column, settings: Settings = DEFAULTS) -> Column:
    return (F.when(value_pp >= settings.guardrail_amber_pp, "GREEN")
            .when(value_pp >= settings.guardrail_red_pp, "AMBER").otherwise("RED"))


def guardrails(policy: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Active-share status of the point estimate and of its worst case, and whether the margin band spans zero."""
    point = F.col("q5_retention_effect") * F.lit(100.0)
    worst = F.col("q5_retention_effect_worst") * F.lit(100.0)
    low = F.least("net_margin_change_low", "net_margin_change_high")
    high = F.greatest("net_margin_change_low", "net_margin_change_high")
    without = F.col("att_q5_active90") * F.lit(100.0)
    return policy.select(
        "waived_share", without.alias("active_without_waiver_pp"), point.alias("active_with_waiver_pp"),
        (point - without).alias("active_improvement_pp"), worst.alias("worst_case_pp"),
        guardrail_status(point, settings).alias("point_status"), guardrail_status(worst, settings).alias("worst_case_status"),
        ((low <= 0) & (high >= 0)).alias("band_spans_zero"))


def margin_panel(scores: DataFrame, freq_lift: float = 0.0, aov_lift: float = 0.0, p_alive_lift: float = 0.0,
                 margin: float | None = None, segment: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Per-customer baseline and scenario spend and margin. Without any lift every delta is exactly 0."""
    margin = settings.gross_margin if margin is None else margin
    base = (F.col("clv_12m") if "clv_12m" in scores.columns
            else F.col("expected_purchases_12m") * F.col("expected_avg_order_value")).cast("double")
    hit = F.col("strategy_segment") == segment if segment and "strategy_segment" in scores.columns else F.lit(True)
    df = (scores.withColumn("baseline_spend", base).withColumn("baseline_margin", F.col("baseline_spend") * F.lit(margin))
          .withColumn("is_targeted", F.coalesce(hit, F.lit(False)).cast("int")))
    targeted = F.col("is_targeted") == 1
    alive = F.least(F.lit(1.0), F.col("p_alive") + F.when(targeted, F.lit(p_alive_lift)).otherwise(F.lit(0.0)))
    factor = F.when(F.col("p_alive") > 0, F.col("p_alive_scen") / F.greatest(F.lit(1e-5), F.col("p_alive"))).otherwise(F.lit(1.0))
    lifts = F.when(targeted, F.lit((1.0 + freq_lift) * (1.0 + aov_lift))).otherwise(F.lit(1.0))
    flat = all(abs(v) < 1e-9 for v in (freq_lift, aov_lift, p_alive_lift))
    spend = F.col("baseline_spend") if flat else F.col("baseline_spend") * factor * lifts
    return (df.withColumn("p_alive_scen", alive).withColumn("scenario_spend", spend)
            .withColumn("scenario_margin", F.col("scenario_spend") * F.lit(margin))
            .withColumn("delta_spend", F.lit(0.0) if flat else F.col("scenario_spend") - F.col("baseline_spend"))
            .withColumn("delta_margin", F.lit(0.0) if flat else F.col("scenario_margin") - F.col("baseline_margin")))


def margin_scenario(scores: DataFrame, freq_lift: float = 0.0, aov_lift: float = 0.0, p_alive_lift: float = 0.0,
                    margin: float | None = None, cost_per_customer: float = 0.0, segment: str | None = None,
                    settings: Settings = DEFAULTS) -> DataFrame:
    """Portfolio totals of a margin scenario, its deltas, campaign cost, net impact and return."""
    df = margin_panel(scores, freq_lift, aov_lift, p_alive_lift, margin, segment, settings)
    names = ("baseline_spend", "baseline_margin", "scenario_spend", "scenario_margin", "delta_spend", "delta_margin")
    one = df.agg(F.count(F.lit(1)).alias("n_customers"), F.sum("is_targeted").alias("n_targeted"),
                 *[F.sum(c).alias(f"total_{c}") for c in names])
    cost = F.col("n_targeted") * F.lit(float(cost_per_customer))
    net = F.col("total_delta_margin") - F.col("total_campaign_cost")
    return (one.withColumn("gross_margin_pct", F.lit(settings.gross_margin if margin is None else margin))
            .withColumn("total_campaign_cost", cost).withColumn("net_financial_impact", net)
            .withColumn("roi_pct", F.when(F.col("total_campaign_cost") > 0,
                                          net / F.greatest(F.lit(1.0), F.col("total_campaign_cost")) * F.lit(100.0)).otherwise(F.lit(0.0))))
