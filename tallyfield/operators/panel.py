"""Balanced customer-by-week panel, treatment assignment and known-effect injection.

Everything that belongs to a customer is joined while there is one row per customer; the week rows
are exploded last, from that row, so the panel itself (customers x weeks) is never shuffled, sorted or written.
All draws are hashes of (customer, week, seed), so the panel does not depend on the cluster.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.config import DEFAULTS, Settings
from tallyfield.functions.durable import stored
from tallyfield.functions.numeric import hash_uniform, money_sum, qcut_bin, week_of
from tallyfield.functions.ordering import (exact_percentiles, group_percentile, group_row_number, value_ranks,
                                           with_row_number)

# fixed values: outcomes as (metric, observed column, realized-effect column)
OUTCOMES = (
    ("weekly_orders", "observed_weekly_orders", "realized_effect_orders"),
    ("weekly_spend_winsor", "observed_weekly_spend_winsor", "realized_effect_spend_winsor"),
    ("active_last_90d", "observed_active_last_90d", "realized_effect_active_last_90d"),
)
# fixed values: cohorts as (key, label, quintiles)
COHORTS = (
    ("overall", "Overall (All Treated)", (1, 2, 3, 4, 5)),
    ("q1_to_q4_pooled", "Q1-Q4 Pooled", (1, 2, 3, 4)),
    ("q5", "Quintile 5 (Top Spend)", (5,)),
)


def monday_on_or_before(day: str) -> date:
    d = date.fromisoformat(day)
    return d - timedelta(days=d.weekday())


def monday_on_or_after(day: str) -> date:
    d = date.fromisoformat(day)
    return d + timedelta(days=-d.weekday() % 7)


def weekly_orders(lines: DataFrame) -> DataFrame:
    return (lines.withColumn("week_date", week_of("invoice_date")).groupBy("customer_id", "week_date")
            .agg(F.count_distinct("invoice_no").alias("cf_orders"), money_sum("line_total").alias("cf_spend")))


def first_weeks(weekly: DataFrame, t0: str) -> DataFrame:
    """First order week per customer, for customers whose first week starts before t0."""
    return (weekly.groupBy("customer_id").agg(F.min("week_date").alias("first_week"))
            .where(F.col("first_week") < F.lit(t0).cast("date")))


def eligible_weekly(weekly: DataFrame, t0: str) -> DataFrame:
    return weekly.join(first_weeks(weekly, t0).select("customer_id"), "customer_id", "left_semi")


def pre_invoices(lines: DataFrame, t0: str) -> DataFrame:
    return (lines.where(F.col("invoice_date") < F.lit(t0).cast("timestamp_ntz"))
            .groupBy("customer_id", "invoice_no", "invoice_date")
            .agg(money_sum("line_total").alias("order_val")))


def pre_summary(lines: DataFrame, t0: str) -> DataFrame:
    return invoice_summary(pre_invoices(lines, t0))


def invoice_summary(invoices: DataFrame) -> DataFrame:
    """Pre-period spend, orders, median order value and first week, per customer with an order before t0.

    A customer with an order before t0 has its first week before t0, so eligibility needs no second table.
    """
    sums = invoices.groupBy("customer_id").agg(
        money_sum("order_val").alias("pre_spend"), F.count(F.lit(1)).alias("pre_orders"),
        week_of(F.min("invoice_date")).alias("first_week"))
    medians = group_percentile(invoices, ["customer_id"], "order_val", 0.5, "median_order_val")
    return sums.join(medians, "customer_id")


def order_rates(summary: DataFrame, t0: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Weeks at risk, raw order rate and the repeat rate shrunken towards the global repeat rate."""
    start = F.lit(monday_on_or_before(t0).isoformat()).cast("date")
    weeks = F.greatest(F.lit(1), F.floor(F.date_diff(start, F.col("first_week")) / 7)).cast("bigint")
    repeats = F.greatest(F.lit(0).cast("bigint"), F.col("pre_orders") - 1)
    base = summary.withColumn("pre_weeks", weeks)
    pooled = base.agg(F.when(F.sum("pre_weeks") > 0, F.sum(repeats) / F.sum("pre_weeks"))
                      .otherwise(F.lit(settings.fallback_repeat_rate))).scalar()
    beta = F.lit(settings.shrinkage_weeks)
    return (base.withColumn("raw_pre_order_rate", F.col("pre_orders") / F.col("pre_weeks"))
            .withColumn("pre_order_rate", (repeats + pooled * beta) / (F.col("pre_weeks") + beta)))


def spend_quintiles(summary: DataFrame, bins: int = 5, out: str = "spend_quintile", spend: str = "pre_spend") -> DataFrame:
    ranked = with_row_number(summary, [spend, "customer_id"], out="__rn")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(out, qcut_bin("__rn", n, bins)).drop("__rn")


def spend_growth(lines: DataFrame, t0: str, settings: Settings = DEFAULTS) -> DataFrame:
    return invoice_growth(pre_invoices(lines, t0), t0, settings)


def invoice_growth(invoices: DataFrame, t0: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(late - early) / (late + early + damping), halves of each customer's own span up to t0.

    The first date comes from a join, not a window: a customer holding many invoices is split by
    the skew-join rule instead of being sorted in one task.
    """
    firsts = invoices.groupBy("customer_id").agg(F.min("invoice_date").alias("__first"))
    end = F.lit(t0).cast("timestamp_ntz")

    def micros(c: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)

    late = (micros(F.col("invoice_date")) - micros(F.col("__first"))) * 2 >= micros(end) - micros(F.col("__first"))
    halves = (invoices.join(firsts, "customer_id")
              .groupBy("customer_id").agg(
                  money_sum(F.when(~late, F.col("order_val")).otherwise(0.0)).alias("early_spend"),
                  money_sum(F.when(late, F.col("order_val")).otherwise(0.0)).alias("late_spend")))
    e, l = F.col("early_spend"), F.col("late_spend")
    return halves.withColumn("spend_growth", (l - e) / (l + e + F.lit(settings.growth_damping)))


def assign_stratified(customers: DataFrame, settings: Settings = DEFAULTS, stratum: str = "spend_quintile") -> DataFrame:
    """Exactly round(n * share) treated customers per stratum, the ones with the smallest draws."""
    drawn = customers.withColumn("__u", hash_uniform("customer_id", F.lit(settings.seed)))
    ranked = group_row_number(drawn, [stratum], ["__u", "customer_id"], out="__rn", size_out="__n")
    quota = F.rint(F.col("__n") * F.lit(settings.treatment_share))
    return ranked.withColumn("is_treated", (F.col("__rn") <= quota).cast("int")).drop("__u", "__rn", "__n")


def growth_ranks(customers: DataFrame) -> DataFrame:
    """Percentile rank of spend growth with average ties."""
    ranks = value_ranks(customers, "spend_growth").select(
        F.col("spend_growth").alias("__g"), ((F.col("below") + (F.col("cnt") + 1) / 2) / F.col("n")).alias("growth_rank"))
    return customers.join(ranks, F.col("spend_growth") == F.col("__g")).drop("__g")


def assign_confounded(customers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Treat the customers whose growth rank reaches the (1 - share) quantile of the ranks."""
    ranked = growth_ranks(customers)
    cut = exact_percentiles(ranked, "growth_rank", {"cut": 1.0 - settings.treatment_share})
    return ranked.withColumn("is_treated", (F.col("growth_rank") >= cut.scalar()).cast("int")).drop("growth_rank")


def assign(customers: DataFrame, settings: Settings = DEFAULTS, mode: str = "stratified_random") -> DataFrame:
    return assign_confounded(customers, settings) if mode.lower() == "confounded" else assign_stratified(customers, settings)


def customer_table(lines: DataFrame, t0: str, settings: Settings = DEFAULTS, mode: str = "stratified_random") -> DataFrame:
    """One row per eligible customer: rates, quintile, growth, treatment."""
    invoices = stored(pre_invoices(lines, t0), "pre-invoices")  # read by the sums, the medians and both growth steps
    base = spend_quintiles(invoice_summary(invoices).join(
        invoice_growth(invoices, t0, settings).select("customer_id", "spend_growth"), "customer_id"))
    return assign(order_rates(base, t0, settings), settings, mode)


def last_week(weekly: DataFrame, t0: str) -> DataFrame:
    """One row: the last order week of any eligible customer."""
    per = weekly.groupBy("customer_id").agg(F.min("week_date").alias("f"), F.max("week_date").alias("l"))
    return per.where(F.col("f") < F.lit(t0).cast("date")).agg(F.max("l").alias("last_week"))


def with_order_weeks(customers: DataFrame, weekly: DataFrame, end: Column) -> DataFrame:
    """One row per customer with the map of its order weeks and the last week of the panel.

    A customer has at most one entry per calendar week, so its map is bounded by the calendar. Customers are dealt evenly over a fixed number of partitions:
    adaptive coalescing sees only their few bytes, not the weeks that each of them unfolds to.
    """
    entries = weekly.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(
        F.struct("week_date", F.struct("cf_orders", "cf_spend")))).alias("__weeks"))
    wide = customers.join(entries, "customer_id", "left").withColumn("__end", end)
    return wide.repartition(int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "customer_id")


def unfold_weeks(wide: DataFrame) -> DataFrame:
    """Every Monday from a customer's first week to its end; weeks without orders are 0."""
    grid = wide.withColumn("week_date", F.explode(F.sequence("first_week", "__end", F.expr("INTERVAL 7 DAYS"))))
    cell = F.try_element_at("__weeks", F.col("week_date"))
    return (grid.withColumn("cf_orders", F.coalesce(cell.getField("cf_orders"), F.lit(0)).cast("int"))
            .withColumn("cf_spend", F.coalesce(cell.getField("cf_spend"), F.lit(0.0)))
            .drop("__weeks", "__end"))


def balanced_panel(customers: DataFrame, weekly: DataFrame, end: Column) -> DataFrame:
    """Every Monday from a customer's first week to ``end``; weeks without orders are 0."""
    return unfold_weeks(with_order_weeks(customers, weekly, end))


def post_week_count(end: Column, t0: str) -> Column:
    first_post = F.lit(monday_on_or_after(t0).isoformat()).cast("date")
    return F.greatest(F.lit(0), F.floor(F.date_diff(end, first_post) / 7) + 1).cast("int")


def post_ordinal(week: Column, t0: str) -> Column:
    """1 for the first Monday on or after t0, 2 for the next."""
    first_post = F.lit(monday_on_or_after(t0).isoformat()).cast("date")
    return (F.floor(F.date_diff(week, first_post) / 7) + 1).cast("int")


def with_post_step(panel: DataFrame, t0: str) -> DataFrame:
    """Ordinal of the post-policy week (NULL before) and the post flag."""
    step = F.when(F.col("week_date") >= F.lit(t0).cast("date"), post_ordinal(F.col("week_date"), t0))
    return panel.withColumn("post_step", step).withColumn("is_post_period", step.isNotNull().cast("int"))


def weekly_hazard(scenario: str, n_post_weeks: Column, settings: Settings = DEFAULTS) -> Column:
    """Weekly churn hazard of a named scenario; 'severe' is given per week, the others cumulatively."""
    name = scenario.lower()
    if name == "severe":
        return F.lit(settings.severe_weekly_hazard)
    cumulative = settings.cumulative_churn
    if name == "hidden_degradation" and cumulative == DEFAULTS.cumulative_churn:
        cumulative = settings.degraded_churn
    return F.lit(1.0) - F.pow(F.lit(1.0 - cumulative), F.lit(1.0) / F.greatest(F.lit(1), n_post_weeks))


def geometric_step(u: Column, hazard: Column) -> Column:
    """Geometric waiting time (1, 2, ...) by inversion."""
    return F.greatest(F.lit(1), F.ceil(F.log(F.lit(1.0) - u) / F.log(F.lit(1.0) - hazard))).cast("bigint")


def with_churn_step(customers: DataFrame, hazard: Column, settings: Settings = DEFAULTS) -> DataFrame:
    u = hash_uniform("customer_id", F.lit("churn"), F.lit(settings.seed))
    at_risk = (F.col("spend_quintile") == 5) & (F.col("is_treated") == 1)
    return customers.withColumn("churn_step", F.when(at_risk, geometric_step(u, hazard)))


def clip(c: Column, low: float, high: Column) -> Column:
    return F.least(F.greatest(c, F.lit(low)), high)


def winsor_limit(weekly: DataFrame, customers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: exact 99th percentile of positive weekly spend.

    Positive panel weeks are exactly the order weeks of the panel's customers, so the sparse
    weekly table answers this without building the panel.
    """
    spend = (weekly.join(customers.select("customer_id"), "customer_id", "left_semi")
             .where(F.col("cf_spend") > 0))
    cut = exact_percentiles(spend, "cf_spend", {"limit": 0.99})
    return cut.select(F.coalesce("limit", F.lit(settings.winsor_fallback)).alias("limit"))


def order_probability(settings: Settings = DEFAULTS) -> Column:
    """Chance that a treated customer orders in a post week that had no order."""
    return clip(F.col("pre_order_rate") * F.lit(settings.order_rate_change), 0.0, F.lit(1.0))


def adds_order(week: Column, settings: Settings = DEFAULTS) -> Column:
    return hash_uniform("customer_id", week, F.lit(settings.seed)) < order_probability(settings)


def inject_effects(panel: DataFrame, limit: Column, settings: Settings = DEFAULTS, added: Column | None = None) -> DataFrame:
    """Observed, counterfactual, realized and expected outcomes of treated customers after t0.

    added: whether the draw of the row adds an order, where it is known already.
    """
    orders, spend = F.col("cf_orders").cast("double"), F.col("cf_spend")
    active = (F.col("is_treated") == 1) & (F.col("is_post_period") == 1)
    churned = active & F.col("is_churned")
    empty = active & ~F.col("is_churned") & (F.col("cf_orders") == 0)
    buying = active & ~F.col("is_churned") & (F.col("cf_orders") > 0)
    scale = F.lit(1.0 + settings.aov_change)
    new_value = F.col("median_order_val") * scale
    prob = order_probability(settings)
    # the hash is only taken for the rows that need a draw
    added = adds_order(F.col("week_date"), settings) if added is None else added
    p = panel.withColumn("__added", F.when(empty, added).otherwise(F.lit(False)))
    zero = F.lit(0.0)
    added_c = F.col("__added")
    obs_orders = F.when(churned, zero).when(empty, F.when(added_c, F.lit(1.0)).otherwise(zero)).otherwise(orders)
    obs_spend = (F.when(churned, zero).when(empty, F.when(added_c, new_value).otherwise(zero))
                 .when(buying, spend * scale).otherwise(spend))
    cf_win = clip(spend, 0.0, limit)
    p = (p.withColumn("observed_weekly_orders", obs_orders)
         .withColumn("observed_weekly_spend", obs_spend)
         .withColumn("counterfactual_weekly_orders", orders)
         .withColumn("counterfactual_weekly_spend", spend)
         .withColumn("counterfactual_weekly_spend_winsor", cf_win)
         .withColumn("observed_weekly_spend_winsor", clip(F.col("observed_weekly_spend"), 0.0, limit)))
    p = (p.withColumn("realized_effect_orders", F.col("observed_weekly_orders") - orders)
         .withColumn("realized_effect_spend", F.col("observed_weekly_spend") - spend)
         .withColumn("realized_effect_spend_winsor", F.col("observed_weekly_spend_winsor") - F.col("counterfactual_weekly_spend_winsor"))
         .withColumn("expected_effect_orders", F.when(churned, -orders).when(empty, prob).otherwise(zero))
         .withColumn("expected_effect_spend", F.when(churned, -spend).when(empty, prob * new_value)
                     .when(buying, spend * F.lit(settings.aov_change)).otherwise(zero))
         .withColumn("expected_effect_spend_winsor",
                     F.when(churned, -F.col("counterfactual_weekly_spend_winsor"))
                     .when(empty, prob * clip(new_value, 0.0, limit))
                     .when(buying, clip(spend * scale, 0.0, limit) - F.col("counterfactual_weekly_spend_winsor"))
                     .otherwise(zero)))
    return p.drop("__added")


MASK_BITS = 64  # weeks in one number of a customer's list of active weeks


def with_active_weeks(wide: DataFrame, t0: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Weeks that have an order in the trailing 13 weeks, without and with the policy, as two lists per customer: bit b of the number at i
    stands for the week 64 i + b after the first, so that a week is looked up without a search.

    They follow from the few order weeks and the added ones, so the panel needs no sort for them.
    """
    start, step = F.lit(t0).cast("date"), F.col("churn_step")
    bought = F.map_keys(F.map_filter("__weeks", lambda _, cell: cell.getField("cf_orders") > 0))
    ordered = F.coalesce(bought, F.lit([]).cast("array<date>"))
    window = settings.active_window_weeks

    def stays(week: Column) -> Column:
        return (week < start) | step.isNull() | (post_ordinal(week, t0) <= step)

    def ones(low: Column, high: Column) -> Column:
        width = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(MASK_BITS - 1) - (high - low))
        return F.when(low <= high, F.call_function("shiftleft", width, low)).otherwise(F.lit(0).cast("bigint"))

    def reach(weeks: Column) -> Column:
        aligned = F.filter(F.transform(weeks, lambda w: F.date_diff(w, F.col("first_week"))), lambda d: d % 7 == 0)
        at = F.transform(aligned, lambda d: F.floor(d / 7).cast("int"))
        words = F.sequence(F.lit(0), F.floor(F.date_diff(F.col("__end"), F.col("first_week")) / (7 * MASK_BITS)).cast("int"))
        return F.transform(words, lambda i: F.aggregate(at, F.lit(0).cast("bigint"), lambda mask, x: mask.bitwiseOR(
            ones(F.greatest(x - i * MASK_BITS, F.lit(0)), F.least(x + (window - 1) - i * MASK_BITS, F.lit(MASK_BITS - 1))))))
    with_added = F.array_union(ordered, F.coalesce("__added", F.lit([]).cast("array<date>")))
    return wide.withColumns({"__cf_active": reach(ordered), "__obs_active": reach(F.filter(with_added, stays))})


def with_recent_activity(panel: DataFrame) -> DataFrame:
    """Any order in the trailing 13 weeks: whether the week is one of the customer's active weeks."""
    at = F.floor(F.date_diff(F.col("week_date"), F.col("first_week")) / 7).cast("int")
    mask = [F.get(c, F.floor(at / MASK_BITS).cast("int")) for c in ("__cf_active", "__obs_active")]
    active = [F.call_function("shiftrightunsigned", m, at % MASK_BITS).bitwiseAND(F.lit(1)).cast("double") for m in mask]
    return (panel.withColumn("counterfactual_active_last_90d", active[0]).withColumn("observed_active_last_90d", active[1])
            .withColumn("realized_effect_active_last_90d",
                        F.col("observed_active_last_90d") - F.col("counterfactual_active_last_90d"))
            .withColumn("expected_effect_active_last_90d", F.col("realized_effect_active_last_90d")))


def with_aliases(panel: DataFrame) -> DataFrame:
    """Older column names kept for callers that still use them."""
    return panel.withColumns({
        "true_effect_orders": F.col("realized_effect_orders"),
        "true_effect_spend": F.col("realized_effect_spend"),
        "true_effect_spend_winsor": F.col("realized_effect_spend_winsor"),
        "true_effect_active_last_90d": F.col("realized_effect_active_last_90d"),
        "weekly_orders": F.col("observed_weekly_orders"),
        "weekly_spend": F.col("observed_weekly_spend"),
        "weekly_spend_winsor": F.col("observed_weekly_spend_winsor"),
        "active_last_90d": F.col("observed_active_last_90d")})


def policy_panel(lines: DataFrame, t0: str, settings: Settings = DEFAULTS, scenario: str | None = None,
                 mode: str = "stratified_random", aliases: bool = True) -> DataFrame:
    """The full panel: assignment, churn, injected effects, all outcomes."""
    weekly = stored(weekly_orders(lines), "weekly")
    customers = customer_table(lines, t0, settings, mode)
    return panel_from(customers, weekly, t0, settings, scenario, aliases)


def panel_from(customers: DataFrame, weekly: DataFrame, t0: str, settings: Settings = DEFAULTS,
               scenario: str | None = None, aliases: bool = True) -> DataFrame:
    return unfold_panel(stored(panel_customers(customers, weekly, t0, settings, scenario), "panel-customers"), t0, settings, aliases)


def panel_customers(customers: DataFrame, weekly: DataFrame, t0: str, settings: Settings = DEFAULTS, scenario: str | None = None) -> DataFrame:
    """One row per customer with all that its panel weeks follow from: its attributes, order weeks, draws, last week and winsor limit."""
    end = last_week(weekly, t0).scalar()
    hazard = weekly_hazard(scenario or settings.churn_scenario, post_week_count(end, t0), settings)
    limit = winsor_limit(weekly, customers, settings).scalar()
    keep = with_churn_step(customers, hazard, settings).select(
        "customer_id", "first_week", "is_treated", "spend_quintile", "median_order_val", "pre_order_rate",
        "raw_pre_order_rate", "spend_growth", "churn_step")
    wide = with_order_weeks(keep, weekly, end).withColumn("__limit", limit)
    post = F.filter(F.sequence("first_week", "__end", F.expr("INTERVAL 7 DAYS")), lambda w: (w >= F.lit(t0).cast("date")) & adds_order(w, settings))
    return wide.withColumn("__added", F.when(F.col("is_treated") == 1, post))


def unfold_panel(wide: DataFrame, t0: str, settings: Settings = DEFAULTS, aliases: bool = True) -> DataFrame:
    """The panel of ``panel_customers``. It is not written: readers unfold the weeks again and work out only the columns they use.

    Columns that the customer rows have beside (a cohort, a decile) are carried to their weeks, so joins with the panel can be made on customers.
    """
    panel = with_post_step(unfold_weeks(with_active_weeks(wide, t0, settings)), t0)
    panel = panel.withColumn("is_churned", (F.col("is_post_period") == 1) & F.col("churn_step").isNotNull()
                             & F.coalesce(F.col("post_step") > F.col("churn_step"), F.lit(False)))
    effects = inject_effects(panel, F.col("__limit"), settings, F.array_contains("__added", F.col("week_date")))
    full = with_recent_activity(effects).drop("first_week", "__limit", "__added", "__cf_active", "__obs_active")
    return with_aliases(full) if aliases else full


def with_customer_columns(wide: DataFrame, extra: DataFrame, t0: str, settings: Settings = DEFAULTS, aliases: bool = False) -> DataFrame:
    """The panel with the columns that ``extra`` has per customer: joined and stored while there is one row per customer, unfolded after."""
    n = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return unfold_panel(stored(wide.join(extra, "customer_id", "left").repartition(n, "customer_id"), "panel-customers"), t0, settings, aliases)


def cohort_flags(quintile: str = "spend_quintile") -> Column:
    """Array of the cohort keys a customer belongs to."""
    flags = [F.when(F.col(quintile).isin(*members), F.lit(key)) for key, _, members in COHORTS]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def ground_truth(panel: DataFrame) -> DataFrame:
    """Average effect on the treated per cohort, realized and expected, one row per cohort."""
    hit = panel.where((F.col("is_treated") == 1) & (F.col("is_post_period") == 1))
    # pre-aggregate per quintile first: the cohort explosion then touches five rows, not the panel
    per = hit.groupBy("spend_quintile").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in (
            "realized_effect_orders", "expected_effect_orders", "realized_effect_spend_winsor",
            "expected_effect_spend_winsor", "realized_effect_spend", "expected_effect_spend",
            "realized_effect_active_last_90d")])
    rows = per.withColumn("cohort", F.explode(cohort_flags())).groupBy("cohort")

    def mean(c: str) -> Column:
        return F.sum(c) / F.sum("n")

    return rows.agg(
        mean("realized_effect_orders").alias("realized_orders"), mean("expected_effect_orders").alias("expected_orders"),
        mean("realized_effect_spend_winsor").alias("realized_spend_winsor"),
        mean("expected_effect_spend_winsor").alias("expected_spend_winsor"),
        mean("realized_effect_spend").alias("realized_spend_raw"), mean("expected_effect_spend").alias("expected_spend_raw"),
        mean("realized_effect_active_last_90d").alias("realized_active_90d"))


def ground_truth_flat(panel: DataFrame) -> DataFrame:
    """The overall row under its older flat names."""
    return ground_truth(panel).where(F.col("cohort") == "overall").select(
        F.col("realized_orders").alias("weekly_orders"), F.col("realized_spend_raw").alias("weekly_spend_raw"),
        F.col("realized_spend_winsor").alias("weekly_spend_winsor"), F.col("realized_active_90d").alias("active_last_90d"))


def ground_truth_by_quintile(panel: DataFrame) -> DataFrame:
    hit = panel.where((F.col("is_treated") == 1) & (F.col("is_post_period") == 1))
    per = hit.groupBy("spend_quintile", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("realized_effect_orders").alias("ro"), F.sum("expected_effect_orders").alias("eo"),
        F.sum("realized_effect_spend_winsor").alias("rw"), F.sum("expected_effect_spend_winsor").alias("ew"),
        F.sum("realized_effect_active_last_90d").alias("ra"))
    n = F.sum("n")
    return per.groupBy("spend_quintile").agg(
        F.count(F.lit(1)).alias("treated_customers"), (F.sum("ro") / n).alias("realized_orders"),
        (F.sum("eo") / n).alias("expected_orders"), (F.sum("rw") / n).alias("realized_spend_winsor"),
        (F.sum("ew") / n).alias("expected_spend_winsor"), (F.sum("ra") / n).alias("realized_active_90d"))
