"""Panel construction and known-effect injection on the test tables (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfield.config import DEFAULTS
from tallyfield.functions.numeric import round_half
from tallyfield.operators import panel
from tallyfield.plans import panel_sql as ps
from tallyfield.plans.frames import EARLY_T0, T0, Frames, mart
from tallyfield.plans.sqltext import rnd

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Frames(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that summation order cannot show."""
    return df.select(*[round_half(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def weekly(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "weekly", lambda: panel.weekly_orders(f.lines()))


def customers(f: Frames, mode: str = "stratified_random") -> DataFrame:
    return mart(f.spark, f.sf_dir, f"customers_{mode}", lambda: panel.customer_table(f.lines(), T0, mode=mode))


def panel_customers(f: Frames, scenario: str = "baseline", mode: str = "stratified_random") -> DataFrame:
    return mart(f.spark, f.sf_dir, f"panel_{scenario}_{mode}", lambda: panel.panel_customers(customers(f, mode), weekly(f), T0, DEFAULTS, scenario))


def policy_panel(f: Frames, scenario: str = "baseline", mode: str = "stratified_random") -> DataFrame:
    return panel.unfold_panel(panel_customers(f, scenario, mode), T0, aliases=False)


def panel_beside(f: Frames, scenario: str = "baseline", mode: str = "stratified_random"):
    """Gives the policy panel with further columns per customer, which are joined before the weeks unfold."""
    return lambda extra: panel.with_customer_columns(panel_customers(f, scenario, mode), extra, T0)


@query("p1_weekly_orders", f"WITH {ps.LINES}, {ps.WEEKLY} SELECT * FROM weekly")
def p1(f):
    return panel.weekly_orders(f.lines())


@query("p2_eligible_customers", f"""WITH {ps.LINES}, {ps.WEEKLY},
  fw AS (SELECT customer_id, min(week_date) AS first_week FROM weekly GROUP BY customer_id HAVING min(week_date) < DATE '{EARLY_T0}')
  SELECT w.* FROM weekly w WHERE customer_id IN (SELECT customer_id FROM fw)""")
def p2(f):
    """An early t0, so that most customers are not eligible."""
    return panel.eligible_weekly(weekly(f), EARLY_T0)


@query("p3_pre_period_summary", f"""WITH {ps.customers()} SELECT customer_id, pre_spend, pre_orders,
  {rnd('median_order_val', 4)} AS median_order_val, first_week FROM pre""")
def p3(f):
    return panel.pre_summary(f.lines(), T0).withColumn("median_order_val", round_half("median_order_val", 4))


@query("p4_order_rates", f"""WITH {ps.customers()} SELECT customer_id, pre_weeks, {rnd('raw_pre_order_rate', 9)} AS raw_pre_order_rate,
  {rnd('pre_order_rate', 9)} AS pre_order_rate FROM base""")
def p4(f):
    rates = panel.order_rates(panel.pre_summary(f.lines(), T0), T0)
    return rounded(rates.select("customer_id", "pre_weeks", "raw_pre_order_rate", "pre_order_rate"), 9)


@query("p5_spend_quintile", f"WITH {ps.customers()} SELECT customer_id, pre_spend, spend_quintile FROM base")
def p5(f):
    return panel.spend_quintiles(panel.pre_summary(f.lines(), T0)).select("customer_id", "pre_spend", "spend_quintile")


@query("p6_stratified_assignment", f"WITH {ps.customers()} SELECT customer_id, spend_quintile, is_treated FROM cust")
def p6(f):
    return customers(f).select("customer_id", "spend_quintile", "is_treated")


@query("p7_spend_growth", f"""WITH {ps.customers()} SELECT g.customer_id, early_spend, late_spend, {rnd('spend_growth', 9)} AS spend_growth
  FROM growth g JOIN base b ON g.customer_id = b.customer_id""")
def p7(f):
    return panel.spend_growth(f.lines(), T0).withColumn("spend_growth", round_half("spend_growth", 9))


@query("p8_confounded_assignment", f"""WITH {ps.customers(mode='confounded')} SELECT customer_id, {rnd('spend_growth', 9)} AS spend_growth,
  is_treated FROM cust""")
def p8(f):
    return rounded(customers(f, "confounded").select("customer_id", "spend_growth", "is_treated"), 9)


@query("p9_balanced_panel", f"WITH {ps.customers()}, {ps.grid()} SELECT * FROM bal")
def p9(f):
    end = panel.last_week(weekly(f), T0).scalar()
    return panel.balanced_panel(customers(f).select("customer_id", "first_week"), weekly(f), end).drop("first_week")


@query("p10_post_step", f"WITH {ps.panel()} SELECT customer_id, week_date, post_step, is_post_period FROM panel")
def p10(f):
    end = panel.last_week(weekly(f), T0).scalar()
    grid = panel.balanced_panel(customers(f).select("customer_id", "first_week"), weekly(f), end)
    return panel.with_post_step(grid, T0).select("customer_id", "week_date", "post_step", "is_post_period")



def _hazards(scenario):
    return (f"SELECT * FROM (WITH {ps.panel(scenario=scenario)} SELECT '{scenario}' AS scenario, customer_id, churn_step, "
            f"{rnd('h', 9)} AS weekly_hazard FROM churn, hz WHERE churn_step IS NOT NULL)")


@query("p11_churn_hazard", " UNION ALL ".join(_hazards(s) for s in ("baseline", "hidden_degradation", "severe")))
def p11(f):
    end = panel.last_week(weekly(f), T0).scalar()
    parts = None
    for scenario in ("baseline", "hidden_degradation", "severe"):
        hazard = panel.weekly_hazard(scenario, panel.post_week_count(end, T0))
        one = (panel.with_churn_step(customers(f), hazard).where(F.col("churn_step").isNotNull())
               .select(F.lit(scenario).alias("scenario"), "customer_id", "churn_step", round_half(hazard, 9).alias("weekly_hazard")))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _panel_query(name, columns, scenario="baseline", mode="stratified_random", digits=6):
    doubles = {c for c in columns if c.startswith(("observed", "counterfactual", "realized", "expected", "true", "weekly",
                                                   "active", "cf_spend", "median", "pre_order", "raw_pre", "spend_growth"))}
    sql_cols = ", ".join(f"{rnd(c, digits)} AS {c}" if c in doubles else c for c in columns)

    @query(name, f"WITH {ps.panel(scenario=scenario, mode=mode)} SELECT {sql_cols} FROM panel")
    def run(f):
        return rounded(policy_panel(f, scenario, mode).select(*columns), digits)
    return run


_KEY = ["customer_id", "week_date"]
_panel_query("p12_effect_injection", [*_KEY, "is_treated", "is_churned", "observed_weekly_orders", "observed_weekly_spend",
                                      "counterfactual_weekly_orders", "counterfactual_weekly_spend"])
_panel_query("p12_effect_injection_degraded", [*_KEY, "is_treated", "churn_step", "is_churned", "observed_weekly_orders",
                                               "observed_weekly_spend"], scenario="hidden_degradation")
_panel_query("p12_effect_injection_severe", [*_KEY, "is_treated", "churn_step", "is_churned", "observed_weekly_orders",
                                             "observed_weekly_spend"], scenario="severe")
_panel_query("p12_effect_injection_confounded", [*_KEY, "is_treated", "spend_growth", "observed_weekly_orders",
                                                 "observed_weekly_spend_winsor"], mode="confounded")
_panel_query("p13_realized_and_expected", [*_KEY, "realized_effect_orders", "realized_effect_spend", "expected_effect_orders",
                                           "expected_effect_spend"])
_panel_query("p14_winsorized_spend", [*_KEY, "counterfactual_weekly_spend_winsor", "observed_weekly_spend_winsor",
                                      "realized_effect_spend_winsor", "expected_effect_spend_winsor"])
_panel_query("p15_active_last_90d", [*_KEY, "counterfactual_active_last_90d", "observed_active_last_90d",
                                     "realized_effect_active_last_90d"])

_TRUTH = (("realized_orders", "realized_effect_orders"), ("expected_orders", "expected_effect_orders"),
          ("realized_spend_winsor", "realized_effect_spend_winsor"), ("expected_spend_winsor", "expected_effect_spend_winsor"),
          ("realized_spend_raw", "realized_effect_spend"), ("expected_spend_raw", "expected_effect_spend"),
          ("realized_active_90d", "realized_effect_active_last_90d"))
_HIT = "FROM panel WHERE is_treated = 1 AND is_post_period = 1"


def _truth_sql(scenario="baseline"):
    means = ", ".join(f"{rnd(f'avg({c})', 6)} AS {a}" for a, c in _TRUTH)
    return (f"WITH {ps.panel(scenario=scenario)} SELECT 'overall' AS cohort, {means} {_HIT} UNION ALL "
            f"SELECT 'q1_to_q4_pooled', {means} {_HIT} AND spend_quintile < 5 UNION ALL SELECT 'q5', {means} {_HIT} AND spend_quintile = 5")


@query("p16_ground_truth", _truth_sql())
def p16(f):
    return rounded(panel.ground_truth(policy_panel(f)))


@query("p16_ground_truth_degraded", _truth_sql("hidden_degradation"))
def p16d(f):
    return rounded(panel.ground_truth(policy_panel(f, "hidden_degradation")))


@query("p17_ground_truth_by_quintile", f"""WITH {ps.panel()} SELECT spend_quintile, count(DISTINCT customer_id) AS treated_customers,
  {rnd('avg(realized_effect_orders)', 6)} AS realized_orders, {rnd('avg(expected_effect_orders)', 6)} AS expected_orders,
  {rnd('avg(realized_effect_spend_winsor)', 6)} AS realized_spend_winsor, {rnd('avg(expected_effect_spend_winsor)', 6)} AS expected_spend_winsor,
  {rnd('avg(realized_effect_active_last_90d)', 6)} AS realized_active_90d {_HIT} GROUP BY spend_quintile""")
def p17(f):
    return rounded(panel.ground_truth_by_quintile(policy_panel(f)))


_ALIASES = (("true_effect_orders", "realized_effect_orders"), ("true_effect_spend", "realized_effect_spend"),
            ("true_effect_spend_winsor", "realized_effect_spend_winsor"),
            ("true_effect_active_last_90d", "realized_effect_active_last_90d"), ("weekly_orders", "observed_weekly_orders"),
            ("weekly_spend", "observed_weekly_spend"), ("weekly_spend_winsor", "observed_weekly_spend_winsor"),
            ("active_last_90d", "observed_active_last_90d"))


@query("p18_legacy_aliases", f"WITH {ps.panel()} SELECT customer_id, week_date, "
       + ", ".join(f"{rnd(c, 6)} AS {a}" for a, c in _ALIASES) + " FROM panel")
def p18(f):
    return rounded(panel.with_aliases(policy_panel(f)).select("customer_id", "week_date", *[a for a, _ in _ALIASES]))


@query("p18_flat_truth", f"""WITH {ps.panel()} SELECT {rnd('avg(realized_effect_orders)', 6)} AS weekly_orders,
  {rnd('avg(realized_effect_spend)', 6)} AS weekly_spend_raw, {rnd('avg(realized_effect_spend_winsor)', 6)} AS weekly_spend_winsor,
  {rnd('avg(realized_effect_active_last_90d)', 6)} AS active_last_90d {_HIT}""")
def p18f(f):
    return rounded(panel.ground_truth_flat(policy_panel(f)))
