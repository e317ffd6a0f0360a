"""Synthetic control, power analysis, decisions and result lookups on the test tables (E10-E23, D, O5, O6, Q10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.numeric import round_half
from tallyfield.operators import decisions, did, evaluation, power, quality, reporting, synthetic
from tallyfield.plans import clv_sql as cs
from tallyfield.plans import panel_sql as ps
from tallyfield.plans.causal_queries import _COHORT_SRC, _DECILE, _OUTCOME, ESTIMATES, _rec, normal_p, srnd, twfe_sql
from tallyfield.plans.clv_queries import scores
from tallyfield.plans.frames import T0, Frames, code_version, mart
from tallyfield.plans.panel_queries import customers, panel_beside, panel_customers, policy_panel, rounded, weekly
from tallyfield.plans.sqltext import rnd, u01

QUERIES = {}
ORACLES = {}
SPEND = evaluation.SPEND
DONORS = 50
REPLICATIONS = 50  # fixed value: of the published power analysis


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Frames(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ------------------------------------------------------------------ synthetic control

def donors(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "donors", lambda: synthetic.donor_cohorts(panel_customers(f), DONORS))


def series(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "trajectories", lambda: synthetic.trajectories(panel_beside(f)(donors(f)), SPEND))


def matrix(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "donor_matrix", lambda: synthetic.donor_matrix(series(f), T0))


def fits(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "sc_fits", lambda: synthetic.refits(matrix(f)))


_DONOR = f"""ctl AS (SELECT customer_id, row_number() OVER (ORDER BY {u01('customer_id', '42')}, customer_id) AS rn, count(*) OVER () AS n
   FROM (SELECT DISTINCT customer_id FROM panel WHERE is_treated = 0)),
 dn AS (SELECT customer_id, CAST((rn - 1) % least({DONORS}, n) AS INTEGER) AS donor_cohort FROM ctl),
 tj AS (SELECT week_date, CASE WHEN is_treated = 1 THEN -1 ELSE donor_cohort END AS series, CAST(sum(CAST({SPEND} AS DECIMAL(38, 8))) AS DOUBLE) / count({SPEND}) AS y
   FROM panel p LEFT JOIN dn ON p.customer_id = dn.customer_id GROUP BY 1, 2)"""


@query("e10_donor_trajectories", f"WITH {ps.panel()}, {_DONOR} SELECT week_date, CAST(series AS INTEGER) AS series, {rnd('y', 4)} AS mean_outcome FROM tj")
def e10(f):
    return rounded(series(f), 4)


@query("e11_donor_weights")
def e11(f):
    return synthetic.weight_table(fits(f))


_W = [(j + 1) / (DONORS * (DONORS + 1) / 2) for j in range(DONORS)]


@query("e12_gap_with_fixed_weights", f"""WITH {ps.panel()}, {_DONOR},
  wk AS (SELECT DISTINCT week_date FROM tj WHERE series = -1),
  sy AS (SELECT wk.week_date, sum(coalesce(y, 0.0e0) * (s.series + 1) / {DONORS * (DONORS + 1) / 2}e0) AS s FROM wk CROSS JOIN (SELECT DISTINCT series FROM tj WHERE series >= 0) s
    LEFT JOIN tj ON tj.week_date = wk.week_date AND tj.series = s.series GROUP BY wk.week_date),
  gp AS (SELECT t.week_date, t.y - sy.s AS g FROM tj t JOIN sy ON t.week_date = sy.week_date WHERE t.series = -1)
  SELECT {rnd(f"avg(CASE WHEN week_date >= DATE '{T0}' THEN g END)", 3)} AS estimated_att,
    {rnd(f"sqrt(avg(CASE WHEN week_date < DATE '{T0}' THEN g * g END))", 3)} AS pre_rmspe FROM gp""")
def e12w(f):
    return rounded(synthetic.gap_with_weights(matrix(f), _W), 3)


@query("e12_synthetic_control")
def e12(f):
    return synthetic.summary(fits(f))


@query("e13_placebo_in_space")
def e13(f):
    return fits(f).where(F.col("kind") == synthetic.PLACEBO).select("donor", "estimated_att", "pre_rmspe")


@query("e15_leave_one_donor_out")
def e15(f):
    return synthetic.leave_one_out(fits(f))


_REFITS = f"""WITH {ps.panel()}, {_DONOR}, nd AS (SELECT 1 + max(donor_cohort) AS n FROM dn)
  SELECT 'main' AS kind, CAST(-1 AS INTEGER) AS donor, TRUE AS feasible, TRUE AS optimal, TRUE AS effect_confirmed, TRUE AS own_weight_zero
  UNION ALL SELECT kind, CAST(i AS INTEGER), TRUE, TRUE, TRUE, TRUE FROM nd, range(0, n) r(i), (VALUES ('placebo'), ('leave_one_out')) k(kind)"""


@query("e11_weight_certificates", _REFITS)
def e11c(f):
    """Main weights and those of every placebo and left-out donor (E13, E15): feasible, optimal, and their effects recomputed."""
    return synthetic.certificates(fits(f), matrix(f))


@query("e16_refutation_suite")
def e16(f):
    return evaluation.refutation_suite(policy_panel(f), T0, beside=panel_beside(f))


# ------------------------------------------------------------------ evaluation tables

def core(f: Frames, scenario: str = "baseline") -> DataFrame:
    return mart(f.spark, f.sf_dir, f"core_{scenario}", lambda: evaluation.core_results(policy_panel(f, scenario)))


def evaluated(f: Frames, scenario: str = "baseline") -> DataFrame:
    return mart(f.spark, f.sf_dir, f"evaluation_{scenario}", lambda: evaluation.full_evaluation(policy_panel(f, scenario), T0, beside=panel_beside(f, scenario)))


@query("e18_full_evaluation")
def e18(f):
    return evaluated(f)


@query("e19_both_scenarios")
def e19(f):
    return (evaluated(f).withColumn("scenario", F.lit("baseline"))
            .unionByName(evaluated(f, "hidden_degradation").withColumn("scenario", F.lit("hidden_degradation"))))


def replications(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "replications", lambda: power.replications(customers(f), weekly(f), T0, REPLICATIONS))


@query("e20_replications")
def e20(f):
    return replications(f)


@query("e21_replication_summary")
def e21(f):
    return power.replication_summary(replications(f))


_REPS = _rec(ps.panel()) + ", " + twfe_sql(_DECILE, [(_OUTCOME, _OUTCOME)]) + f""",
  tr AS (SELECT g, count(DISTINCT p.customer_id) AS cc, count(DISTINCT CASE WHEN is_treated = 1 THEN p.customer_id END) AS tc,
    coalesce(avg(CASE WHEN is_treated = 1 AND is_post_period = 1 THEN realized_effect_spend_winsor END), 0.0e0) AS ta FROM panel p JOIN dd ON p.customer_id = dd.customer_id GROUP BY g),
  reps AS (SELECT tr.g, ta AS true_att, estimated_att AS e, std_err AS se, estimated_att - ta AS err,
    CASE WHEN ta BETWEEN estimated_att - 1.95996e0 * std_err AND estimated_att + 1.95996e0 * std_err THEN 1.0e0 ELSE 0.0e0 END AS hit,
    CASE WHEN {normal_p('estimated_att / std_err')} < 0.05e0 THEN 1.0e0 ELSE 0.0e0 END AS sig FROM tr JOIN est ON tr.g = est.g WHERE tc >= 10 AND tc < cc AND NOT degenerate)"""


def decile_replications(f: Frames) -> DataFrame:
    """The estimates of the spend deciles in the form of replications: ten draws with their truths, all from the given tables."""
    h = did.heterogeneity(policy_panel(f), beside=panel_beside(f)).where(~F.col("degenerate"))
    e, se, truth = F.col("estimated_did_att"), F.col("std_err"), F.col("true_att")
    inside = (e - did.Z95 * se <= truth) & (truth <= e + did.Z95 * se)
    return h.select(F.lit("baseline").alias("scenario"), "decile", F.lit(evaluation.OVERALL).alias("cohort"), F.lit("weekly_spend_winsor").alias("outcome"),
                    "true_att", e.alias("estimated_att"), se.alias("standard_error"), (e - truth).alias("error"), ((e - truth) * (e - truth)).alias("sq_error"),
                    inside.cast("int").alias("ci_covered"), (F.col("p_value") < 0.05).cast("int").alias("rejected_at_5pct"))


@query("e21_summary_of_deciles", _REPS + f""" SELECT 'baseline' AS Scenario, '{evaluation.OVERALL}' AS Cohort, 'weekly_spend_winsor' AS Outcome, count(*) AS Replications,
  {rnd('avg(true_att)', 3)} AS Mean_True_ATT, {rnd('avg(e)', 3)} AS Mean_Estimated_ATT, {rnd('avg(err)', 3)} AS Mean_Bias, {rnd('sqrt(avg(err * err))', 3)} AS RMSE,
  {rnd('avg(se)', 3)} AS Mean_SE, {rnd('avg(hit)', 6)} AS Coverage_95pct, {rnd('avg(sig)', 6)} AS Rejection_Rate_5pct FROM reps""")
def e21d(f):
    s = power.replication_summary(decile_replications(f))
    digits = {"Coverage_95pct": 6, "Rejection_Rate_5pct": 6}
    return s.select(*[round_half(c, digits.get(c, 3)).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("e22_assignment_benchmark")
def e22(f):
    parts = None
    for mode in ("stratified_random", "confounded"):
        one = evaluation.assignment_benchmark(policy_panel(f, "baseline", mode), T0, mode, code_version(), "benchmark", beside=panel_beside(f, mode=mode))
        one = one.withColumn("mode", F.lit(mode))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("e23_side_by_side")
def e23(f):
    both = (core(f).withColumn("scenario", F.lit("baseline"))
            .unionByName(core(f, "hidden_degradation").withColumn("scenario", F.lit("hidden_degradation"))))
    return power.side_by_side(both, power.replication_summary(replications(f)), decisions.DID_MODEL)


# ------------------------------------------------------------------ result lookups

_LABEL = ("CASE g WHEN 'overall' THEN 'Overall (All Treated)' WHEN 'q1_to_q4_pooled' THEN 'Q1-Q4 Pooled' ELSE 'Quintile 5 (Top Spend)' END")


def results_sql(scenario: str = "baseline") -> str:
    """The fixed-effects rows of the result table, as CTE res."""
    return ps.panel(scenario=scenario) + ", " + twfe_sql(_COHORT_SRC, ESTIMATES) + f""",
 tru AS (SELECT c.g, avg(realized_effect_orders) AS o, avg(realized_effect_spend_winsor) AS s, avg(realized_effect_active_last_90d) AS a
   FROM panel JOIN (VALUES ('overall', 1, 5), ('q1_to_q4_pooled', 1, 4), ('q5', 5, 5)) c(g, lo, hi) ON spend_quintile BETWEEN lo AND hi
   WHERE is_treated = 1 AND is_post_period = 1 GROUP BY c.g),
 res AS (SELECT 'TWFE DiD (PanelOLS)' AS Estimator_Model, est.g, {_LABEL.replace('CASE g', 'CASE est.g')} AS Cohort, outcome AS Outcome_Metric, estimated_att AS Estimated_ATT,
   CASE outcome WHEN 'weekly_orders' THEN o WHEN 'weekly_spend_winsor' THEN s ELSE a END AS True_ATT, std_err AS Standard_Error,
   estimated_att - 1.95996e0 * std_err AS ci_lower, estimated_att + 1.95996e0 * std_err AS ci_upper FROM est JOIN tru ON est.g = tru.g)"""


@query("e23_side_by_side_deciles", f"""WITH RECURSIVE {results_sql()}
  SELECT 'baseline' AS scenario, Cohort AS cohort, Outcome_Metric AS outcome, {srnd('True_ATT', 'Outcome_Metric')} AS true_att,
  {srnd('Estimated_ATT', 'Outcome_Metric')} AS estimated_att, {srnd('ci_lower', 'Outcome_Metric')} AS ci_lower, {srnd('ci_upper', 'Outcome_Metric')} AS ci_upper,
  CASE WHEN g = 'overall' AND Outcome_Metric = 'weekly_spend_winsor' THEN (SELECT {rnd('avg(hit)', 6)} FROM ({_REPS} SELECT hit FROM reps)) END AS mc_coverage FROM res""")
def e23d(f):
    """Truth, estimate and interval of each result beside the coverage over the deciles, where there is one."""
    one = power.side_by_side(core(f).withColumn("scenario", F.lit("baseline")), power.replication_summary(decile_replications(f)), decisions.DID_MODEL)
    money = F.col("outcome").contains("spend")
    values = [F.when(money, round_half(c, 3)).otherwise(round_half(c, 7)).alias(c) for c in ("true_att", "estimated_att", "ci_lower", "ci_upper")]
    return one.select("scenario", "cohort", "outcome", *values, round_half("mc_coverage", 6).alias("mc_coverage"))


_KEY = "Outcome_Metric"
_RES = ", ".join(f"{srnd(c, _KEY)} AS {c}" for c in ("Estimated_ATT", "True_ATT", "Standard_Error", "ci_lower", "ci_upper"))


def _res(df: DataFrame, *extra: str) -> DataFrame:
    money = F.col(_KEY).contains("spend")
    vals = [F.when(money, round_half(c, 3)).otherwise(round_half(c, 7)).alias(c)
            for c in ("Estimated_ATT", "True_ATT", "Standard_Error", "ci_lower", "ci_upper")]
    return df.select("Estimator_Model", "Cohort", "Outcome_Metric", *vals, *extra)


@query("o5_lookup_result", f"WITH RECURSIVE {results_sql()} SELECT Estimator_Model, Cohort, Outcome_Metric, {_RES} FROM res WHERE g = 'overall' AND Outcome_Metric = 'weekly_orders'")
def o5(f):
    return _res(reporting.lookup_result(core(f), evaluation.OVERALL, "weekly_orders", decisions.DID_MODEL))


@query("o6_cohort_gap", f"""WITH RECURSIVE {results_sql('hidden_degradation')} SELECT Estimator_Model, Cohort, Outcome_Metric, {_RES},
  CASE WHEN Outcome_Metric = 'active_last_90d' THEN {rnd('Estimated_ATT * 100.0e0', 5)} END AS att_pp FROM res WHERE g <> 'overall'""")
def o6(f):
    gap = reporting.cohort_gap(core(f, "hidden_degradation"), decisions.DID_MODEL, ["Q1-Q4 Pooled", decisions.TOP_COHORT])
    return _res(gap.withColumn("att_pp", round_half("att_pp", 5)), "att_pp")


@query("q10_result_differences", f"""WITH RECURSIVE {results_sql()}, core AS (SELECT * FROM res WHERE g <> 'q5')
  SELECT Estimator_Model, Cohort, Outcome_Metric, {rnd('Estimated_ATT * 1.0e0', 3)} AS Estimated_ATT_committed,
  {rnd('Estimated_ATT * 1.001e0', 3)} AS Estimated_ATT_regenerated FROM core WHERE abs(Estimated_ATT * 0.001e0) > 1e-5""")
def q10(f):
    """Old against new estimates, the new ones off by a tenth of a percent: only large enough ones are reported."""
    old = core(f).where((F.col("Estimator_Model") == decisions.DID_MODEL) & (F.col("Cohort") != decisions.TOP_COHORT))
    new = old.withColumn("Estimated_ATT", F.col("Estimated_ATT") * F.lit(1.001))
    d = quality.result_differences(old, new)
    return rounded(d.select("Estimator_Model", "Cohort", "Outcome_Metric", "Estimated_ATT_committed", "Estimated_ATT_regenerated"), 3)


# ------------------------------------------------------------------ decisions

_SEG = f"""sc70 AS (SELECT quantile_cont(clv_12m, 0.7) AS cut FROM scores),
 seg AS (SELECT scores.*, CASE WHEN clv_12m >= cut AND p_alive >= 0.75e0 THEN '{decisions.SEGMENTS[0]}' WHEN clv_12m >= cut THEN '{decisions.SEGMENTS[1]}'
   WHEN p_alive >= 0.75e0 THEN '{decisions.SEGMENTS[2]}' ELSE '{decisions.SEGMENTS[3]}' END AS strategy_segment FROM scores, sc70),
 ss AS (SELECT strategy_segment, count(*) AS customer_count, avg(clv_12m) AS a12, sum(clv_12m) AS t12, avg(p_alive) AS ap, avg(expected_purchases_12m) AS ao FROM seg GROUP BY 1)"""


def segments(f: Frames) -> DataFrame:
    return decisions.with_segments(scores(f))


@query("d1_segments", f"WITH {cs.SCORES}, {_SEG} SELECT customer_id, clv_12m, p_alive, strategy_segment FROM seg")
def d1(f):
    return segments(f).select("customer_id", "clv_12m", "p_alive", "strategy_segment")


@query("d2_segment_summary", f"""WITH {cs.SCORES}, {_SEG} SELECT strategy_segment, customer_count, {rnd('a12', 3)} AS avg_12m_clv, {rnd('t12', 1)} AS total_12m_clv,
  {rnd('ap', 7)} AS avg_p_alive, {rnd('ao', 5)} AS avg_expected_orders, {rnd('customer_count / (SELECT count(*) FROM seg) * 100.0e0', 1)} AS pct_of_customers,
  {rnd('t12 / (SELECT sum(clv_12m) FROM seg) * 100.0e0', 1)} AS pct_of_portfolio_val FROM ss""")
def d2(f):
    s = decisions.segment_summary(segments(f))
    digits = {"avg_12m_clv": 3, "total_12m_clv": 1, "avg_p_alive": 7, "avg_expected_orders": 5}
    return s.select(*[round_half(c, digits[c]).alias(c) if c in digits else F.col(c) for c in s.columns])


@query("d3_winback_roi", f"""WITH {cs.SCORES}, {_SEG}, pa AS (SELECT att FROM (WITH {ps.panel()} SELECT avg(observed_weekly_spend - counterfactual_weekly_spend) AS att
    FROM panel WHERE is_treated = 1 AND is_post_period = 1)),
  wb AS (SELECT * FROM ss ORDER BY CASE WHEN strategy_segment = '{decisions.SEGMENTS[1]}' THEN 0 ELSE 1 END, strategy_segment LIMIT 1),
  m AS (SELECT customer_count AS n, customer_count * 15.0e0 AS cost, customer_count * 0.15e0 * (a12 + att * 4.0e0) AS rev FROM wb, pa)
  SELECT 'High-Value Customer Win-Back' AS Campaign_Strategy, 'High CLV + Low P(Alive)' AS Target_Cohort, n AS Targeted_Customers, cost AS Campaign_Cost,
  {rnd('rev', 1)} AS Est_Incremental_Gross_Revenue, {rnd('rev * 0.4e0', 1)} AS Gross_Margin_Dollar, {rnd('rev * 0.4e0 - cost', 1)} AS Net_Financial_Impact,
  {rnd('(rev * 0.4e0 - cost) / greatest(1.0e0, cost) * 100.0e0', 2)} AS ROI_Percent FROM m""")
def d3(f):
    r = decisions.winback_roi(decisions.segment_summary(segments(f)), decisions.average_effect(policy_panel(f)))
    digits = {"Est_Incremental_Gross_Revenue": 1, "Gross_Margin_Dollar": 1, "Net_Financial_Impact": 1, "ROI_Percent": 2}
    return r.select(*[round_half(c, digits[c]).alias(c) if c in digits else F.col(c) for c in r.columns])


_POLICY = """nq AS (SELECT count(DISTINCT customer_id) AS n FROM panel WHERE spend_quintile = 5 AND is_treated = 1),
 po AS (SELECT max(CASE WHEN Outcome_Metric = 'weekly_spend_winsor' THEN Estimated_ATT END) AS att, max(CASE WHEN Outcome_Metric = 'weekly_spend_winsor' THEN ci_lower END) AS lo,
   max(CASE WHEN Outcome_Metric = 'weekly_spend_winsor' THEN ci_upper END) AS hi, max(CASE WHEN Outcome_Metric = 'active_last_90d' THEN Estimated_ATT END) AS aa,
   max(CASE WHEN Outcome_Metric = 'active_last_90d' THEN ci_lower END) AS al FROM res WHERE g = 'q5')"""


def _policy(f, weeks=27, share=0.5):
    return decisions.waiver_policy(core(f, "hidden_degradation"), decisions.top_treated_count(policy_panel(f, "hidden_degradation")), share, weeks)


_HIDDEN = results_sql("hidden_degradation")


def _waiver_sql(weeks, label):
    fac = f"0.4e0 * 0.5e0 * n * {weeks}"
    return f"""WITH RECURSIVE {_HIDDEN}, {_POLICY} SELECT n AS n_q5, CAST({weeks} AS INTEGER) AS weeks, {weeks > 27} AS is_extrapolation, '{label}' AS extrapolation_label,
  {rnd('att', 3)} AS att_q5_spend, {rnd('aa', 7)} AS att_q5_active90, {rnd(f'{fac} * -att', 0)} AS net_margin_change_central, {rnd(f'{fac} * -hi', 0)} AS net_margin_change_low,
  {rnd(f'{fac} * -lo', 0)} AS net_margin_change_high, {rnd('0.5e0 * aa', 7)} AS q5_retention_effect, {rnd('0.5e0 * al', 7)} AS q5_retention_effect_worst FROM nq, po"""


def _waiver(df):
    digits = {"att_q5_spend": 3, "att_q5_active90": 7, "net_margin_change_central": 0, "net_margin_change_low": 0, "net_margin_change_high": 0,
              "q5_retention_effect": 7, "q5_retention_effect_worst": 7}
    return df.select("n_q5", "weeks", "is_extrapolation", "extrapolation_label", *[round_half(c, d).alias(c) for c, d in digits.items()])


@query("d4_waiver_policy", _waiver_sql(27, decisions.WITHIN_WINDOW))
def d4(f):
    return _waiver(_policy(f))


@query("d4_waiver_policy_extrapolated", _waiver_sql(52, decisions.BEYOND_WINDOW))
def d4x(f):
    return _waiver(_policy(f, 80))


@query("d5_sensitivity_curve", f"""WITH RECURSIVE {_HIDDEN}, {_POLICY} SELECT i / 20.0e0 * 100.0e0 AS waiver_share_pct, {rnd('0.4e0 * (i / 20.0e0) * n * 27 * -att', 0)} AS net_margin_change_central,
  {rnd('0.4e0 * (i / 20.0e0) * n * 27 * -hi', 0)} AS net_margin_change_low, {rnd('0.4e0 * (i / 20.0e0) * n * 27 * -lo', 0)} AS net_margin_change_high,
  {rnd('(1.0e0 - i / 20.0e0) * aa * 100.0e0', 5)} AS active_share_impact_pp FROM nq, po, range(21) r(i)""")
def d5(f):
    c = decisions.sensitivity_curve(core(f, "hidden_degradation"), decisions.top_treated_count(policy_panel(f, "hidden_degradation")))
    digits = {"net_margin_change_central": 0, "net_margin_change_low": 0, "net_margin_change_high": 0, "active_share_impact_pp": 5}
    return c.select("waiver_share_pct", *[round_half(x, d).alias(x) for x, d in digits.items()])


def _status(x):
    return f"CASE WHEN {x} >= -0.5e0 THEN 'GREEN' WHEN {x} >= -2.0e0 THEN 'AMBER' ELSE 'RED' END"


@query("d6_guardrails", f"""WITH RECURSIVE {_HIDDEN}, {_POLICY} SELECT 0.5e0 AS waived_share, {rnd('aa * 100.0e0', 5)} AS active_without_waiver_pp, {rnd('0.5e0 * aa * 100.0e0', 5)} AS active_with_waiver_pp,
  {rnd('0.5e0 * aa * 100.0e0 - aa * 100.0e0', 5)} AS active_improvement_pp, {rnd('0.5e0 * al * 100.0e0', 5)} AS worst_case_pp,
  {_status('0.5e0 * aa * 100.0e0')} AS point_status, {_status('0.5e0 * al * 100.0e0')} AS worst_case_status, lo <= 0 AND hi >= 0 AS band_spans_zero FROM nq, po""")
def d6(f):
    return rounded(decisions.guardrails(_policy(f)), 5)


def _margin_sql(freq, aov, alive, cost, segment):
    hit = f"strategy_segment = '{segment}'" if segment else "TRUE"
    spend = (f"clv_12m * CASE WHEN p_alive > 0 THEN least(1.0e0, p_alive + CASE WHEN {hit} THEN {alive}e0 ELSE 0.0e0 END) / greatest(1e-5, p_alive) ELSE 1.0e0 END"
             f" * CASE WHEN {hit} THEN (1.0e0 + {freq}e0) * (1.0e0 + {aov}e0) ELSE 1.0e0 END")
    if freq == aov == alive == 0.0:
        spend = "clv_12m"
    return f"""WITH {cs.SCORES}, {_SEG}, ms AS (SELECT clv_12m AS b, {spend} AS s, {hit} AS hit FROM seg),
  mt AS (SELECT count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS k, sum(b) AS b, sum(s) AS s, sum(s - b) AS d, sum((s - b) * 0.4e0) AS dm FROM ms)
  SELECT n AS n_customers, k AS n_targeted, 0.4e0 AS gross_margin_pct, {rnd('b', 1)} AS total_baseline_spend, {rnd('s', 1)} AS total_scenario_spend,
  {rnd('d', 1)} AS total_delta_spend, {rnd('dm', 1)} AS total_delta_margin, k * {cost}e0 AS total_campaign_cost, {rnd(f'dm - k * {cost}e0', 1)} AS net_financial_impact,
  CASE WHEN k * {cost}e0 > 0 THEN {rnd(f'(dm - k * {cost}e0) / greatest(1.0e0, k * {cost}e0) * 100.0e0', 2)} ELSE 0.0e0 END AS roi_pct FROM mt"""


def _margin(df):
    digits = {"total_baseline_spend": 1, "total_scenario_spend": 1, "total_delta_spend": 1, "total_delta_margin": 1}
    return df.select("n_customers", "n_targeted", "gross_margin_pct", *[round_half(c, d).alias(c) for c, d in digits.items()], "total_campaign_cost",
                     round_half("net_financial_impact", 1).alias("net_financial_impact"), round_half("roi_pct", 2).alias("roi_pct"))


@query("d7_margin_scenario", _margin_sql(0.1, 0.05, 0.05, 15.0, decisions.SEGMENTS[2]))
def d7(f):
    return _margin(decisions.margin_scenario(segments(f), 0.1, 0.05, 0.05, cost_per_customer=15.0, segment=decisions.SEGMENTS[2]))


@query("d8_zero_lift", _margin_sql(0.0, 0.0, 0.0, 0.0, None))
def d8(f):
    return _margin(decisions.margin_scenario(segments(f)))
