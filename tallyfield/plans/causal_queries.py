"""Causal estimators on the policy panel of the test tables (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.numeric import round_half
from tallyfield.operators import did, event_study
from tallyfield.operators.panel import OUTCOMES
from tallyfield.plans import panel_sql as ps
from tallyfield.plans.frames import T0, Frames
from tallyfield.plans.panel_queries import panel_beside, policy_panel, rounded
from tallyfield.plans.sqltext import qcut, rnd

QUERIES = {}
ORACLES = {}
ESTIMATES = tuple((label, column) for label, column, _ in OUTCOMES)
STEPS = 80  # of the alternating projection in the comparison SQL


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Frames(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def scaled(df: DataFrame, columns, key: str = "outcome") -> DataFrame:
    """Spend results to 3 digits, the small share and count effects to 7."""
    money = F.col(key).contains("spend")
    return df.select(*[F.when(money, round_half(c, 3)).otherwise(round_half(c, 7)).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def srnd(x: str, key: str = "outcome") -> str:
    return f"CASE WHEN contains({key}, 'spend') THEN {rnd(x, 3)} ELSE {rnd(x, 7)} END"


def normal_p(z: str) -> str:
    """Two-sided normal p-value by Simpson's rule over the density."""
    t = f"least(abs({z}), 40.0e0)"
    return (f"(SELECT greatest(0.0e0, 1.0e0 - {t} / 6000.0e0 * sum(CASE WHEN i IN (0, 2000) THEN 1 ELSE 2 + 2 * (i % 2) END * exp(-pow({t} * i / 2000.0e0, 2) / 2.0e0)"
            f" * sqrt(2.0e0 / pi()))) FROM range(0, 2001) g(i))")


def chi2_p(x: str, df: str) -> str:
    """Upper tail of chi-square by the power series of the incomplete gamma function."""
    return (f"CASE WHEN {x} > 1000 THEN 0.0e0 ELSE (SELECT greatest(0.0e0, 1.0e0 - sum(exp((({df}) / 2.0e0 + n) * ln(greatest({x}, 1e-300) / 2.0e0) - {x} / 2.0e0"
            f" - lgamma(({df}) / 2.0e0 + n + 1.0e0)))) FROM range(0, 2000) g(n)) END")


def twfe_sql(rows: str, outcomes, dof: str = "absorbed") -> str:
    """Alternating projection on week vectors (panels run from a first week to a common last one).

    ``rows``: a CTE named src(g, customer_id, week_date, d, <outcome columns>).
    """
    longs = " UNION ALL ".join(f"SELECT g, customer_id, week_date, '{label}' AS outcome, d, {col} AS y FROM src" for label, col in outcomes)
    scale = ("gg / (gg - 1.0e0) * (nn - 1.0e0) / (nn - gg - ww)" if dof == "cr1"
             else "nn / greatest(1.0e0, nn - (gg + ww - 1) - 1)")
    return f"""{rows},
lng AS ({longs}),
both2 AS (SELECT g, outcome, customer_id, week_date, 'd' AS v, d AS x FROM lng
  UNION ALL SELECT g, outcome, customer_id, week_date, 'y', y FROM lng),
ci AS (SELECT g, outcome, v, customer_id, min(week_date) AS f, avg(x) AS m FROM both2 GROUP BY ALL),
fm AS (SELECT g, outcome, v, f, count(*) AS nf, sum(m) AS sm FROM ci GROUP BY ALL),
col AS (SELECT g, outcome, v, week_date, count(*) AS c, sum(x) AS sx FROM both2 GROUP BY ALL),
base2 AS (SELECT col.*, coalesce(nf, 0) AS nf,
  sx - sum(coalesce(sm, 0.0e0)) OVER (PARTITION BY col.g, col.outcome, col.v ORDER BY week_date) AS rhs
  FROM col LEFT JOIN fm ON col.g = fm.g AND col.outcome = fm.outcome AND col.v = fm.v AND col.week_date = fm.f),
it AS (SELECT 0 AS k, g, outcome, v, week_date, nf, c, rhs, 0.0e0 AS gam FROM base2
  UNION ALL
  SELECT k + 1, g, outcome, v, week_date, nf, c, rhs,
    (rhs + sum(nf * tail) OVER (PARTITION BY g, outcome, v ORDER BY week_date ROWS UNBOUNDED PRECEDING)) / c
  FROM (SELECT *, avg(gam) OVER (PARTITION BY g, outcome, v ORDER BY week_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM it)
  WHERE k < {STEPS}),
gam AS (SELECT g, outcome, v, week_date, gam FROM it WHERE k = {STEPS}),
lft AS (SELECT l.g, l.outcome, l.customer_id, l.week_date, l.d - a.gam AS a, l.y - b.gam AS b FROM lng l
  JOIN gam a ON l.g = a.g AND l.outcome = a.outcome AND l.week_date = a.week_date AND a.v = 'd'
  JOIN gam b ON l.g = b.g AND l.outcome = b.outcome AND l.week_date = b.week_date AND b.v = 'y'),
dm AS (SELECT g, outcome, customer_id, week_date, a - avg(a) OVER w AS dt, b - avg(b) OVER w AS yt FROM lft
  WINDOW w AS (PARTITION BY g, outcome, customer_id)),
tau AS (SELECT g, outcome, sum(dt * dt) AS den, sum(dt * yt) / nullif(sum(dt * dt), 0) AS tau, CAST(count(*) AS DOUBLE) AS nn,
  CAST(count(DISTINCT customer_id) AS DOUBLE) AS gg, CAST(count(DISTINCT week_date) AS DOUBLE) AS ww FROM dm GROUP BY ALL),
meat AS (SELECT g, outcome, sum(s * s) AS meat FROM (SELECT dm.g, dm.outcome, customer_id, sum(dt * (yt - tau * dt)) AS s
  FROM dm JOIN tau ON dm.g = tau.g AND dm.outcome = tau.outcome GROUP BY ALL) GROUP BY ALL),
est AS (SELECT t.g, t.outcome, CAST(nn AS BIGINT) AS n_obs, CAST(gg AS BIGINT) AS n_customers,
  CASE WHEN den > 1e-12 THEN tau END AS estimated_att,
  CASE WHEN den > 1e-12 THEN sqrt(meat / (den * den) * ({scale})) END AS std_err, NOT coalesce(den > 1e-12, FALSE) AS degenerate
  FROM tau t JOIN meat m ON t.g = m.g AND t.outcome = m.outcome)"""


_COHORT_SRC = """src AS (SELECT c.g, customer_id, week_date, CAST(is_treated * is_post_period AS DOUBLE) AS d, observed_weekly_orders,
  observed_weekly_spend_winsor, observed_active_last_90d FROM panel JOIN (VALUES ('overall', 1, 5), ('q1_to_q4_pooled', 1, 4), ('q5', 5, 5)) c(g, lo, hi)
  ON spend_quintile BETWEEN lo AND hi)"""
_EST = f"""n_obs, n_customers, {srnd('estimated_att')} AS estimated_att, {srnd('std_err')} AS std_err,
  {srnd('estimated_att - 1.95996e0 * std_err')} AS ci_lower, {srnd('estimated_att + 1.95996e0 * std_err')} AS ci_upper,
  {rnd('estimated_att / nullif(std_err, 0.0e0)', 4)} AS t_stat, CASE WHEN std_err > 0 THEN {rnd(normal_p('estimated_att / std_err'), 6)} END AS p_value, degenerate"""
_VALUES = ("estimated_att", "std_err", "ci_lower", "ci_upper")
_KEEP = ("outcome", "n_obs", "n_customers", "estimated_att", "std_err", "ci_lower", "ci_upper", "t_stat", "p_value", "degenerate")


def _rec(cte: str) -> str:
    return f"WITH RECURSIVE {cte}"


def _estimates(df, *keys):
    return scaled(df, _VALUES).withColumns({"t_stat": round_half("t_stat", 4), "p_value": round_half("p_value", 6)}).select(*keys, *_KEEP)


@query("e1_twfe_did", _rec(ps.panel()) + ", " + twfe_sql(_COHORT_SRC, ESTIMATES) + f" SELECT g AS cohort, outcome, {_EST} FROM est")
def e1(f):
    return _estimates(did.twfe_by_cohort(policy_panel(f), ESTIMATES), "cohort")


_WITHIN = """src AS (SELECT 'all' AS g, customer_id, week_date, CAST(is_treated * is_post_period AS DOUBLE) AS d,
  observed_weekly_orders FROM panel)"""


@query("e2_two_way_within", _rec(ps.panel()) + ", " + twfe_sql(_WITHIN, ESTIMATES[:1]) + f""" SELECT customer_id, week_date,
  {rnd('yt', 6)} AS within FROM dm""")
def e2(f):
    return rounded(did.two_way_within(policy_panel(f).select("customer_id", "week_date", "observed_weekly_orders"),
                                      "observed_weekly_orders").select("customer_id", "week_date", "within"))


@query("e3_clustered_errors_degraded", _rec(ps.panel(scenario="hidden_degradation")) + ", " + twfe_sql(_COHORT_SRC, ESTIMATES)
       + f" SELECT g AS cohort, outcome, {_EST} FROM est")
def e3(f):
    return _estimates(did.twfe_by_cohort(policy_panel(f, "hidden_degradation"), ESTIMATES), "cohort")


_ARMS = """src AS (SELECT is_treated AS g, customer_id, week_date, CAST(is_treated * is_post_period AS DOUBLE) AS d,
  observed_weekly_orders, observed_weekly_spend_winsor, observed_active_last_90d FROM panel)"""


@query("e4_degenerate_arms", _rec(ps.panel()) + ", " + twfe_sql(_ARMS, ESTIMATES) + f" SELECT g AS is_treated, outcome, {_EST} FROM est")
def e4(f):
    """Inside one arm the treatment is absorbed by the week effects, so nothing can be estimated."""
    p = policy_panel(f).withColumn("arm", F.col("is_treated"))
    return _estimates(did.twfe(p, ESTIMATES, ["arm"]), "arm").withColumnRenamed("arm", "is_treated")


@query("e5_many_outcomes_cr1", _rec(ps.panel()) + ", " + twfe_sql(_COHORT_SRC, ESTIMATES, "cr1") + f" SELECT g AS cohort, outcome, {_EST} FROM est")
def e5(f):
    return _estimates(did.twfe_by_cohort(policy_panel(f), ESTIMATES, "cr1"), "cohort")


_OUTCOME = "observed_weekly_spend_winsor"


def cells_sql(outcome: str = _OUTCOME, scenario: str = "baseline", mode: str = "stratified_random") -> str:
    rel = f"greatest(-10, least(26, CAST(floor(date_diff('day', DATE '{T0}', week_date) / 7.0e0) AS INTEGER)))"
    parts = ", ".join(f"{agg}(CASE WHEN is_treated = {a} THEN {outcome} END) AS {n}_{a}" for a in (1, 0)
                      for n, agg in (("mean", "avg"), ("count", "count"), ("std", "stddev_samp")))
    return f"""{ps.panel(scenario=scenario, mode=mode)}, cells AS (SELECT {rel} AS rel_week, {parts} FROM panel GROUP BY 1),
dif AS (SELECT rel_week, mean_1 - mean_0 AS diff, std_1 * std_1 / count_1 + std_0 * std_0 / count_0 AS v FROM cells),
bs AS (SELECT count(*) AS K, avg(diff) AS base, sum(v) / (count(*) * count(*)) AS vb FROM dif WHERE rel_week < 0)"""


def cells(f, mode="stratified_random"):
    return event_study.cells(policy_panel(f, "baseline", mode), T0, _OUTCOME)


@query("e6_event_study", f"""WITH {cells_sql()}, ev AS (SELECT rel_week, diff - base AS beta,
  sqrt(CASE WHEN rel_week >= 0 THEN v + vb ELSE greatest(1e-8, (1.0e0 - 2.0e0 / K) * v + vb) END) AS se FROM dif, bs)
  SELECT rel_week, {rnd('beta', 4)} AS beta, {rnd('se', 4)} AS se, {rnd('beta - 1.96e0 * se', 4)} AS ci_lower,
  {rnd('beta + 1.96e0 * se', 4)} AS ci_upper, CASE WHEN rel_week >= 0 THEN 1 ELSE 0 END AS is_post FROM ev""")
def e6(f):
    return rounded(event_study.event_study(cells(f)), 4)


@query("e7_event_cells", f"""WITH {cells_sql()} SELECT rel_week, {rnd('mean_1', 4)} AS mean_1, count_1, {rnd('std_1', 4)} AS std_1,
  {rnd('mean_0', 4)} AS mean_0, count_0, {rnd('std_0', 4)} AS std_0 FROM cells""")
def e7(f):
    return rounded(cells(f), 4)


_SUMMARY = f""", cen AS (SELECT sum(diff / v) / sum(1.0e0 / v) AS c FROM dif WHERE rel_week < 0),
  chi AS (SELECT count(*) AS npre, sum((diff - c) * (diff - c) / v) AS x FROM dif, cen WHERE rel_week < 0),
  po AS (SELECT count(*) AS m, avg(diff) AS pg, sum(v) AS sv FROM dif WHERE rel_week >= 0)
  SELECT npre AS n_pre, m AS n_post, {rnd('x', 5)} AS joint_test_stat, npre - 1 AS joint_test_df, {rnd('pg - base', 4)} AS mean_post_att,
  {rnd('sqrt(sv / (m * m) + vb)', 4)} AS mean_post_se, {rnd(chi2_p('x', 'npre - 1'), 7)} AS joint_test_pval, {chi2_p('x', 'npre - 1')} >= 0.05e0 AS parallel_trends_pass
  FROM chi, po, bs"""


def _summary(df):
    return df.select("n_pre", "n_post", round_half("joint_test_stat", 5).alias("joint_test_stat"),
                     F.col("joint_test_df").cast("bigint").alias("joint_test_df"),
                     round_half("mean_post_att", 4).alias("mean_post_att"), round_half("mean_post_se", 4).alias("mean_post_se"),
                     round_half("joint_test_pval", 7).alias("joint_test_pval"), "parallel_trends_pass")


@query("e8_pretrend_test", f"WITH {cells_sql()}{_SUMMARY}")
def e8(f):
    return _summary(event_study.event_summary(cells(f)))


@query("e8_pretrend_test_confounded", f"WITH {cells_sql(mode='confounded')}{_SUMMARY}")
def e8c(f):
    return _summary(event_study.event_summary(cells(f, "confounded")))


@query("e9_mean_post_effect", f"""WITH {cells_sql(scenario='hidden_degradation')}, po AS (SELECT count(*) AS m, avg(diff) AS pg, sum(v) AS sv FROM dif WHERE rel_week >= 0)
  SELECT m AS n_post, {rnd('pg - base', 5)} AS mean_post_att, {rnd('sqrt(sv / (m * m) + vb)', 5)} AS mean_post_se FROM po, bs""")
def e9(f):
    """Mean effect after the policy with its delta-method error, under hidden degradation."""
    found = event_study.event_summary(event_study.cells(policy_panel(f, "hidden_degradation"), T0, _OUTCOME))
    return rounded(found.select("n_post", "mean_post_att", "mean_post_se"), 5)


_PLACEBO = f"""pp AS (SELECT * FROM panel WHERE week_date < DATE '{T0}'),
 sp AS (SELECT min(week_date) AS lo, max(week_date) AS hi FROM pp),
 src AS (SELECT 'all' AS g, customer_id, week_date, CASE WHEN is_treated = 1 AND date_diff('day', lo, week_date) * 2 >= date_diff('day', lo, hi)
   THEN 1.0e0 ELSE 0.0e0 END AS d, observed_weekly_spend_winsor FROM pp, sp)"""


@query("e14_placebo_date", _rec(ps.panel()) + ", " + twfe_sql(_PLACEBO, [(_OUTCOME, _OUTCOME)]) + f""" SELECT outcome,
  {rnd('estimated_att', 3)} AS placebo_att, {rnd('std_err', 3)} AS std_err, {rnd(normal_p('estimated_att / std_err'), 6)} AS p_value,
  {normal_p('estimated_att / std_err')} > 0.05e0 OR abs(estimated_att) < 0.5e0 AS test_passed FROM est""")
def e14(f):
    est = did.placebo_date(policy_panel(f), T0, _OUTCOME)
    return est.select("outcome", round_half("placebo_att", 3).alias("placebo_att"), round_half("std_err", 3).alias("std_err"),
                      round_half("p_value", 6).alias("p_value"), "test_passed")


_DECILE = f"""ds AS (SELECT customer_id, round(sum(observed_weekly_spend), 4) AS s FROM panel WHERE is_post_period = 0 GROUP BY customer_id),
 dr AS (SELECT customer_id, row_number() OVER (ORDER BY s, customer_id) AS rn, count(*) OVER () AS n FROM ds),
 dd AS (SELECT customer_id, 'D' || lpad(CAST({qcut('rn', 'n', 10)} AS VARCHAR), 2, '0') AS g FROM dr),
 src AS (SELECT g, p.customer_id, week_date, CAST(is_treated * is_post_period AS DOUBLE) AS d, observed_weekly_spend_winsor
   FROM panel p JOIN dd ON p.customer_id = dd.customer_id)"""


@query("e17_heterogeneity", _rec(ps.panel()) + ", " + twfe_sql(_DECILE, [(_OUTCOME, _OUTCOME)]) + f""",
  tr AS (SELECT g, count(DISTINCT p.customer_id) AS cc, count(DISTINCT CASE WHEN is_treated = 1 THEN p.customer_id END) AS tc,
    avg(CASE WHEN is_treated = 1 AND is_post_period = 1 THEN realized_effect_spend_winsor END) AS ta FROM panel p JOIN dd ON p.customer_id = dd.customer_id GROUP BY g)
  SELECT tr.g AS decile, cc AS customer_count, tc AS treated_count, {rnd('coalesce(ta, 0.0e0)', 3)} AS true_att,
  CASE WHEN tc >= 10 AND tc < cc THEN {rnd('estimated_att', 3)} END AS estimated_did_att,
  CASE WHEN tc >= 10 AND tc < cc THEN {rnd('std_err', 3)} END AS std_err,
  CASE WHEN tc >= 10 AND tc < cc THEN {rnd(normal_p('estimated_att / std_err'), 6)} END AS p_value,
  CASE WHEN tc >= 10 AND tc < cc THEN {rnd(f"least(1.0e0, 10.0e0 * {normal_p('estimated_att / std_err')})", 5)} END AS p_value_bonferroni, NOT (tc >= 10 AND tc < cc AND NOT degenerate) AS degenerate
  FROM tr JOIN est ON tr.g = est.g""")
def e17(f):
    h = did.heterogeneity(policy_panel(f), beside=panel_beside(f))
    digits = {"true_att": 3, "estimated_did_att": 3, "std_err": 3, "p_value": 6, "p_value_bonferroni": 5}
    return h.select(*[round_half(c, digits[c]).alias(c) if c in digits else F.col(c) for c in h.columns])
