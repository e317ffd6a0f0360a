"""All causal estimators next to the known effects, as one long result table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.config import DEFAULTS, Settings
from tallyfield.functions.durable import stored
from tallyfield.operators import did, event_study, synthetic
from tallyfield.operators.decisions import DID_MODEL
from tallyfield.operators.panel import COHORTS, OUTCOMES, ground_truth

# fixed values: result columns and the labels of estimators and cohorts
COLUMNS = ("Estimator_Model", "Cohort", "Outcome_Metric", "Estimated_ATT", "True_ATT", "Absolute_Error", "Standard_Error",
           "ci_lower", "ci_upper", "p_value", "Status")
REALIZED, EXPECTED = "Ground-Truth (Realized)", "Ground-Truth (Expected)"
SYNTHETIC_MODEL = "Synthetic Control (50 Donors)"
EVENT_MODEL = "Event Study (Dynamic Mean)"
PLACEBO_MODEL = "Refutation: Placebo Rollout Date"
LEAVE_OUT_MODEL = "Refutation: Leave-One-Donor-Out SC"
OVERALL = "Overall (All Treated)"
SPEND = "observed_weekly_spend_winsor"
_TRUTH = {"weekly_orders": "realized_orders", "weekly_spend_winsor": "realized_spend_winsor", "active_last_90d": "realized_active_90d"}


def _label(key: str = "cohort") -> Column:
    out = F.lit(None).cast("string")
    for name, label, _ in COHORTS:
        out = F.when(F.col(key) == name, label).otherwise(out)
    return out


def _rows(df: DataFrame, model, cohort, outcome, estimate, truth, se, low, high, p, status) -> DataFrame:
    def c(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v)
    num = [c(v).cast("double") for v in (estimate, truth, F.abs(c(estimate) - c(truth)), se, low, high, p)]
    return df.select(*[v.alias(n) for n, v in zip(COLUMNS, [c(model), c(cohort), c(outcome), *num, c(status)])])


def truth_rows(truth: DataFrame) -> DataFrame:
    """Benchmark rows: realized effects of three outcomes, expected effects of two."""
    spec = [(REALIZED, "weekly_orders", "realized_orders", "BENCHMARK_TRUTH"), (EXPECTED, "weekly_orders", "expected_orders", "EXPECTED_THEORY"),
            (REALIZED, "weekly_spend_winsor", "realized_spend_winsor", "BENCHMARK_TRUTH"),
            (EXPECTED, "weekly_spend_winsor", "expected_spend_winsor", "EXPECTED_THEORY"),
            (REALIZED, "active_last_90d", "realized_active_90d", "BENCHMARK_TRUTH")]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(o).alias("o"), F.col(e).alias("e"), F.col(_TRUTH[o]).alias("t"),
                                        F.lit(s).alias("s")) for m, o, e, s in spec]))
    r = truth.select(_label().alias("c"), rows.alias("r")).select("c", "r.*")
    return _rows(r, F.col("m"), F.col("c"), F.col("o"), F.col("e"), F.col("t"), 0.0, F.col("e"), F.col("e"), 0.0, F.col("s"))


def _long_truth(truth: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(c).alias("truth")) for o, c in _TRUTH.items()]))
    return truth.select("cohort", rows.alias("r")).select("cohort", "r.*")


def did_rows(panel: DataFrame, truth: DataFrame) -> DataFrame:
    est = did.twfe_by_cohort(panel, [(o, c) for o, c, _ in OUTCOMES])
    j = est.join(_long_truth(truth), ["cohort", "outcome"])
    return _rows(j, DID_MODEL, _label(), F.col("outcome"), F.col("estimated_att"), F.col("truth"), F.col("std_err"),
                 F.col("ci_lower"), F.col("ci_upper"), F.col("p_value"), "PRIMARY_ESTIMATOR")


def core_results(panel: DataFrame) -> DataFrame:
    """Known effects and fixed-effects estimates for three cohorts and three outcomes."""
    truth = stored(ground_truth(panel), "truth")
    return truth_rows(truth).unionByName(did_rows(panel, truth))


def full_evaluation(panel: DataFrame, t0: str, settings: Settings = DEFAULTS, n_donors: int = 50,
                    beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every estimator. Small tables that several rows need are stored once.

    beside: gives the panel with columns per customer, where there is a cheaper way than a join with the panel.
    """
    truth = stored(ground_truth(panel), "truth")
    overall = truth.where(F.col("cohort") == "overall")
    real = {o: overall.select(c).scalar() for o, c in _TRUTH.items()}
    null = F.lit(None).cast("double")
    parts = [truth_rows(truth), did_rows(panel, truth)]
    donors = stored(synthetic.donor_cohorts(panel, n_donors, settings.seed), "donors")
    dealt = None if beside is None else beside(donors)
    for outcome, column in (("weekly_spend_winsor", SPEND), ("weekly_orders", "observed_weekly_orders")):
        series = stored(synthetic.trajectories(panel, column, donors) if dealt is None else synthetic.trajectories(dealt, column), "trajectories")
        matrix = stored(synthetic.donor_matrix(series, t0), "donor-matrix")
        kinds = (synthetic.MAIN, synthetic.PLACEBO, *([synthetic.LEAVE_OUT] if column == SPEND else []))
        fits = stored(synthetic.refits(matrix, kinds), "refits")
        s = synthetic.summary(fits)
        parts.append(_rows(s, SYNTHETIC_MODEL, OVERALL, outcome, F.col("estimated_att"), real[outcome], F.col("pre_rmspe"), null, null,
                           F.col("placebo_pval"), "SYNTHETIC_CONTROL"))
        if column == SPEND:
            loo = synthetic.leave_one_out(fits)
            parts.append(_rows(loo, LEAVE_OUT_MODEL, "Overall (50 LOO Runs)", outcome, F.col("mean_att"), real[outcome], F.col("std_att"),
                               F.col("min_att"), F.col("max_att"), 0.0, "SENSITIVITY_DIAGNOSTIC"))
    es = event_study.event_summary(event_study.cells(panel, t0, SPEND))
    half = F.lit(event_study.HALF_WIDTH) * F.col("mean_post_se")
    parts.append(_rows(es, EVENT_MODEL, OVERALL, "weekly_spend_winsor", F.col("mean_post_att"), real["weekly_spend_winsor"],
                       F.col("mean_post_se"), F.col("mean_post_att") - half, F.col("mean_post_att") + half, F.col("joint_test_pval"),
                       "DYNAMIC_EVENT_STUDY"))
    pl = did.placebo_date(panel, t0, SPEND)
    parts.append(_rows(pl, PLACEBO_MODEL, "Overall (Pre-Period Placebo)", "weekly_spend_winsor", F.col("placebo_att"), 0.0, F.col("std_err"),
                       null, null, F.col("p_value"), "FALSIFICATION_DIAGNOSTIC"))
    het = did.heterogeneity(panel, beside=beside)
    att, se = F.col("estimated_did_att"), F.col("std_err")
    parts.append(_rows(
        het, F.concat(F.lit("TWFE DiD - Decile "), F.col("decile")),
        F.concat(F.lit("CLV Decile "), F.col("decile"), F.lit(" (N="), F.col("customer_count").cast("string"), F.lit(")")),
        "weekly_spend_winsor", att, F.col("true_att"), se, att - F.lit(event_study.HALF_WIDTH) * se,
        att + F.lit(event_study.HALF_WIDTH) * se, F.col("p_value"),
        F.when(F.col("degenerate"), "DEGENERATE").otherwise("DECILE_HETEROGENEITY")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refutation_suite(panel: DataFrame, t0: str, settings: Settings = DEFAULTS, n_donors: int = 50,
                     beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Placebo date and leave-one-donor-out as (check, metric, value) rows."""
    pl = did.placebo_date(panel, t0, SPEND)
    fits = synthetic.synthetic_control(panel, t0, SPEND, n_donors, settings.seed, (synthetic.LEAVE_OUT,), beside)
    loo = synthetic.leave_one_out(fits)

    def melt(df: DataFrame, check: str, columns: list[str]) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))
        return df.select(F.lit(check).alias("check"), rows.alias("r")).select("check", "r.*")

    return melt(pl.withColumn("test_passed", F.col("test_passed").cast("int")), "placebo_date",
                ["placebo_att", "std_err", "p_value", "test_passed"]).unionByName(
        melt(loo, "leave_one_out", ["runs", "mean_att", "std_att", "min_att", "max_att"]))


def assignment_benchmark(panel: DataFrame, t0: str, mode: str, code_version: str, source: str,
                         settings: Settings = DEFAULTS, n_donors: int = 50, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Key/value record of one assignment mode: pre-trend test, truth, DiD and its error, synthetic control, growth gap."""
    one = ground_truth(panel).where(F.col("cohort") == "overall").select(F.col("realized_spend_winsor").alias("true_att"))
    es = event_study.event_summary(event_study.cells(panel, t0, SPEND)).select(
        F.struct(F.col("joint_test_stat").alias("chi2"), F.col("joint_test_df").alias("df"), F.col("joint_test_pval").alias("p")))
    tw = did.twfe(panel, [("weekly_spend_winsor", SPEND)]).select(F.struct("estimated_att", "std_err", "n_obs"))
    sc = synthetic.summary(synthetic.synthetic_control(panel, t0, SPEND, n_donors, settings.seed, (synthetic.MAIN,), beside)) \
        .select(F.struct("estimated_att", "pre_rmspe"))
    per = panel.groupBy("customer_id").agg(F.max("is_treated").alias("t"), F.max("spend_growth").alias("g"), F.count(F.lit(1)).alias("k"))
    arm = F.col("t") == 1
    growth = per.agg(F.struct(
        (F.sum(F.when(arm, F.col("g") * F.col("k"))) / F.sum(F.when(arm, F.col("k")))).alias("treated"),
        (F.sum(F.when(~arm, F.col("g") * F.col("k"))) / F.sum(F.when(~arm, F.col("k")))).alias("control")))
    wide = (one.withColumn("es", es.scalar()).withColumn("tw", tw.scalar()).withColumn("sc", sc.scalar()).withColumn("gr", growth.scalar()))
    diff = "twfe_bias" if mode == "confounded" else "single_draw_error"

    def f4(c: Column) -> Column:
        return F.format_string("%.4f", c)

    pairs = [
        ("code_version", F.lit(code_version)), ("source_script", F.lit(source)), ("panel_row_count", F.col("tw.n_obs").cast("string")),
        ("assignment_mode", F.lit(mode)), ("pre_trend_wald_chi2", f4(F.col("es.chi2"))), ("pre_trend_wald_df", F.col("es.df").cast("string")),
        ("pre_trend_wald_p", F.format_string("%.6e", F.col("es.p"))), ("true_att", f4(F.col("true_att"))),
        ("twfe_estimate", f4(F.col("tw.estimated_att"))), ("twfe_se", f4(F.col("tw.std_err"))),
        (diff, f4(F.col("tw.estimated_att") - F.col("true_att"))), ("sc_estimate", f4(F.col("sc.estimated_att"))),
        ("sc_pre_rmspe", f4(F.col("sc.pre_rmspe"))), ("treated_mean_spend_growth", f4(F.col("gr.treated"))),
        ("control_mean_spend_growth", f4(F.col("gr.control"))), ("spend_growth_gap", f4(F.col("gr.treated") - F.col("gr.control")))]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in pairs]))
    return wide.select(rows.alias("r")).select("r.*")
