import datetime as dt
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import dummy_regression, panel_frame
from tallyfield.config import DEFAULTS
from tallyfield.functions.special import chi2_sf
from tallyfield.operators import did, event_study, panel, power, synthetic


@pytest.mark.parametrize("kw", [dict(), dict(late=True), dict(late=True, gaps=True), dict(gaps=True, n=25)])
def test_twfe_equals_dummy_regression(spark, kw):
    pdf, df, _ = panel_frame(spark, seed=3, **kw)
    tau, se, cr1, dt = dummy_regression(pdf)
    row = did.twfe(df, [("y", "y")]).first()
    assert row["estimated_att"] == pytest.approx(tau, abs=1e-9) and row["std_err"] == pytest.approx(se, rel=1e-8)
    assert row["n_obs"] == len(pdf) and not row["degenerate"]
    assert did.twfe(df, [("y", "y")], dof="cr1").first()["std_err"] == pytest.approx(cr1, rel=1e-8)
    d = df.withColumn("d", (F.col("is_treated") * F.col("is_post_period")).cast("double"))
    got = did.two_way_within(d, "d").toPandas().sort_values(["customer_id", "week_date"])["within"].to_numpy()
    want = pdf.assign(w=dt).sort_values(["customer_id", "week_date"])["w"].to_numpy()
    assert np.abs(got - want).max() < 1e-9


def test_twfe_covers_truth_and_groups_are_separate(spark):
    pdf, df, _ = panel_frame(spark, n=80, tau=7.5, seed=5)
    row = did.twfe(df, [("y", "y")]).first()
    assert row["ci_lower"] <= 7.5 <= row["ci_upper"] and row["p_value"] < 1e-6
    grouped = df.withColumn("g", F.col("customer_id") % 2)
    rows = {r["g"]: r for r in did.twfe(grouped, [("y", "y"), ("twice", "z")][:1], ["g"]).collect()}
    for g in (0, 1):
        tau, se, _, _ = dummy_regression(pdf[pdf["customer_id"] % 2 == g])
        assert rows[g]["estimated_att"] == pytest.approx(tau, abs=1e-9) and rows[g]["std_err"] == pytest.approx(se, rel=1e-8)


@pytest.mark.parametrize("cut", ["is_treated = 0", "is_treated = 1", "is_post_period = 0", "customer_id = 1"])
def test_degenerate_panels_are_flagged(spark, cut):
    _, df, _ = panel_frame(spark, n=20, weeks=20, t0_week=12)
    row = did.twfe(df.where(cut), [("y", "y")]).first()
    assert row["degenerate"] and row["estimated_att"] is None and row["std_err"] is None


def test_placebo_date_finds_nothing(spark):
    _, df, t0 = panel_frame(spark, n=60, tau=9.0, seed=8)
    row = did.placebo_date(df, t0.isoformat(), "y").first()
    assert row["test_passed"]


def _brute_event(pdf, t0, leads, lags):
    rel = np.clip(((pd.to_datetime(pdf["week_date"]) - pd.Timestamp(t0)).dt.days // 7), -leads, lags)
    g = pdf.assign(rel=rel).groupby(["rel", "is_treated"])["y"].agg(["mean", "count", "std"]).unstack()
    diff = g["mean"][1] - g["mean"][0]
    v = g["std"][1] ** 2 / g["count"][1] + g["std"][0] ** 2 / g["count"][0]
    pre, post = [w for w in diff.index if w < 0], [w for w in diff.index if w >= 0]
    k = len(pre)
    vb = v[pre].sum() / k ** 2
    beta = diff - diff[pre].mean()
    test = pre[:-1]
    sigma = np.array([[(1 - 2 / k) * v[i] + vb if i == j else vb - (v[i] + v[j]) / k for j in test] for i in test])
    chi2 = beta[test].to_numpy() @ np.linalg.pinv(sigma) @ beta[test].to_numpy()
    m = len(post)
    full = np.full((m, m), vb) + np.diag(v[post])
    w = np.full(m, 1 / m)
    return beta, chi2, beta[post].mean(), np.sqrt(w @ full @ w)


def test_event_study_matches_matrix_form(spark):
    pdf, df, t0 = panel_frame(spark, n=100, weeks=20, t0_week=10, seed=4, late=False)
    shifted = t0 + pd.Timedelta(days=3)  # mid-week date: the week it falls in is before the policy
    cell = event_study.cells(df, shifted.isoformat()[:10], "y", max_leads=5, max_lags=5)
    beta, chi2, att, se = _brute_event(pdf, shifted, 5, 5)
    got = event_study.event_study(cell).toPandas().set_index("rel_week")["beta"].sort_index()
    assert np.allclose(got.to_numpy(), beta.to_numpy())
    one = event_study.event_summary(cell).first()
    assert one["joint_test_stat"] == pytest.approx(chi2, rel=1e-8)
    assert one["joint_test_pval"] == pytest.approx(chi2_sf(chi2, 4), rel=1e-8)
    assert one["mean_post_att"] == pytest.approx(att) and one["mean_post_se"] == pytest.approx(se)


def test_pretrend_test_rejects_a_trend(spark):
    pdf, df, t0 = panel_frame(spark, n=100, weeks=20, t0_week=10, seed=6)
    week = F.date_diff("week_date", F.lit(pdf["week_date"].min())) / 7
    trend = df.withColumn("y", F.col("y") + F.when((F.col("is_treated") == 1) & (week < 10), week * 3.0).otherwise(0.0))
    p = [event_study.event_summary(event_study.cells(d, t0.isoformat(), "y", max_leads=5, max_lags=5)).first()["joint_test_pval"]
         for d in (df, trend)]
    assert p[0] > 0.05 and p[1] < 0.01


def test_simplex_weights_are_optimal():
    rng = np.random.default_rng(0)
    for rows, cols in ((40, 12), (8, 20), (30, 1)):
        x = rng.gamma(2.0, 1000.0, (rows, cols))
        y = x @ rng.dirichlet(np.ones(cols)) + rng.normal(0, 200, rows)
        w, residual, _ = synthetic.simplex_weights(y, x)
        assert w.min() >= 0 and w.sum() == pytest.approx(1.0)
        grad = x.T @ (x @ w - y)
        # optimality on the scale of the data: with more donors than weeks the fit is exact and the gradient is rounding
        assert (grad - grad @ w >= -1e-9 * np.abs(x.T @ y).max()).all()
    x = rng.normal(0, 1, (25, 6))
    w, residual, _ = synthetic.simplex_weights(0.3 * x[:, 1] + 0.7 * x[:, 4], x)
    assert w[1] == pytest.approx(0.3) and w[4] == pytest.approx(0.7)


def test_synthetic_control_end_to_end(spark):
    _, df, t0 = panel_frame(spark, n=60, tau=5.0, noise=0.5, seed=2)
    fits = synthetic.synthetic_control(df, t0.isoformat(), "y", n_donors=6).cache()
    s = synthetic.summary(fits).first()
    assert s["n_donors"] == 6 and s["estimated_att"] == pytest.approx(5.0, abs=1.5)
    placebos = [r["estimated_att"] for r in fits.where("kind = 'placebo'").collect()]
    assert s["placebo_pval"] == pytest.approx((sum(abs(p) >= abs(s["estimated_att"]) for p in placebos) + 1) / 7)
    loo = synthetic.leave_one_out(fits).first()
    values = [r["estimated_att"] for r in fits.where("kind = 'leave_one_out'").collect()]
    assert loo["runs"] == 6 and loo["mean_att"] == pytest.approx(np.mean(values)) and loo["std_att"] == pytest.approx(np.std(values))
    assert synthetic.weight_table(fits).agg(F.sum("weight")).first()[0] == pytest.approx(1.0, abs=1e-3)


def test_heterogeneity_marks_small_cells(spark):
    pdf, df, _ = panel_frame(spark, n=100, seed=9)
    p = df.withColumn("observed_weekly_spend", F.col("y")).withColumn("effect", F.lit(2.0))
    rows = did.heterogeneity(p, min_treated=4, outcome="y", effect="effect").orderBy("decile").collect()
    assert [r["decile"] for r in rows] == [f"D{i:02d}" for i in range(1, 11)] and sum(r["customer_count"] for r in rows) == 100
    for r in rows:
        assert r["degenerate"] == (r["treated_count"] < 4 or r["treated_count"] == r["customer_count"])
        assert r["degenerate"] == (r["estimated_did_att"] is None)
        if not r["degenerate"]:
            assert r["p_value_bonferroni"] == pytest.approx(min(1.0, 10 * r["p_value"]))


# ------------------------------------------------------------------ policy panel

T0 = "2011-05-01"  # a Sunday


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(11)
    rows = []
    for c in range(1, 61):
        for k, day in enumerate(pd.date_range("2011-01-02", "2011-08-01", freq="7D")):
            if rng.random() < 0.5:
                rows.append((c, f"{c}-{k}", day.to_pydatetime(), float(np.round(rng.uniform(20, 100), 2))))
    return spark.createDataFrame(rows, "customer_id bigint, invoice_no string, invoice_date timestamp_ntz, line_total double").cache()


@pytest.fixture(scope="module")
def built(lines):
    s = DEFAULTS.with_(cumulative_churn=0.6, order_rate_change=0.9)
    return panel.policy_panel(lines, T0, s, "baseline").toPandas(), s


def test_panel_semantics(built):
    p, s = built
    per = p.groupby("customer_id").first()
    for _, q in per.groupby("spend_quintile"):
        assert q["is_treated"].sum() == round(len(q) * s.treatment_share)
    hit = (p["is_treated"] == 1) & (p["is_post_period"] == 1)
    effects = [c for c in p.columns if c.startswith(("realized_effect", "expected_effect"))]
    assert (p.loc[~hit, effects] == 0).all().all()
    buying = hit & ~p["is_churned"] & (p["cf_orders"] > 0)
    assert np.allclose(p.loc[buying, "observed_weekly_spend"], p.loc[buying, "cf_spend"] * 1.1)
    churned = hit & p["is_churned"]
    assert churned.any() and (p.loc[churned, ["observed_weekly_orders", "observed_weekly_spend"]] == 0).all().all()
    added = hit & ~p["is_churned"] & (p["cf_orders"] == 0) & (p["observed_weekly_orders"] == 1)
    assert added.any() and np.allclose(p.loc[added, "observed_weekly_spend"], p.loc[added, "median_order_val"] * 1.1)
    limit = np.percentile(p.loc[p["cf_spend"] > 0, "cf_spend"], 99)
    assert p["observed_weekly_spend_winsor"].max() <= limit + 1e-9
    ordered = p.sort_values(["customer_id", "week_date"])
    roll = ordered.groupby("customer_id")["observed_weekly_orders"].rolling(13, min_periods=1).sum().reset_index(drop=True) > 0
    assert (roll.to_numpy() == (ordered["observed_active_last_90d"] > 0).to_numpy()).all()
    weeks = p.groupby("customer_id")["week_date"].agg(["min", "max", "count"])
    assert weeks["max"].nunique() == 1
    assert (((pd.to_datetime(weeks["max"]) - pd.to_datetime(weeks["min"])).dt.days // 7 + 1) == weeks["count"]).all()


def test_panel_is_neither_sorted_nor_shuffled(lines):
    """A panel is customers x weeks: its rows come from the customers' rows, each reader working out its own columns."""
    p = panel.policy_panel(lines, T0)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort", "Exchange"))
    few = p.select("customer_id", "week_date", "observed_weekly_spend_winsor")._jdf.queryExecution().executedPlan().toString()
    assert "__obs_active" not in few and "md5" not in few


def test_customer_columns_are_joined_before_the_weeks_unfold(spark, lines):
    """A decile or a donor cohort reaches the panel without a shuffle of its weeks, and the results are those of the plain join."""
    s = DEFAULTS.with_(order_rate_change=0.9)
    wide = panel.panel_customers(panel.customer_table(lines, T0, s), panel.weekly_orders(lines), T0, s, "baseline").cache()
    p = panel.unfold_panel(wide, T0, s, aliases=False)
    def beside(extra):
        return panel.with_customer_columns(wide, extra, T0, s)
    donors = synthetic.donor_cohorts(p, 5)
    dealt = beside(donors)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    outcome = "observed_weekly_spend_winsor"
    def rows(df):
        return [tuple(r) for r in df.orderBy(*df.columns[:2]).collect()]
    assert rows(synthetic.trajectories(dealt, outcome)) == rows(synthetic.trajectories(p, outcome, donors))
    one, two = (did.heterogeneity(p, 2, beside=b).toPandas().sort_values("decile").reset_index(drop=True) for b in (None, beside))
    pd.testing.assert_frame_equal(one, two)


def test_pre_period_rates(lines):
    s = panel.order_rates(panel.pre_summary(lines, T0), T0).toPandas()
    repeats = (s["pre_orders"] - 1).clip(lower=0)
    lam = repeats.sum() / s["pre_weeks"].sum()
    assert np.allclose(s["pre_order_rate"], (repeats + 4 * lam) / (s["pre_weeks"] + 4))
    raw = lines.where(F.col("invoice_date") < F.lit(T0).cast("timestamp_ntz")).toPandas()
    assert np.allclose(s.set_index("customer_id")["median_order_val"].sort_index(), raw.groupby("customer_id")["line_total"].median())


def test_confounded_assignment_prefers_growth(lines):
    c = panel.customer_table(lines, T0, mode="confounded").toPandas()
    rank = c["spend_growth"].rank(pct=True)
    want = (rank >= rank.quantile(1 - DEFAULTS.treatment_share)).astype(int)
    assert (c["is_treated"] == want).all()


def test_hazard_scenarios(spark):
    k = F.lit(27)
    row = spark.range(1).select(*[panel.weekly_hazard(s, k).alias(s) for s in ("baseline", "hidden_degradation", "severe")]).first()
    assert row["baseline"] == pytest.approx(1 - 0.8 ** (1 / 27)) and row["hidden_degradation"] == pytest.approx(1 - 0.6 ** (1 / 27))
    assert row["severe"] == 0.2


def test_assignment_cuts_treat_exact_shares(spark):
    df = spark.range(1, 5001).select(F.col("id").alias("customer_id"), (F.col("id") % 5 + 1).cast("int").alias("spend_quintile"))
    runs = power.plan_runs(2)
    cuts = power.assignment_cuts(df, runs)
    flags = df.select("spend_quintile", F.posexplode(power._treated_flags(runs, cuts)).alias("run", "t"))
    counts = flags.groupBy("run", "spend_quintile").agg(F.sum(F.col("t").cast("int")).alias("n")).collect()
    assert len(counts) == 20 and {r["n"] for r in counts} == {400}


def test_replications_equal_the_plain_estimator(spark, lines):
    """The block arithmetic against the general estimator on the panel it implies."""
    weekly = panel.weekly_orders(lines).cache()
    customers = panel.customer_table(lines, T0).cache()
    settings = DEFAULTS.with_(order_rate_change=0.9)
    reps = power.replications(customers, weekly, T0, 1, settings=settings).toPandas()
    assert len(reps) == 18
    runs = power.plan_runs(1)
    cuts = power.assignment_cuts(customers, runs, settings)
    c = customers.withColumn("treated", power._treated_flags(runs, cuts)).toPandas().sort_values("customer_id").reset_index(drop=True)
    w = weekly.toPandas()
    first, last = c["first_week"].min(), w["week_date"].max()
    weeks = (last - first).days // 7 + 1
    post = (last - panel.monday_on_or_after(T0)).days // 7 + 1
    limit = np.percentile(w.loc[w["cf_spend"] > 0, "cf_spend"], 99)
    design = power.Design(weeks, post, limit, settings.order_rate_change, settings.aov_change, 13)
    orders, spend = np.zeros((len(c), weeks)), np.zeros((len(c), weeks))
    at = {cid: i for i, cid in enumerate(c["customer_id"])}
    for r in w.itertuples():
        orders[at[r.customer_id], (r.week_date - first).days // 7] = r.cf_orders
        spend[at[r.customer_id], (r.week_date - first).days // 7] = r.cf_spend
    for i, run in enumerate(runs):
        t = np.array([f[i] for f in c["treated"]])
        y = power._base_outcomes(orders, spend, design)
        e = power._effects(c["customer_id"].to_numpy()[t], c["pre_order_rate"].to_numpy()[t], c["median_order_val"].to_numpy()[t],
                           c["spend_quintile"].to_numpy()[t] == 5, orders[t], spend[t], run, design)
        y[:, t, weeks - post:] += e
        rows = [(int(c["customer_id"][k]), first + pd.Timedelta(days=7 * j), int(t[k]), int(j >= weeks - post), int(c["spend_quintile"][k]),
                 *map(float, y[:, k, j])) for k in range(len(c)) for j in range((c["first_week"][k] - first).days // 7, weeks)]
        p = spark.createDataFrame(rows, "customer_id bigint, week_date date, is_treated int, is_post_period int, spend_quintile int, a double, b double, d double")
        plain = did.twfe_by_cohort(p, [("weekly_orders", "a"), ("weekly_spend_winsor", "b"), ("active_last_90d", "d")], "cr1")
        want = {(r["cohort"], r["outcome"]): r for r in plain.collect()}
        mine = reps[reps["scenario"] == run.scenario]
        for key, label, members in panel.COHORTS:
            for o, (outcome, _, _) in enumerate(panel.OUTCOMES):
                got = mine[(mine["cohort"] == label) & (mine["outcome"] == outcome)].iloc[0]
                ref = want[(key, outcome)]
                assert got["estimated_att"] == pytest.approx(ref["estimated_att"], rel=1e-6, abs=1e-9)
                assert got["standard_error"] == pytest.approx(ref["std_err"], rel=1e-6)
                q = np.isin(c["spend_quintile"].to_numpy()[t], members)
                assert got["true_att"] == pytest.approx(e[o, q].mean(), abs=1e-9)
    summary = power.replication_summary(spark.createDataFrame(reps)).toPandas()
    assert (summary["Replications"] == 1).all() and np.allclose(summary["RMSE"], summary["Mean_Bias"].abs())


def _long_panel(spark, groups, weeks, customers):
    rows = spark.range(groups * weeks * customers, numPartitions=8).select(
        (F.col("id") % customers).alias("c"), (F.floor(F.col("id") / customers) % weeks).cast("int").alias("w"), F.floor(F.col("id") / (customers * weeks)).alias("g"))
    hit = (F.col("c") < customers / 3) & (F.col("w") >= weeks // 2)
    return rows.select("g", F.concat_ws("-", "g", "c").alias("customer_id"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("w") * 7).alias("week_date"),
                       (F.col("c") < customers / 3).cast("int").alias("is_treated"), (F.col("w") >= weeks // 2).cast("int").alias("is_post_period"),
                       (F.sin(F.col("w") / 50) * 3 + F.col("c") + F.when(hit, 2.5 + F.col("g")).otherwise(0.0)).alias("y"))


def test_more_weeks_than_any_calendar(spark):
    row = did.twfe(_long_panel(spark, 1, 5300, 6), [("y", "y")], ["g"]).first()
    assert row["estimated_att"] == pytest.approx(2.5, abs=1e-8) and row["n_obs"] == 6 * 5300


def test_more_than_two_million_group_weeks(spark):
    est = did.twfe(_long_panel(spark, 21_000, 100, 2), [("y", "y")], ["g"])
    row = est.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("estimated_att") - F.col("g") - 2.5)).alias("worst"), F.sum("n_obs").alias("rows")).first()
    assert row["n"] == 21_000 and row["worst"] < 1e-6 and row["rows"] == 4_200_000


def test_pools_are_sums_of_their_groups(spark):
    """Overlapping pools in one pass equal the estimates of the panels they stand for, with gaps, unequal spans and weeks apart from one another."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        lo, hi = sorted(rng.choice(30, 2, replace=False))
        for w in range(lo, hi + 1):
            if rng.random() < 0.8:
                rows.append((c % 3, c, dt.date(2020, 1, 6) + dt.timedelta(weeks=int(w)), int(c % 2), int(w >= 15), float(rng.normal() + c + w * 0.1)))
    panel = spark.createDataFrame(rows, "g int, customer_id int, week_date date, is_treated int, is_post_period int, y double")
    pools = {"all": (0, 1, 2), "first": (0,), "rest": (1, 2)}
    got = {r["cohort"]: r for r in did.twfe(panel, [("y", "y")], ["g"], pools=pools).collect()}
    assert set(got) == set(pools)
    for name, members in pools.items():
        one = did.twfe(panel.where(F.col("g").isin(*members)), [("y", "y")]).first()
        for c in ("estimated_att", "std_err", "p_value", "n_obs", "n_customers"):
            assert got[name][c] == pytest.approx(one[c], rel=1e-9)


def test_active_weeks_are_looked_up_not_searched(spark):
    """The list of active weeks grows with the calendar, not with the orders, and agrees with the definition across its numbers."""
    first, end, t0 = dt.date(1996, 1, 1), dt.date(2001, 7, 30), "2000-06-05"
    at = {1: [0, 51, 52, 63, 64, 127, 190, 230, 240, 291], 2: [0], 3: list(range(0, 290, 3)), 4: [5, 60]}
    step = {1: 3, 2: None, 3: 1, 4: None}
    added = {1: [231, 250], 2: [260], 3: [], 4: None}
    rows = [(c, first, end, step[c], {first + dt.timedelta(weeks=w): (int(c != 4 or w != 5), 1.0) for w in at[c]},
             None if added[c] is None else [first + dt.timedelta(weeks=w) for w in added[c]]) for c in at]
    wide = spark.createDataFrame(rows, "customer_id long, first_week date, __end date, churn_step long, __weeks map<date,struct<cf_orders:int,cf_spend:double>>, __added array<date>")
    marked = panel.with_active_weeks(wide, t0)
    assert {len(r[0]) for r in marked.select("__obs_active").collect()} == {5}
    got = panel.with_recent_activity(marked.withColumn("week_date", F.explode(F.sequence("first_week", "__end", F.expr("INTERVAL 7 DAYS")))))
    post = (dt.date.fromisoformat(t0) - first).days // 7
    n = 0
    for r in got.collect():
        c, w = r["customer_id"], (r["week_date"] - first).days // 7
        own = [x for x in at[c] if c != 4 or x != 5]
        seen = [x for x in own + (added[c] or []) if x < post or step[c] is None or x - post + 1 <= step[c]]
        assert r["counterfactual_active_last_90d"] == float(any(x <= w < x + 13 for x in own)), (c, w)
        assert r["observed_active_last_90d"] == float(any(x <= w < x + 13 for x in seen)), (c, w)
        n += 1
    assert n == 4 * 292
