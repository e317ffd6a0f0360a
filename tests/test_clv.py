import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import special
from tallyfield.functions.special import lbeta, unit_gauss_legendre
from tallyfield.operators import fitting, quality, rfm, scoring, validation
from tallyfield.plans import clv_queries

BG = scoring.BetaGeometric(0.5, 8.0, 1.2, 2.5)


def _quadrature(m, x, age, t, nodes=4000):
    """E[purchases | alive] with p ~ Beta(a, b') by a fine midpoint rule in log-odds space."""
    s = np.linspace(-30, 30, 30001)
    p = 1 / (1 + np.exp(-s))
    dens = np.exp((m.a - 1) * np.log(p) + (m.beta_b(x) - 1) * np.log1p(-p) - float(lbeta(m.a, m.beta_b(x)))) * p * (1 - p)
    f = (1 - ((m.alpha + age) / (m.alpha + age + p * t)) ** (m.r + x)) / np.maximum(p, 1e-300)
    return float(np.trapezoid(f * dens, s))


@pytest.mark.parametrize("x", [0, 1, 5, 40, 200])
@pytest.mark.parametrize("modified", [False, True])
def test_series_matches_numeric_integral(x, modified):
    m = scoring.BetaGeometric(0.5, 8.0, 1.2, 2.5, modified)
    got = scoring._purchases_given_alive(m, np.array([[float(x)]]), np.array([[90.0]]), np.array([[90.0, 365.0]]))
    for j, t in enumerate((90.0, 365.0)):
        assert got[0, j] == pytest.approx(_quadrature(m, x, 90.0, t), rel=1e-6)


@pytest.mark.parametrize("age", [10.0, 30.0, 90.0, 180.0, 365.0])
def test_one_time_quadrature_matches_series(age):
    quad = scoring._purchases_once(BG, np.array([age]), np.array([90.0]))[0]
    series = scoring._purchases_given_alive(BG, np.array([[0.0]]), np.array([[age]]), np.array([[90.0]]))[0, 0]
    assert quad == pytest.approx(series, abs=1e-5) and quad > 0
    at_one = scoring.BetaGeometric(0.5, 8.0, 1.0, 2.5)
    near = scoring.BetaGeometric(0.5, 8.0, 1.0001, 2.5)
    a, b = (scoring.bg_expected(m, [2.0], [20.0], [age], [90.0])[0, 0] for m in (at_one, near))
    assert a == pytest.approx(b, rel=1e-3)


def test_pareto_against_prior_sampling():
    m = scoring.ParetoNbd(0.8, 12.0, 0.9, 15.0)
    rng = np.random.default_rng(0)
    lam, mu = rng.gamma(m.r, 1 / m.alpha, 2_000_000), rng.gamma(m.s, 1 / m.beta, 2_000_000)
    x, tx, age, t = 3, 20.0, 30.0, 26.0
    alive = lam ** x * np.exp(-(lam + mu) * age)
    gone = lam ** x * mu / (lam + mu) * (np.exp(-(lam + mu) * tx) - np.exp(-(lam + mu) * age))
    p = alive.sum() / (alive + gone).sum()
    e = (alive * lam / mu * (1 - np.exp(-mu * t))).sum() / (alive + gone).sum()
    assert scoring.pareto_alive(m, [x], [tx], [age])[0] == pytest.approx(p, rel=5e-3)
    assert scoring.pareto_expected(m, [x], [tx], [age], [t])[0, 0] == pytest.approx(e, rel=1e-2)
    one = scoring.ParetoNbd(0.8, 12.0, 1.0, 15.0)
    near = scoring.ParetoNbd(0.8, 12.0, 1.00001, 15.0)
    assert scoring.pareto_expected(one, [x], [tx], [age], [t])[0, 0] == pytest.approx(
        scoring.pareto_expected(near, [x], [tx], [age], [t])[0, 0], rel=1e-4)


def test_discount_weights_equal_monthly_increments():
    path = np.cumsum(np.linspace(1.0, 0.2, 24))
    inc = np.diff(np.append(0.0, path))
    want = sum(v / 1.01 ** (k + 1) for k, v in enumerate(inc))
    assert path @ scoring.discount_weights(24, 0.01) == pytest.approx(want)


@pytest.fixture(scope="module")
def simulated():
    """BG/NBD purchase histories with known parameters."""
    rng = np.random.default_rng(7)
    n, r, alpha, a, b = 4000, 1.1, 40.0, 0.9, 2.5
    lam, p = rng.gamma(r, 1 / alpha, n), rng.beta(a, b, n)
    rows = []
    for i in range(n):
        age = float(rng.integers(100, 700))
        t, x, last = rng.exponential(1 / lam[i]), 0, 0.0
        while t <= age:
            x, last = x + 1, t
            if rng.random() < p[i]:
                break
            t += rng.exponential(1 / lam[i])
        value = rng.gamma(6.0 * max(x, 1), 1.0 / max(x, 1)) / rng.gamma(4.0, 1 / 15.0)
        rows.append((i, x, float(math.floor(last)), age, round(50 * value + 1, 2), round(50 * value + 1, 2) if x else 0.0))
    return pd.DataFrame(rows, columns=["customer_id", "frequency", "recency", "T", "monetary_value", "monetary_value_repeat"])


@pytest.fixture(scope="module")
def rfm_frame(spark, simulated):
    return spark.createDataFrame(simulated).cache()


def test_bgnbd_fit_recovers_parameters_and_is_a_maximum(rfm_frame, simulated):
    model, f = fitting.fit_bg(rfm_frame)
    assert f.converged and f.n == len(simulated)
    assert model.r == pytest.approx(1.1, rel=0.2) and model.alpha == pytest.approx(40.0, rel=0.25)
    assert model.a / (model.a + model.b) == pytest.approx(0.9 / 3.4, rel=0.3)
    scale = simulated["T"].max()
    d = {"x": simulated["frequency"].to_numpy(float), "tx": simulated["recency"].to_numpy() / scale, "age": simulated["T"].to_numpy() / scale}
    best = np.array([model.r, model.alpha / scale, model.a, model.b])
    top = fitting._jet_bg(best, d).value.mean()
    assert top == pytest.approx(f.log_likelihood, abs=1e-9)
    for k in range(4):
        for step in (0.99, 1.01):
            moved = best.copy()
            moved[k] *= step
            assert fitting._jet_bg(moved, d).value.mean() <= top + 1e-9


THETAS = {"bgnbd": (1.1, 0.7, 0.9, 2.5), "mbgnbd": (90.0, 60.0, 0.02, 3.0), "pareto": (0.8, 0.5, 0.6, 1.7), "gammagamma": (6.0, 4.0, 15.0)}


@pytest.mark.parametrize("model", list(THETAS))
def test_derivatives_match_differences(simulated, model):
    d = {"x": simulated["frequency"].to_numpy(float), "tx": simulated["recency"].to_numpy() / 700, "age": simulated["T"].to_numpy() / 700,
         "m": np.maximum(simulated["monetary_value_repeat"].to_numpy(), 1.0)}
    keep = d["x"] > 0 if model == "gammagamma" else d["x"] >= 0
    d = {c: v[keep][:400] for c, v in d.items()}
    kernel, theta = fitting.SPECS[model].kernel, np.array(THETAS[model])
    jet, h = kernel(theta, d), 1e-4
    for i in range(theta.size):
        e = np.zeros(theta.size)
        e[i] = h * theta[i]
        up, down = kernel(theta + e, d), kernel(theta - e, d)
        # in the logarithms of the parameters
        assert np.allclose((up.value - down.value) / (2 * h), theta[i] * jet.g[i], rtol=1e-6, atol=1e-7)
        assert np.allclose(theta[:, None] * (up.g - down.g) / (2 * h), theta[i] * theta[:, None] * jet.h[i], rtol=1e-6, atol=1e-6)
        assert np.allclose(jet.h[i], jet.h[:, i])


def test_pareto_likelihood_is_the_integral_over_the_dropout_time(simulated):
    r, alpha, s, beta = THETAS["pareto"]
    x, tx, age = 3.0, 0.4, 0.9
    y, w = special.unit_gauss_legendre(400)
    y = tx + (age - tx) * y
    inside = (age - tx) * np.sum(w * s * (alpha + y) ** -(r + x) * (beta + y) ** -(s + 1))
    want = math.lgamma(r + x) - math.lgamma(r) + r * math.log(alpha) + s * math.log(beta) + math.log((alpha + age) ** -(r + x) * (beta + age) ** -s + inside)
    d = {"x": np.array([x]), "tx": np.array([tx]), "age": np.array([age])}
    assert fitting._jet_pareto((r, alpha, s, beta), d).value[0] == pytest.approx(want, abs=1e-11)


def test_digamma_and_trigamma():
    z = np.array([1e-3, 0.4, 1.0, 3.7, 80.0, 1e4])
    h = 1e-5 * z
    assert np.allclose(special.digamma(z), [(math.lgamma(v + e) - math.lgamma(v - e)) / (2 * e) for v, e in zip(z, h)], rtol=1e-6)
    assert np.allclose(special.trigamma(z), (special.digamma(z + h) - special.digamma(z - h)) / (2 * h), rtol=1e-6)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13) and special.trigamma(1.0) == pytest.approx(math.pi ** 2 / 6, abs=1e-12)
    one, two = special.rising_derivatives(np.array([63.9, 64.1, 1e9]), np.array([3.0, 3.0, 2.0]))
    assert one[:2] == pytest.approx([sum(1 / (v + j) for j in range(3)) for v in (63.9, 64.1)], abs=1e-13) and one[2] == pytest.approx(2e-9, rel=1e-8)
    assert two[:2] == pytest.approx([-sum((v + j) ** -2 for j in range(3)) for v in (63.9, 64.1)], abs=1e-13) and two[2] == pytest.approx(-2e-18, rel=1e-6)


def test_fits_carry_a_certificate(rfm_frame):
    for f in (fitting.fit_bg(rfm_frame)[1], fitting.fit_mbg(rfm_frame)[1], fitting.fit_pareto(rfm_frame)[1], fitting.fit_gamma_gamma(rfm_frame)[1]):
        assert f.converged and f.score < 1e-4 and f.gain < 1e-7 and f.curvature > 0 and f.iterations < 40


def test_resamples_are_maxima_of_their_own(rfm_frame):
    weights = [F.lit(1), *fitting.bootstrap_weights(3, 9)]
    warm = fitting.fit(fitting.purchase_tuples(rfm_frame, weights), "bgnbd", 4, warm=True)
    cold = fitting.fit(fitting.purchase_tuples(rfm_frame, weights), "bgnbd", 4)
    for a, b in zip(warm, cold):
        assert a.converged and a.log_likelihood == pytest.approx(b.log_likelihood, abs=1e-9)
    assert max(f.iterations for f in warm[1:]) <= min(f.iterations for f in cold)


def test_unfinished_fits_are_refused():
    with pytest.raises(ArithmeticError):
        fitting._settled(fitting.Fit({}, 0.0, 10.0, 5, False))


def test_other_models_fit_and_penalties_shrink(rfm_frame):
    _, mbg = fitting.fit_mbg(rfm_frame)
    _, par = fitting.fit_pareto(rfm_frame)
    gg, f = fitting.fit_gamma_gamma(rfm_frame)
    assert all(np.isfinite(v.log_likelihood) for v in (mbg, par, f))
    assert gg.p == pytest.approx(6.0, rel=0.5) and gg.q == pytest.approx(4.0, rel=0.5)
    fits = fitting.fit_penalties(rfm_frame, (0.0, 0.1, 1.0))
    size = [v.params["r"] ** 2 + v.params["a"] ** 2 + v.params["b"] ** 2 for v in fits]
    assert size[0] > size[1] > size[2]
    assert fits[0].log_likelihood >= fits[1].log_likelihood >= fits[2].log_likelihood


def test_several_problems_equal_single_fits(rfm_frame):
    two = rfm_frame.withColumn("g", F.when(F.col("customer_id") % 2 == 0, "even").otherwise("odd"))
    both = fitting.fit_labelled(two, "g", ["even", "odd"], "bgnbd")
    alone, f = fitting.fit_bg(two.where("g = 'even'"))
    # the two runs scale time by the same maximum only if both halves share it; parameters are in days either way
    for k in ("r", "alpha", "a", "b"):
        assert both["even"].params[k] == pytest.approx(f.params[k], rel=2e-3)


def test_scores_bootstrap_and_invariants(rfm_frame):
    bg, gg, refits, failed = fitting.fit_bootstrap(rfm_frame, 4, seed=1)
    assert failed == 0 and len(refits) == 4
    scored = scoring.check_scores(scoring.score_customers(rfm_frame, bg, gg))
    out = scoring.bootstrap_bounds(scored, refits).toPandas()
    assert out["p_alive"].between(0, 1).all() and (out.loc[out["frequency"] == 0, "p_alive"] == 1).all()
    for m in (12, 24):
        assert (out[f"clv_{m}m_lower"] <= out[f"clv_{m}m"]).all() and (out[f"clv_{m}m"] <= out[f"clv_{m}m_upper"]).all()
        assert (out[f"clv_{m}m_upper"] > out[f"clv_{m}m_lower"]).mean() > 0.9
    assert (out["clv_24m"] >= out["clv_12m"]).all() and (out.loc[out["frequency"] == 0, "expected_purchases_12m"] > 0).all()


def test_scoring_runs_straight_from_the_warehouse(spark):
    from fixtures import raw_lines
    from tallyfield.operators import warehouse
    base = warehouse.customer_rfm(warehouse.stg_orders(raw_lines(spark)))
    assert scoring.score_customers(base, BG, scoring.GammaGamma(6.0, 4.0, 15.0)).count() == 3


def test_weights_of_the_bootstrap_average_to_one(spark):
    w = spark.range(20000).select(F.col("id").alias("customer_id")).select(*[c.alias(f"w{i}") for i, c in enumerate(fitting.bootstrap_weights(3, 5))])
    row = w.agg(*[F.avg(c).alias(c) for c in w.columns], *[F.var_pop(c).alias(f"v{c}") for c in w.columns]).first()
    assert all(abs(v - 1.0) < 0.05 for v in row)


def test_independence_check_matches_t_test(rfm_frame, simulated):
    sub = simulated[(simulated["frequency"] > 0) & (simulated["monetary_value_repeat"] > 0)]
    r = np.corrcoef(sub["frequency"], sub["monetary_value_repeat"])[0, 1]
    out = rfm.independence_check(rfm_frame)
    assert out["pearson_r"] == pytest.approx(r) and out["n"] == len(sub)
    t = r * math.sqrt((len(sub) - 2) / (1 - r * r))
    assert out["p_value"] == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), rel=0.05)


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cutoff in ("a", "b"):
        for i in range(211):
            f = int(rng.poisson(1.2))
            age = float(rng.integers(50, 600))
            rows.append((cutoff, i, f, float(rng.integers(0, age)) if f else 0.0, age, int(rng.poisson(0.5 + f)), float(rng.gamma(2, 30)),
                         round(float(rng.gamma(1 + f, 1.0)), 1), round(float(rng.random()), 2), f * 0.5))
    pdf = pd.DataFrame(rows, columns=["cutoff", "customer_id", "frequency", "recency", "T", "actual_purchases", "actual_revenue",
                                      "predicted_purchases", "p_alive", "naive2_purchases"])
    for c in ("naive1", "naive3"):
        pdf[f"{c}_purchases"] = pdf["naive2_purchases"] * 1.1 + 0.1
    for c in ("predicted", "naive1", "naive2", "naive3"):
        pdf[f"{c}_revenue"] = pdf[f"{c}_purchases"] * 10
    pdf["holdout_duration_days"] = 100
    return pdf, spark.createDataFrame(pdf)


def test_ranking_metrics_match_pandas(preds):
    pdf, df = preds
    out = validation.cohort_comparison(df).toPandas()
    for r in out.itertuples():
        sub = pdf[pdf["cutoff"] == r.cutoff]
        sub = sub if r.cohort == "all" else sub[(sub["frequency"] == 0) == (r.cohort == "f0")]
        score = {"BG/NBD": sub["predicted_purchases"], "naive2": sub["naive2_purchases"], "tenure": -sub["T"]}[r.score_name]
        want = score.rank().corr(sub["actual_purchases"].rank()) if score.std() > 0 else 0.0
        assert r.n == len(sub) and r.spearman_rho == pytest.approx(want, abs=1e-9)
        top = sub.assign(s=-score).sort_values(["s", "customer_id"]).head(max(1, math.ceil(0.1 * len(sub))))
        assert r.top_capture_pct == pytest.approx(top["actual_purchases"].sum() / max(1, sub["actual_purchases"].sum()) * 100)
        if r.score_name != "tenure":
            assert r.mae_purchases == pytest.approx((sub["actual_purchases"] - score).abs().mean())


def test_error_metrics_and_targeting_match_pandas(preds):
    pdf, df = preds
    m = validation.error_metrics(df).toPandas().set_index(["cutoff", "model"])
    one = pdf[pdf["cutoff"] == "a"]
    err = one["actual_purchases"] - one["predicted_purchases"]
    base = (one["actual_purchases"] - one["naive2_purchases"]).abs().mean()
    row = m.loc[("a", "BG/NBD")]
    assert row["rmse_purchases"] == pytest.approx(np.sqrt((err ** 2).mean()))
    assert m.loc[("a", "naive2")]["mae_purchases_gain_pct"] == pytest.approx((1 - err.abs().mean() / base) * 100)
    t = validation.matched_targeting(df).toPandas()
    for r in t[t["cutoff"] == "a"].itertuples():
        hit = (one["T"] - one["recency"]) <= r.inactive_days
        k, bought = int(hit.sum()), one["actual_purchases"] > 0
        assert r.matched_size == k and r.recency_recall == pytest.approx((hit & bought).sum() / bought.sum() * 100)
        top = one.sort_values(["p_alive", "predicted_purchases", "customer_id"], ascending=[False, False, True]).head(k)
        assert r.p_alive_precision == pytest.approx((top["actual_purchases"] > 0).sum() / k * 100 if k else 0.0)


def test_deciles_and_views(preds, spark):
    pdf, df = preds
    d = validation.decile_table(df).toPandas()
    assert d.groupby("cutoff")["customer_count"].sum().tolist() == [211, 211] and d.groupby("cutoff").size().tolist() == [10, 10]
    scores = df.where("cutoff = 'a'").withColumn("clv_12m", F.col("predicted_revenue"))
    assert validation.value_histogram(scores).agg(F.sum("customers")).first()[0] == int(
        (pdf[pdf.cutoff == "a"]["predicted_revenue"] < pdf[pdf.cutoff == "a"]["predicted_revenue"].quantile(0.98)).sum())
    heat = validation.alive_heatmap(scores).toPandas()
    assert len(heat) == 48 and heat["customers"].sum() == 211 and heat.loc[heat["customers"] == 0, "mean_p_alive"].isna().all()


def test_bad_scores_raise(rfm_frame):
    bad = rfm_frame.withColumn("p_alive", F.lit(1.2))
    with pytest.raises(quality.QualityError):
        quality.require_valid(bad, ["p_alive"], 0.0, 1.0)


def test_a_fit_query_fits_its_own_model_on_all_cores(spark, monkeypatch):
    """Fitting the order values must not wait for the three purchase models, and few bytes of tuples must not end in one task."""
    asked = []
    monkeypatch.setattr(clv_queries, "_tuples", lambda f, model: model)
    monkeypatch.setattr(clv_queries, "input_version", lambda spark, sf_dir: 0)
    monkeypatch.setattr(clv_queries, "_FITS", {})
    monkeypatch.setattr(fitting, "fit_labelled", lambda tuples, labels, model: asked.append(model) or {c: fitting.Fit({"p": 1.0}, 0.0, 1.0, 1, True) for c in labels})
    clv_queries.QUERIES["r5_gamma_gamma_fit"](spark, "/nowhere")
    assert asked == ["gammagamma"]
    tuples = spark.createDataFrame([(float(i), float(i), [1.0]) for i in range(40)], "x double, m double, w array<double>").coalesce(1)
    assert fitting._spread(tuples).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
