"""RFM, lifetime value and holdout validation on the test tables (R, Q9, O4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfield.config import DEFAULTS
from tallyfield.functions.numeric import round_half
from tallyfield.operators import fitting, quality, reporting, rfm, scoring, validation, warehouse
from tallyfield.plans import clv_sql as cs
from tallyfield.plans.frames import CUTOFFS, HOLDOUT_END, Frames, input_version, mart
from tallyfield.plans.panel_queries import rounded
from tallyfield.plans.sqltext import DIM_CUSTOMERS, LINES, holdout, qcut, rnd
from tallyfield.plans.sqltext import rfm as rfm_sql

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Frames(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def full_rfm(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "rfm", lambda: warehouse.customer_rfm(f.stg()))


def splits(f: Frames) -> DataFrame:
    def build():
        lines, out = f.lines(), None
        for c in CUTOFFS:
            one = rfm.holdout_split(lines, c, HOLDOUT_END).withColumn("cutoff", F.lit(c))
            out = one if out is None else out.unionByName(one)
        return out
    return mart(f.spark, f.sf_dir, "splits", build)


def _days(f: Frames) -> dict[str, int]:
    rows = splits(f).groupBy("cutoff").agg(F.max("holdout_duration_days").alias("d")).collect()  # one row per cutoff
    return {r["cutoff"]: r["d"] for r in rows}


def _round_scores(df: DataFrame) -> DataFrame:
    for c in ("predicted_purchases", "mbgnbd_predicted_purchases", "paretonbd_predicted_purchases"):
        df = df.withColumn(c, round_half(c, 6))
    for c in ("p_alive", "mbgnbd_p_alive", "paretonbd_p_alive"):
        df = df.withColumn(c, round_half(c, 9))
    return df.withColumn("expected_order_value", round_half("expected_order_value", 4))


def _predict(f: Frames, models) -> DataFrame:
    base, days, out = validation.with_baselines(splits(f)), _days(f), None
    for c in CUTOFFS:
        bg, gg, mbg, par = models(c)
        one = validation.predictions_at(base.where(F.col("cutoff") == c), days[c], bg, gg, mbg, par)
        out = one if out is None else out.unionByName(one)
    return validation.export_frame(_round_scores(out))


def preds(f: Frames) -> DataFrame:
    return mart(f.spark, f.sf_dir, "preds_pinned", lambda: _predict(f, lambda c: (cs.BG, cs.GG, cs.MBG, cs.PARETO)))


def fitted(f: Frames, model: str) -> dict[str, fitting.Fit]:
    """One model fitted at every cutoff, which share the passes; the models that nobody asks for are not fitted."""
    key = (f.spark.sparkContext.applicationId, f.sf_dir, input_version(f.spark, f.sf_dir), "cutoffs", model)
    if key not in _FITS:
        _FITS[key] = fitting.fit_labelled(_tuples(f, model), CUTOFFS, model)
    return _FITS[key]


def bootstrap(f: Frames):
    """Point fit and bootstrap refits of the whole table, once per session."""
    key = (f.spark.sparkContext.applicationId, f.sf_dir, input_version(f.spark, f.sf_dir), "bootstrap")
    if key not in _FITS:
        _FITS[key] = fitting.fit_bootstrap(full_rfm(f), DEFAULTS.n_bootstraps, DEFAULTS.seed)
    return _FITS[key]


_FITS: dict[tuple, object] = {}


def fitted_preds(f: Frames) -> DataFrame:
    fits = {m: fitted(f, m) for m in ("bgnbd", "gammagamma", "mbgnbd", "pareto")}

    def models(c):
        return (scoring.BetaGeometric(**fits["bgnbd"][c].params), scoring.GammaGamma(**fits["gammagamma"][c].params),
                scoring.BetaGeometric(**fits["mbgnbd"][c].params, modified=True), scoring.ParetoNbd(**fits["pareto"][c].params))
    return mart(f.spark, f.sf_dir, "preds_fitted", lambda: _predict(f, models))


def scores(f: Frames) -> DataFrame:
    def build():
        s = scoring.score_customers(full_rfm(f), cs.BG, cs.GG)
        return s.withColumn("p_alive", round_half("p_alive", 9)).withColumn(
            "expected_avg_order_value", round_half("expected_avg_order_value", 4))
    return mart(f.spark, f.sf_dir, "scores_pinned", build)


# ------------------------------------------------------------------ RFM

@query("r1_rfm_as_of", f"WITH {LINES}, " + rfm_sql("rfm", "lines", f"invoice_date <= TIMESTAMP '{CUTOFFS[1]}'",
                                                  f"TIMESTAMP '{CUTOFFS[1]}'") + " SELECT * FROM rfm")
def r1(f):
    return rfm.rfm_as_of(f.lines(), CUTOFFS[1])


@query("r2_holdout_split", f"WITH {LINES}, " + holdout("h", CUTOFFS[0], HOLDOUT_END) + " SELECT * FROM h")
def r2(f):
    return rfm.holdout_split(f.lines(), CUTOFFS[0], HOLDOUT_END)


@query("r2_holdout_split_midpoint", f"WITH {LINES}, " + holdout("h", "1998-04-17", HOLDOUT_END) + " SELECT * FROM h")
def r2m(f):
    """A cutoff before the first order moves to the middle of the dates."""
    return rfm.holdout_split(f.lines(), "1990-01-01", HOLDOUT_END)


@query("r3_frequency_monetary_correlation", f"""WITH {LINES}, {holdout('h', CUTOFFS[0], HOLDOUT_END)}
  SELECT count(*) AS n, {rnd('coalesce(corr(frequency, monetary_value_repeat), 0.0e0)', 9)} AS pearson_r
  FROM h WHERE frequency > 0 AND monetary_value_repeat > 0""")
def r3(f):
    split = splits(f).where(F.col("cutoff") == CUTOFFS[0])
    return rounded(rfm.frequency_monetary_correlation(split), 9)


@query("r3_independence_check", f"""WITH {LINES}, {holdout('h', CUTOFFS[0], HOLDOUT_END)},
  c AS (SELECT count(*) AS n, corr(frequency, monetary_value_repeat) AS r FROM h WHERE frequency > 0 AND monetary_value_repeat > 0),
  t AS (SELECT n, r, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
  q AS (SELECT n, r, 1 - 2 * t / 60000 * sum(CASE WHEN i IN (0, 20000) THEN 1 ELSE 2 + 2 * (i % 2) END  -- Simpson's rule over the t density
          * exp(lgamma((n - 1) / 2.0e0) - lgamma((n - 2) / 2.0e0)) / sqrt((n - 2) * pi()) * pow(1 + pow(t * i / 20000.0e0, 2) / (n - 2), -(n - 1) / 2.0e0)) AS p
        FROM t, range(0, 20001) g(i) GROUP BY n, r, t)
  SELECT n, {rnd('r', 9)} AS pearson_r, {rnd('p', 7)} AS p_value, p > 0.05 OR abs(r) < 0.2 AS independent FROM q""")
def r3p(f):
    """With the two-sided p-value and the verdict."""
    found = rfm.independence_check(splits(f).where(F.col("cutoff") == CUTOFFS[0]))
    row = f.spark.createDataFrame([tuple(found.values())], "n long, pearson_r double, p_value double, independent boolean")
    return row.withColumns({"pearson_r": round_half("pearson_r", 9), "p_value": round_half("p_value", 7)})


# ------------------------------------------------------------------ fits (checked by tests, not by SQL)

def _fit_query(name, model):
    @query(name)
    def run(f):
        return fitting.fits_frame(f.spark, list(fitted(f, model).items()))
    return run


_fit_query("r4_bgnbd_fit", "bgnbd")
_fit_query("r5_gamma_gamma_fit", "gammagamma")
_fit_query("r6_mbgnbd_fit", "mbgnbd")
_fit_query("r7_pareto_nbd_fit", "pareto")


def _tuples(f, model):
    """Written once: the fits and the likelihoods read the same tuples."""
    kind = "value" if model == "gammagamma" else "purchase"
    return mart(f.spark, f.sf_dir, f"{kind}_tuples", lambda: fitting.labelled_tuples(splits(f), "cutoff", CUTOFFS, model))


def _likelihood_query(name, model):
    """Total log-likelihood of each cutoff at pinned points, from the kernels that the fits use."""
    @query(name, f"""WITH {cs.HOLDOUTS}, {cs.likelihood(model)}
      SELECT cutoff, point, count(*) AS customers, {rnd('sum(v)', 5)} AS log_likelihood FROM ll GROUP BY cutoff, point""")
    def run(f):
        tuples = _tuples(f, model)
        found = fitting.log_likelihoods(tuples, model, cs.GRID[model], len(CUTOFFS))
        sizes = tuples.agg(*[F.sum(F.col("w")[i]).cast("bigint").alias(c) for i, c in enumerate(CUTOFFS)]).first()
        rows = [(CUTOFFS[i], j, sizes[i], v) for (i, j), v in found.items()]
        return f.spark.createDataFrame(rows, "cutoff string, point int, customers long, log_likelihood double").withColumn(
            "log_likelihood", round_half("log_likelihood", 5))
    return run


def _certificate_query(name, model):
    """What proves each fit: the slope is gone, no direction curves upwards, and every pinned point is less likely."""
    rows = "frequency > 0 AND monetary_value_repeat > 0" if model == "gammagamma" else "TRUE"
    @query(name, f"""WITH {cs.HOLDOUTS} SELECT cutoff, count(*) FILTER (WHERE {rows}) AS customers, TRUE AS converged, TRUE AS stationary, TRUE AS no_ascent,
      CAST({len(cs.GRID[model])} AS BIGINT) AS pinned_points_beaten FROM hall GROUP BY cutoff""")
    def run(f):
        fits = fitted(f, model)
        names = fitting.SPECS[model].names
        points = [[fits[c].params[k] for k in names] for c in CUTOFFS] + list(cs.GRID[model])
        values = fitting.log_likelihoods(_tuples(f, model), model, points, len(CUTOFFS))
        out = []
        for i, c in enumerate(CUTOFFS):
            beaten = sum(values[i, len(CUTOFFS) + j] < values[i, i] for j in range(len(cs.GRID[model])))
            out.append((c, int(fits[c].n), fits[c].converged, fits[c].score < 1e-4, fits[c].curvature > -1e-8 and fits[c].gain < 1e-7, beaten))
        return f.spark.createDataFrame(out, "cutoff string, customers long, converged boolean, stationary boolean, no_ascent boolean, pinned_points_beaten long")
    return run


for _name, _model in (("r4_bgnbd", "bgnbd"), ("r5_gamma_gamma", "gammagamma"), ("r6_mbgnbd", "mbgnbd"), ("r7_pareto_nbd", "pareto")):
    _likelihood_query(f"{_name}_likelihood", _model)
    _certificate_query(f"{_name}_certificate", _model)


@query("r16_penalizer_order", "SELECT p AS penalizer, TRUE AS converged, TRUE AS parameters_shrink, TRUE AS likelihood_falls FROM (VALUES "
       + ", ".join(f"({float(p)!r}e0)" for p in DEFAULTS.penalizer_grid) + ") v(p)")
def r16o(f):
    """A larger penalty gives smaller parameters and no larger likelihood; each against the penalty before it."""
    fits = fitting.fit_penalties(splits(f).where(F.col("cutoff") == CUTOFFS[0]))
    # the penalty acts on the fit's own scale, on which alpha is a share of the longest age
    longest = splits(f).where(F.col("cutoff") == CUTOFFS[0]).agg(F.max("T")).first()[0]
    size = [sum((v / (longest if k == "alpha" else 1.0)) ** 2 for k, v in fit.params.items()) for fit in fits]
    rows = [(p, fit.converged, i == 0 or size[i] <= size[i - 1], i == 0 or fit.log_likelihood <= fits[i - 1].log_likelihood + 1e-9)
            for i, (p, fit) in enumerate(zip(DEFAULTS.penalizer_grid, fits))]
    return f.spark.createDataFrame(rows, "penalizer double, converged boolean, parameters_shrink boolean, likelihood_falls boolean")


@query("r16_penalizer_grid")
def r16(f):
    """BG/NBD parameters and holdout MAE per penalty."""
    split = splits(f).where(F.col("cutoff") == CUTOFFS[0])
    days = _days(f)[CUTOFFS[0]]
    fits = fitting.fit_penalties(split)
    wide = split
    for i, fit in enumerate(fits):
        wide = wide.withColumn(f"e{i}", scoring.expected_purchases(scoring.BetaGeometric(**fit.params), [days])[0])
    maes = wide.agg(*[F.avg(F.abs(F.col("actual_holdout_purchases") - F.col(f"e{i}"))).alias(f"m{i}") for i in range(len(fits))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(p).alias("penalizer"), *[F.lit(fit.params[k]).alias(k) for k in ("r", "alpha", "a", "b")],
        F.col(f"m{i}").alias("holdout_mae"), F.lit(fit.params["a"] < 1.0).alias("a_below_1"))
        for i, (p, fit) in enumerate(zip(DEFAULTS.penalizer_grid, fits))]))
    return maes.select(rows.alias("r")).select("r.*")


@query("r14_fit_and_score")
def r14f(f):
    """Fit both models on the whole table and score every customer, with bootstrap bounds (R15)."""
    base = full_rfm(f)
    bg, gg, refits, failed = bootstrap(f)
    scored = scoring.check_scores(scoring.score_customers(base, bg, gg))
    return _with_counts(scoring.bootstrap_bounds(scored, refits), refits, failed)


def _with_counts(df, refits, failed):
    """How many resamples the bounds rest on, and how many were left out."""
    return df.withColumn("bootstrap_replicates", F.lit(len(refits)).cast("bigint")).withColumn("bootstrap_failures", F.lit(failed).cast("bigint"))


@query("r15_bootstrap_bounds")
def r15(f):
    _, _, refits, failed = bootstrap(f)
    return _with_counts(scoring.bootstrap_bounds(scores(f), refits).select(
        "customer_id", "clv_12m", "clv_12m_lower", "clv_12m_upper", "clv_24m", "clv_24m_lower", "clv_24m_upper"), refits, failed)


@query("r15_bootstrap_invariants", f"""WITH {cs.RFM} SELECT count(*) AS customers, CAST({DEFAULTS.n_bootstraps} AS BIGINT) AS bootstrap_replicates,
  CAST(0 AS BIGINT) AS bootstrap_failures, count(*) AS ordered_12m, count(*) AS ordered_24m, count(*) AS finite FROM rfm""")
def r15i(f):
    """Bounds contain the point value and are finite for every customer; no resample is lost."""
    b = r15(f)
    ordered = [F.count(F.when((F.col(f"clv_{m}m_lower") <= F.col(f"clv_{m}m")) & (F.col(f"clv_{m}m") <= F.col(f"clv_{m}m_upper")), 1)).alias(f"ordered_{m}m") for m in (12, 24)]
    finite = F.count(F.when((F.abs("clv_12m_lower") < 1e12) & (F.abs("clv_24m_upper") < 1e12), 1)).alias("finite")
    return b.groupBy("bootstrap_replicates", "bootstrap_failures").agg(F.count(F.lit(1)).alias("customers"), *ordered, finite)


# ------------------------------------------------------------------ scoring with pinned parameters

@query("r8_p_alive", f"WITH {cs.RFM} SELECT customer_id, {rnd(cs.alive(cs.BG), 9)} AS p_alive FROM rfm")
def r8(f):
    return full_rfm(f).select("customer_id", round_half(scoring.p_alive(cs.BG), 9).alias("p_alive"))


@query("r9_expected_purchases", f"WITH {cs.RFM}, {cs.NODES}, {cs.purchases('e', 'rfm', cs.BG, '373.0e0')} SELECT customer_id, {rnd('E', 6)} AS expected_purchases FROM e")
def r9(f):
    return full_rfm(f).select("customer_id", round_half(scoring.expected_purchases(cs.BG, [373.0])[0], 6).alias("expected_purchases"))


@query("r10_one_time_quadrature", f"""WITH {cs.RFM}, {cs.NODES}, once AS (SELECT customer_id, CAST(0 AS BIGINT) AS frequency, 0.0e0 AS recency, T FROM rfm),
  {cs.purchases('e', 'once', cs.BG, '90.0e0')} SELECT customer_id, {rnd('E', 9)} AS expected_purchases FROM e""")
def r10(f):
    """The quadrature branch for every customer's age, as if each had ordered once."""
    once = full_rfm(f).select("customer_id", F.lit(0).cast("bigint").alias("frequency"), F.lit(0.0).alias("recency"), "T")
    return once.select("customer_id", round_half(scoring.expected_purchases(cs.BG, [90.0])[0], 9).alias("expected_purchases"))


@query("r10_one_time_customers", f"""WITH {cs.HOLDOUTS}, {cs.NODES}, once AS (SELECT cutoff, customer_id, frequency, recency, T FROM hall WHERE frequency = 0),
  {cs.purchases('e', 'once', cs.BG, '365.0e0')} SELECT cutoff, customer_id, {rnd('E', 9)} AS expected_purchases FROM e""")
def r10r(f):
    """The same branch for the customers who really had one order at a cutoff."""
    once = splits(f).where(F.col("frequency") == 0)
    return once.select("cutoff", "customer_id", round_half(scoring.expected_purchases(cs.BG, [365.0])[0], 9).alias("expected_purchases"))


@query("r11_expected_order_value", f"WITH {cs.SCORES} SELECT customer_id, {rnd('aov', 4)} AS expected_avg_order_value FROM val")
def r11(f):
    df = scoring.with_expected_order_value(full_rfm(f), cs.GG)
    return df.select("customer_id", round_half("expected_avg_order_value", 4).alias("expected_avg_order_value"))


@query("r12_unified_value", f"WITH {cs.SCORES} SELECT customer_id, {rnd('uv', 4)} AS unified_value FROM val")
def r12(f):
    return scoring.with_unified_value(full_rfm(f), cs.GG).select("customer_id", round_half("unified_value", 4).alias("unified_value"))


@query("r13_discounted_value", f"WITH {cs.SCORES} SELECT customer_id, clv_12m, clv_24m FROM scores")
def r13(f):
    return scores(f).select("customer_id", "clv_12m", "clv_24m")


@query("r14_scores", f"WITH {cs.SCORES} SELECT * FROM scores")
def r14(f):
    return scores(f)


# ------------------------------------------------------------------ validation

def _cols(columns, digits):
    return ", ".join(f"{rnd(expr, digits.get(name, 6))} AS {name}" for name, expr in columns)


@query("r26_customer_predictions", f"""WITH {cs.PREDS} SELECT * REPLACE ({', '.join(f"{rnd(c, 4)} AS {c}" for c in (
    'predicted_revenue', 'naive1_purchases', 'naive1_revenue', 'naive2_purchases', 'naive2_revenue', 'naive3_purchases',
    'naive3_revenue', 'mbgnbd_predicted_revenue', 'paretonbd_predicted_revenue'))}) FROM preds""")
def r26(f):
    p = preds(f)
    loose = {"predicted_revenue", "naive1_purchases", "naive1_revenue", "naive2_purchases", "naive2_revenue", "naive3_purchases",
             "naive3_revenue", "mbgnbd_predicted_revenue", "paretonbd_predicted_revenue"}
    return p.select(*[round_half(c, 4).alias(c) if c in loose else F.col(c) for c in p.columns])


@query("r17_rolling_origin", f"""WITH {cs.PREDS}, seg AS (SELECT *, 'all' AS segment FROM preds UNION ALL
   SELECT *, CASE WHEN frequency = 0 THEN 'f0' ELSE 'fpos' END FROM preds),
  s AS (SELECT cutoff, segment, count(*) AS customers, max(holdout_duration_days) AS holdout_days, CAST(sum(actual_purchases) AS DOUBLE) AS ap,
   sum(predicted_purchases) AS pp, sum(actual_revenue) AS ar, sum(predicted_revenue) AS pr FROM seg GROUP BY cutoff, segment)
  SELECT cutoff, segment, customers, holdout_days, ap AS actual_purchases, {rnd('pp', 3)} AS predicted_purchases, {rnd('ar', 1)} AS actual_revenue,
   {rnd('pr', 1)} AS predicted_revenue, {rnd('(pp - ap) / greatest(1.0e0, ap) * 100.0e0', 5)} AS purchases_error_pct,
   {rnd('(pr - ar) / greatest(1.0e0, ar) * 100.0e0', 5)} AS revenue_error_pct FROM s""")
def r17(f):
    r = validation.rolling_origin(preds(f))
    return (r.withColumn("predicted_purchases", round_half("predicted_purchases", 3))
            .withColumn("actual_revenue", round_half("actual_revenue", 1)).withColumn("predicted_revenue", round_half("predicted_revenue", 1))
            .withColumn("purchases_error_pct", round_half("purchases_error_pct", 5)).withColumn("revenue_error_pct", round_half("revenue_error_pct", 5)))


@query("r17_rolling_origin_fitted")
def r17f(f):
    return validation.rolling_origin(fitted_preds(f))


@query("r18_naive_baselines", f"""WITH {cs.BASE} SELECT cutoff, customer_id, {rnd('naive1_purchases', 6)} AS naive1_purchases,
  {rnd('naive2_purchases', 6)} AS naive2_purchases, {rnd('naive3_purchases', 6)} AS naive3_purchases FROM bl""")
def r18(f):
    return rounded(validation.with_baselines(splits(f)).select(
        "cutoff", "customer_id", "naive1_purchases", "naive2_purchases", "naive3_purchases"))


_METRICS = f"""fc AS ({' UNION ALL '.join(f"SELECT cutoff, '{n}' AS model, CAST(actual_purchases AS DOUBLE) AS ap, actual_revenue AS ar, {c}_purchases AS p, {c}_revenue AS r FROM preds"
    for n, c in (('BG/NBD', 'predicted'), ('naive1', 'naive1'), ('naive2', 'naive2'), ('naive3', 'naive3')))}),
 mt AS (SELECT cutoff, model, count(*) AS customers, avg(abs(ap - p)) AS mp, sqrt(avg((ap - p) * (ap - p))) AS rp, avg(abs(ar - r)) AS mr,
   sqrt(avg((ar - r) * (ar - r))) AS rr, CASE WHEN stddev_pop(ap) > 0 AND stddev_pop(p) > 0 THEN corr(ap, p) ELSE 0.0e0 END AS c,
   sum(ap) AS ta, sum(p) AS tp, sum(ar) AS tar, sum(r) AS tr FROM fc GROUP BY cutoff, model)"""


@query("r19_error_metrics", f"""WITH {cs.PREDS}, {_METRICS} SELECT m.cutoff, m.model, m.customers, {rnd('m.mp', 6)} AS mae_purchases,
  {rnd('m.rp', 6)} AS rmse_purchases, {rnd('m.mr', 2)} AS mae_revenue, {rnd('m.rr', 2)} AS rmse_revenue, {rnd('m.c', 7)} AS pearson_r,
  {rnd('m.ta', 3)} AS total_actual_purchases, {rnd('m.tp', 3)} AS total_predicted_purchases,
  {rnd('(m.tp - m.ta) / greatest(1.0e0, m.ta) * 100.0e0', 5)} AS purchases_error_pct,
  {rnd('(m.tr - m.tar) / greatest(1.0e0, m.tar) * 100.0e0', 5)} AS revenue_error_pct, {rnd('m.tar', 1)} AS total_actual_revenue,
  {rnd('m.tr', 1)} AS total_predicted_revenue,
  CASE WHEN m.model <> 'BG/NBD' THEN {rnd('(1.0e0 - b.rp / greatest(1e-5, m.rp)) * 100.0e0', 4)} END AS rmse_purchases_gain_pct,
  CASE WHEN m.model <> 'BG/NBD' THEN {rnd('(1.0e0 - b.mr / greatest(1e-5, m.mr)) * 100.0e0', 4)} END AS mae_revenue_gain_pct,
  CASE WHEN m.model <> 'BG/NBD' THEN {rnd('(1.0e0 - b.mp / greatest(1e-5, m.mp)) * 100.0e0', 4)} END AS mae_purchases_gain_pct,
  CASE WHEN m.model <> 'BG/NBD' THEN {rnd('(1.0e0 - b.rr / greatest(1e-5, m.rr)) * 100.0e0', 4)} END AS rmse_revenue_gain_pct
  FROM mt m JOIN mt b ON m.cutoff = b.cutoff AND b.model = 'BG/NBD'""")
def r19(f):
    m = validation.error_metrics(preds(f))
    digits = {"mae_purchases": 6, "rmse_purchases": 6, "mae_revenue": 2, "rmse_revenue": 2, "pearson_r": 7, "total_actual_purchases": 3,
              "total_predicted_purchases": 3, "purchases_error_pct": 5, "revenue_error_pct": 5, "mae_purchases_gain_pct": 4,
              "rmse_revenue_gain_pct": 4, "total_actual_revenue": 1, "total_predicted_revenue": 1, "rmse_purchases_gain_pct": 4, "mae_revenue_gain_pct": 4}
    return m.select("cutoff", "model", "customers", *[round_half(c, d).alias(c) for c, d in digits.items()])


_COHORTS = """co AS (SELECT *, 'all' AS cohort FROM preds UNION ALL SELECT *, CASE WHEN frequency = 0 THEN 'f0' ELSE 'fpos' END FROM preds),
 lg AS (SELECT cutoff, cohort, customer_id, 'BG/NBD' AS score_name, CAST(actual_purchases AS DOUBLE) AS ap, actual_revenue AS ar, predicted_purchases AS score, predicted_revenue AS rev FROM co
  UNION ALL SELECT cutoff, cohort, customer_id, 'naive2', CAST(actual_purchases AS DOUBLE), actual_revenue, naive2_purchases, naive2_revenue FROM co
  UNION ALL SELECT cutoff, cohort, customer_id, 'tenure', CAST(actual_purchases AS DOUBLE), actual_revenue, -T, NULL FROM co WHERE cohort = 'f0'),
 rk AS (SELECT *, rank() OVER (PARTITION BY cutoff, cohort, score_name ORDER BY score) + (count(*) OVER (PARTITION BY cutoff, cohort, score_name, score) - 1) / 2.0e0 AS rx,
   rank() OVER (PARTITION BY cutoff, cohort, score_name ORDER BY ap) + (count(*) OVER (PARTITION BY cutoff, cohort, score_name, ap) - 1) / 2.0e0 AS ry,
   row_number() OVER (PARTITION BY cutoff, cohort, score_name ORDER BY score DESC, customer_id) AS rn, count(*) OVER (PARTITION BY cutoff, cohort, score_name) AS nn FROM lg)"""


def _cohort_sql(where):
    return f"""WITH {cs.PREDS}, {_COHORTS} SELECT cutoff, cohort, score_name, count(*) AS n,
  {rnd("avg(CASE WHEN score_name <> 'tenure' THEN abs(ap - score) END)", 6)} AS mae_purchases,
  {rnd("avg(CASE WHEN score_name <> 'tenure' THEN abs(ar - rev) END)", 2)} AS mae_revenue,
  {rnd("CASE WHEN max(rx) > min(rx) AND max(ry) > min(ry) THEN corr(rx, ry) ELSE 0.0e0 END", 7)} AS spearman_rho,
  {rnd("sum(CASE WHEN rn <= greatest(1, ceil(0.1e0 * nn)) THEN ap ELSE 0 END) / greatest(1.0e0, sum(ap)) * 100.0e0", 6)} AS top_capture_pct
  FROM rk {where} GROUP BY cutoff, cohort, score_name"""


def _cohort(df):
    return df.select("cutoff", "cohort", "score_name", "n", round_half("mae_purchases", 6).alias("mae_purchases"),
                     round_half("mae_revenue", 2).alias("mae_revenue"), round_half("spearman_rho", 7).alias("spearman_rho"),
                     round_half("top_capture_pct", 6).alias("top_capture_pct"))


@query("r20_cohort_comparison", _cohort_sql("WHERE score_name <> 'tenure'"))
def r20(f):
    return _cohort(validation.cohort_comparison(preds(f)).where(F.col("score_name") != "tenure"))


@query("r21_tenure_benchmark", _cohort_sql("WHERE cohort = 'f0'"))
def r21(f):
    return _cohort(validation.cohort_comparison(preds(f)).where(F.col("cohort") == "f0"))





@query("r22_decile_calibration", f"""WITH {cs.PREDS}, dr AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY predicted_purchases, customer_id) AS rn,
  count(*) OVER (PARTITION BY cutoff) AS n FROM preds)
  SELECT cutoff, 'D' || lpad(CAST({qcut('rn', 'n', 10)} AS VARCHAR), 2, '0') AS decile_rank, count(*) AS customer_count,
  {rnd('avg(actual_purchases)', 6)} AS avg_actual_purchases, {rnd('avg(predicted_purchases)', 6)} AS avg_predicted_purchases,
  {rnd('avg(actual_revenue)', 3)} AS avg_actual_spend, {rnd('avg(predicted_revenue)', 3)} AS avg_predicted_spend FROM dr GROUP BY 1, 2""")
def r22(f):
    d = validation.decile_table(preds(f))
    digits = {"avg_actual_purchases": 6, "avg_predicted_purchases": 6, "avg_actual_spend": 3, "avg_predicted_spend": 3}
    return d.select("cutoff", "decile_rank", "customer_count", *[round_half(c, k).alias(c) for c, k in digits.items()])


_TARGET = f"""tg AS (SELECT cutoff, CAST(dd AS INTEGER) AS inactive_days, T - recency <= dd AS hit, CASE WHEN actual_purchases > 0 THEN 1 ELSE 0 END AS b,
   row_number() OVER (PARTITION BY cutoff, dd ORDER BY p_alive DESC, predicted_purchases DESC, customer_id) AS rn,
   sum(CASE WHEN T - recency <= dd THEN 1 ELSE 0 END) OVER (PARTITION BY cutoff, dd) AS k FROM preds, (VALUES (60), (90), (180), (270)) v(dd)),
 ta AS (SELECT cutoff, inactive_days, CAST(max(k) AS BIGINT) AS k, count(*) AS n, CAST(sum(b) AS DOUBLE) AS pos, CAST(sum(CASE WHEN hit THEN b ELSE 0 END) AS DOUBLE) AS tp,
   CAST(sum(CASE WHEN rn <= k THEN b ELSE 0 END) AS DOUBLE) AS pa FROM tg GROUP BY cutoff, inactive_days),
 tp AS (SELECT cutoff, inactive_days, k AS matched_size, k / n * 100.0e0 AS s, coalesce(tp / nullif(k, 0) * 100.0e0, 0) AS rp, coalesce(tp / nullif(pos, 0) * 100.0e0, 0) AS rr,
   coalesce(pa / nullif(k, 0) * 100.0e0, 0) AS pp, coalesce(pa / nullif(pos, 0) * 100.0e0, 0) AS pr FROM ta)"""


@query("r23_matched_targeting", f"""WITH {cs.PREDS}, {_TARGET} SELECT cutoff, inactive_days, matched_size, {rnd('s', 6)} AS cohort_share_pct,
  {rnd('rp', 6)} AS recency_precision, {rnd('rr', 6)} AS recency_recall, {rnd('pp', 6)} AS p_alive_precision, {rnd('pr', 6)} AS p_alive_recall,
  {rnd('pp - rp', 6)} AS delta_precision, {rnd('pr - rr', 6)} AS delta_recall FROM tp""")
def r23(f):
    return rounded(validation.matched_targeting(preds(f)))


_MODEL_SQL = " UNION ALL ".join(
    f"SELECT cutoff, '{n}' AS model, frequency, CAST(actual_purchases AS DOUBLE) AS ap, actual_revenue AS ar, {p}predicted_purchases AS p, "
    f"{p}predicted_revenue AS r, {p}p_alive AS a FROM preds" for n, p in validation.MODELS)


@query("r24_model_comparison", f"""WITH {cs.PREDS}, ml AS ({_MODEL_SQL}) SELECT cutoff, model, {rnd('avg(abs(ap - p))', 6)} AS mae_purchases,
  {rnd('avg(CASE WHEN frequency = 0 THEN abs(ap - p) END)', 5)} AS mae_purchases_f0, {rnd('avg(CASE WHEN frequency > 0 THEN abs(ap - p) END)', 6)} AS mae_purchases_fpos,
  {rnd('avg(abs(ar - r))', 2)} AS mae_revenue, {rnd('avg(CASE WHEN frequency = 0 THEN abs(ar - r) END)', 2)} AS mae_revenue_f0,
  {rnd('avg(CASE WHEN frequency > 0 THEN abs(ar - r) END)', 2)} AS mae_revenue_fpos, {rnd('sum(ap)', 3)} AS total_actual_purchases,
  {rnd('sum(p)', 3)} AS total_predicted_purchases, {rnd('sum(ar)', 1)} AS total_actual_revenue, {rnd('sum(r)', 1)} AS total_predicted_revenue,
  {rnd('avg(CASE WHEN a > 0.8e0 THEN 1.0e0 ELSE 0.0e0 END) * 100.0e0', 6)} AS share_alive_pct FROM ml GROUP BY cutoff, model""")
def r24(f):
    d = validation.model_comparison(preds(f))
    digits = {c: 6 for c in ("mae_purchases", "mae_purchases_f0", "mae_purchases_fpos", "share_alive_pct")}
    digits["mae_purchases_f0"] = 5  # the mean of a handful of 6-digit values: 6 digits would often be a tie
    digits |= {c: 2 for c in ("mae_revenue", "mae_revenue_f0", "mae_revenue_fpos")}
    digits |= {c: 3 for c in ("total_actual_purchases", "total_predicted_purchases")}
    digits |= {c: 1 for c in ("total_actual_revenue", "total_predicted_revenue")}
    return d.select("cutoff", "model", *[round_half(c, k).alias(c) for c, k in digits.items()])


@query("r24_model_comparison_fitted")
def r24f(f):
    return validation.model_comparison(fitted_preds(f))


def _record_sql():
    parts = []
    for name, c in (("", "predicted"), ("naive1_", "naive1"), ("naive2_", "naive2"), ("naive3_", "naive3")):
        e = f"(actual_purchases - {c}_purchases)"
        parts += [f"{rnd(f'avg(abs({e}))', 6)} AS {name}mae_purchases", f"{rnd(f'sqrt(avg({e} * {e}))', 6)} AS {name}rmse_purchases"]
        err = f"(sum({c}_purchases) - sum(actual_purchases)) / greatest(1.0e0, sum(actual_purchases)) * 100.0e0"
        parts.append(f"{rnd(err, 5)} AS {name}volume_error_pct")
        if name:
            parts.append(f"{rnd(f'sum({c}_purchases)', 3)} AS {name}total_purchases")
    return f"""WITH {cs.PREDS} SELECT max(holdout_duration_days) AS holdout_days, CAST(sum(actual_purchases) AS DOUBLE) AS total_actual_purchases,
  {rnd('sum(predicted_purchases)', 3)} AS total_predicted_purchases, {rnd('sum(actual_revenue)', 1)} AS total_actual_revenue,
  {rnd('sum(predicted_revenue)', 1)} AS total_predicted_revenue, {rnd('corr(actual_purchases, predicted_purchases)', 7)} AS pearson_r, {', '.join(parts)},
  {rnd('avg(abs(actual_purchases - predicted_purchases))', 6)} AS mae, {rnd('sqrt(avg((actual_purchases - predicted_purchases) * (actual_purchases - predicted_purchases)))', 6)} AS rmse,
  'Maximum Likelihood Estimation (MLE)' AS estimation_method, '{CUTOFFS[0]}' AS calibration_end_date, '{CUTOFFS[0]}' AS observation_end_date,
  '{HOLDOUT_END}' AS holdout_end_date,
  {rnd('corr(frequency, monetary_value_repeat) FILTER (WHERE frequency > 0 AND monetary_value_repeat > 0)', 9)} AS freq_monetary_corr
  FROM preds WHERE cutoff = '{CUTOFFS[0]}'"""


@query("r25_holdout_record", _record_sql())
def r25(f):
    one = preds(f).where(F.col("cutoff") == CUTOFFS[0])
    corr = rfm.frequency_monetary_correlation(one).select("pearson_r").scalar()
    p_value = rfm.independence_check(splits(f).where(F.col("cutoff") == CUTOFFS[0]))["p_value"]  # its value is checked by r3_independence_check
    rec = validation.holdout_record(one, CUTOFFS[0], HOLDOUT_END, corr, p_value).drop("freq_monetary_pval")

    def digits(c):
        if c == "freq_monetary_corr":
            return 9
        if c.endswith("_revenue"):
            return 1
        if c == "pearson_r":
            return 7
        return 5 if c.endswith("_pct") else 3 if "total" in c else 6
    return rec.select(*[round_half(c, digits(c)).alias(c) if t == "double" else F.col(c) for c, t in rec.dtypes])


@query("r27_tenure_calibration", f"""WITH {cs.PREDS}, oo AS (SELECT * FROM preds WHERE frequency = 0),
  ed AS (SELECT cutoff, quantile_cont(T, 0.2) AS e1, quantile_cont(T, 0.4) AS e2, quantile_cont(T, 0.6) AS e3, quantile_cont(T, 0.8) AS e4 FROM oo GROUP BY cutoff),
  bb AS (SELECT oo.*, 1 + (T > e1)::INT + (T > e2)::INT + (T > e3)::INT + (T > e4)::INT AS tenure_bin FROM oo JOIN ed ON oo.cutoff = ed.cutoff)
  SELECT cutoff, CAST(tenure_bin AS INTEGER) AS tenure_bin, count(*) AS customers, {rnd('avg(actual_purchases)', 6)} AS mean_actual,
  {rnd('avg(predicted_purchases)', 6)} AS mean_predicted,
  {rnd('abs(avg(actual_purchases) - avg(predicted_purchases)) / avg(predicted_purchases)', 6)} AS relative_error FROM bb GROUP BY 1, 2""")
def r27(f):
    return rounded(validation.tenure_calibration(preds(f)))


# ------------------------------------------------------------------ portfolio views

@query("r28_portfolio_kpis", f"""WITH {cs.SCORES}, {DIM_CUSTOMERS} SELECT {rnd('avg(clv_12m)', 3)} AS mean_clv_12m, {rnd('sum(clv_12m)', 1)} AS total_clv_12m,
  {rnd('avg(p_alive)', 7)} AS mean_p_alive, {rnd('avg(CASE WHEN p_alive > 0.8e0 THEN 1.0e0 ELSE 0.0e0 END)', 7)} AS share_alive, count(*) AS scored_customers,
  (SELECT count(*) FROM dim_customers) - count(*) AS returns_only_customers FROM scores""")
def r28(f):
    k = validation.portfolio_kpis(scores(f), f.stg().select("customer_id").distinct())
    return k.select(round_half("mean_clv_12m", 3).alias("mean_clv_12m"), round_half("total_clv_12m", 1).alias("total_clv_12m"),
                    round_half("mean_p_alive", 7).alias("mean_p_alive"), round_half("share_alive", 7).alias("share_alive"),
                    "scored_customers", "returns_only_customers")


def _bin(expr):
    return f"CAST(least(40, greatest(1, CAST(floor({expr} * 40.0e0) AS INTEGER) + 1)) AS INTEGER)"


@query("r29_alive_histogram", f"WITH {cs.SCORES} SELECT {_bin('(p_alive - 0.0e0) / (1.0e0 - 0.0e0)')} AS bin, count(*) AS customers FROM scores GROUP BY 1")
def r29(f):
    return validation.alive_histogram(scores(f))


@query("r29_value_histogram", f"""WITH {cs.SCORES}, ct AS (SELECT quantile_cont(clv_12m, 0.98) AS c FROM scores)
  SELECT {_bin('(clv_12m - 0.0e0) / (c - 0.0e0)')} AS bin, count(*) AS customers FROM scores, ct WHERE clv_12m < c GROUP BY 1""")
def r29v(f):
    return validation.value_histogram(scores(f))


_RBINS = (("0–60d", 60), ("61–150d", 150), ("151–300d", 300), ("301–450d", 450), ("451–600d", 600), ("601+d", None))


@query("r30_alive_heatmap", f"""WITH {cs.SCORES}, fb(f_bin, lo, hi) AS (VALUES {', '.join(f"('{a}', {b}, {c if c is not None else 1000000})" for a, b, c in validation.FREQUENCY_BINS)}),
  rb(r_bin, lo, hi) AS (VALUES {', '.join(f"('{lab}', {-1 if i == 0 else _RBINS[i - 1][1]}, {1000000 if up is None else up})" for i, (lab, up) in enumerate(_RBINS))})
  SELECT f_bin, r_bin, {rnd('avg(p_alive)', 7)} AS mean_p_alive, count(p_alive) AS customers FROM fb CROSS JOIN rb
  LEFT JOIN scores ON frequency BETWEEN fb.lo AND fb.hi AND recency > rb.lo AND recency <= rb.hi GROUP BY f_bin, r_bin""")
def r30(f):
    h = validation.alive_heatmap(scores(f), _RBINS)
    return h.withColumn("mean_p_alive", round_half("mean_p_alive", 7))


@query("r31_customer_horizons", f"""WITH {cs.SCORES} SELECT customer_id, '12 Months (1 Year)' AS forecast_horizon, clv_12m AS expected_clv,
  CAST(NULL AS DOUBLE) AS clv_lower, CAST(NULL AS DOUBLE) AS clv_upper, expected_purchases_12m AS expected_repeat_purchases FROM scores
  UNION ALL SELECT customer_id, '24 Months (2 Years)', clv_24m, NULL, NULL, expected_purchases_24m FROM scores""")
def r31(f):
    return validation.customer_horizons(scores(f))


@query("r31_customer_bounds")
def r31b(f):
    """The same lookup with bootstrap bounds."""
    _, _, refits, failed = bootstrap(f)
    return _with_counts(validation.customer_horizons(scoring.bootstrap_bounds(scores(f), refits)), refits, failed)


# ------------------------------------------------------------------ checks and facts that need scores

@query("q9_prediction_validity", f"""WITH {cs.PREDS}, st AS (SELECT cutoff, predicted_purchases AS v, 'all' AS stratum FROM preds UNION ALL
   SELECT cutoff, predicted_purchases, CASE WHEN frequency = 0 THEN 'f0' ELSE 'fpos' END FROM preds)
  SELECT stratum, count(*) AS row_count, count(CASE WHEN isnan(v) THEN 1 END) AS nan_count, count(CASE WHEN isinf(v) THEN 1 END) AS inf_count,
  count(CASE WHEN v < 0 THEN 1 END) AS negative_count, min(v) AS min_value, {rnd('quantile_cont(v, 0.5)', 7)} AS median_value, max(v) AS max_value FROM st GROUP BY stratum""")
def q9(f):
    return quality.prediction_validity(preds(f), "predicted_purchases").withColumn("median_value", round_half("median_value", 7))


@query("o4_dataset_facts", f"""WITH {cs.SCORES}, {DIM_CUSTOMERS} SELECT (SELECT count(*) FROM stg WHERE NOT is_return) AS order_lines,
  (SELECT count(*) FROM stg WHERE is_return) AS return_lines, (SELECT count(*) FROM stg) AS total_lines,
  (SELECT min(invoice_date) FROM stg WHERE NOT is_return) AS min_date, (SELECT max(invoice_date) FROM stg WHERE NOT is_return) AS max_date,
  (SELECT count(*) FROM dim_customers) AS total_customers, count(*) AS scored_customers, {rnd('avg(p_alive)', 6)} AS mean_p_alive FROM scores""")
def o4(f):
    stg = f.stg()
    return reporting.dataset_facts(warehouse.order_lines(stg), warehouse.return_lines(stg), warehouse.dim_customers(stg), scores(f))
