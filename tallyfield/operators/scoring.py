"""Scoring with purchase-frequency models (BG/NBD, MBG/NBD, Pareto/NBD) and Gamma-Gamma order values.

Closed forms that Spark can express are Column expressions. Expected purchases need a hypergeometric
series or a quadrature; those run as vectorized pandas UDFs, all horizons of a customer at once, so a
24-month discounted value needs neither a row explosion nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyfield.config import DEFAULTS, Settings
from tallyfield.functions.numeric import round_half
from tallyfield.functions.special import beta_nodes, dyadic_nodes, hyp2f1_series
from tallyfield.operators.quality import require_valid
from tallyfield.operators.rfm import monetary_column



@dataclass(frozen=True)
class BetaGeometric:
    """BG/NBD parameters; ``modified`` selects MBG/NBD, where a customer may drop out right away."""
    r: float
    alpha: float
    a: float
    b: float
    modified: bool = False

    def beta_b(self, x):
        return self.b + x + (1.0 if self.modified else 0.0)


@dataclass(frozen=True)
class ParetoNbd:
    r: float
    alpha: float
    s: float
    beta: float


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    v: float


# ------------------------------------------------------------------ closed forms

def p_alive(m: BetaGeometric, x: str = "frequency", tx: str = "recency", age: str = "T") -> Column:
    """Probability of still being active. In BG/NBD it is exactly 1 without a repeat order."""
    xf = F.col(x).cast("double")
    power = F.pow((F.lit(m.alpha) + F.col(age)) / (F.lit(m.alpha) + F.col(tx)), F.lit(m.r) + xf)
    if m.modified:
        return F.lit(1.0) / (F.lit(1.0) + F.lit(m.a) / (F.lit(m.b) + xf) * power)
    return F.when(xf == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(m.a) / (F.lit(m.b) + xf - 1.0) * power))


def expected_order_value(g: GammaGamma, x: str = "frequency", value: str = "monetary_value_repeat") -> Column:
    """Conditional mean order value; the population mean p v / (q - 1) when x = 0."""
    xf = F.col(x).cast("double")
    return F.lit(g.p) * (F.lit(g.v) + xf * F.col(value)) / (F.lit(g.p) * xf + F.lit(g.q - 1.0))


def mean_order_value(df: DataFrame, g: GammaGamma, settings: Settings = DEFAULTS) -> Column:
    """Mean expected order value of repeat customers, as a scalar."""
    value = expected_order_value(g, value=monetary_column(df))
    return df.where(F.col("frequency") > 0).agg(
        F.coalesce(F.avg(value), F.lit(settings.fallback_order_value))).scalar()


def _mean_base(df: DataFrame, settings: Settings) -> DataFrame:
    base = "monetary_value" if "monetary_value" in df.columns else monetary_column(df)
    return df.where(F.col(base) > 0).agg(F.coalesce(F.avg(base), F.lit(settings.fallback_order_value)))


def mean_base_value(df: DataFrame, settings: Settings = DEFAULTS) -> Column:
    return _mean_base(df, settings).scalar()


def with_expected_order_value(df: DataFrame, g: GammaGamma, out: str = "expected_avg_order_value",
                              settings: Settings = DEFAULTS) -> DataFrame:
    m = monetary_column(df)
    return df.withColumn(out, F.when((F.col("frequency") > 0) & (F.col(m) > 0), expected_order_value(g, value=m))
                         .otherwise(mean_order_value(df, g, settings)))


def with_unified_value(df: DataFrame, g: GammaGamma, out: str = "unified_value", settings: Settings = DEFAULTS) -> DataFrame:
    """Repeat customers: model value. One-time customers: their own order value, or the mean if not positive."""
    m = monetary_column(df)
    base = "monetary_value" if "monetary_value" in df.columns else m
    return df.withColumn(out, F.when(F.col("frequency") > 0, expected_order_value(g, value=m))
                         .when(F.col(base) > 0, F.col(base)).otherwise(mean_base_value(df, settings)))


# ------------------------------------------------------------------ kernels used inside tasks

def _alive(m: BetaGeometric, x, tx, age):
    log_power = (m.r + x) * np.log((m.alpha + age) / (m.alpha + tx))
    if m.modified:
        return 1.0 / (1.0 + m.a / (m.b + x) * np.exp(log_power))
    return np.where(x == 0, 1.0, 1.0 / (1.0 + m.a / np.maximum(m.b + x - 1.0, 1e-300) * np.exp(log_power)))


def _purchases_given_alive(m: BetaGeometric, x, age, t):
    """E[purchases in (T, T + t] | alive] with dropout p ~ Beta(a, b'). The series is the Euler-transformed
    Gauss function: its terms stay small for many past orders and nothing under- or overflows."""
    def at(a):
        c = a + m.beta_b(x) - 1.0
        z = t / (m.alpha + age + t)
        f = hyp2f1_series(c - (m.r + x), a - 1.0, c, z)
        return c / (a - 1.0) * (1.0 - (1.0 - z) ** (a - 1.0) * f)
    if abs(m.a - 1.0) < 1e-6:  # removable singularity
        return 0.5 * (at(1.0 + 1e-5) + at(1.0 - 1e-5))
    return at(m.a)


def _purchases_once(m: BetaGeometric, age, t):
    """The same expectation for x = 0 as a mean over the dropout probability p ~ Beta: a customer who stays with probability 1 - p after each
    order makes (1 - (1 + p t / (alpha + T))^-r) / p further ones."""
    p, w = beta_nodes(m.a, m.beta_b(0.0))
    pace = np.asarray(t, dtype=float) / (m.alpha + np.asarray(age, dtype=float))
    z = pace[..., None] * p
    safe = np.where(z > 0, z, 1.0)
    per = np.where(z > 0, -np.expm1(-m.r * np.log1p(safe)) / safe, m.r)
    return pace * (per @ w)


def bg_expected(m: BetaGeometric, x, tx, age, t) -> np.ndarray:
    """Expected purchases for customers (rows) and horizons (columns)."""
    x, tx, age = (np.asarray(v, dtype=float)[:, None] for v in (x, tx, age))
    t = np.asarray(t, dtype=float)[None, :]
    out = np.zeros((x.shape[0], t.shape[1]))
    once = x[:, 0] == 0
    if once.any():
        out[once] = _purchases_once(m, np.broadcast_to(age[once], (once.sum(), t.shape[1])),
                                          np.broadcast_to(t, (once.sum(), t.shape[1])))
    if (~once).any():
        out[~once] = _purchases_given_alive(m, x[~once], age[~once], t)
    return out * _alive(m, x, tx, age)


def dropout_nodes(alpha: float, rate, tx, age) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the dropout time y between the last order and T, per customer: log(alpha + y) and the log weights for dy.

    In log(alpha + y) the integrand falls exponentially at no more than ``rate`` and is smooth on the scale of 1.
    """
    span = np.log((alpha + age) / (alpha + tx))
    u, w = dyadic_nodes(float(np.max(rate * span, initial=1.0)))
    log_y = np.log(alpha + tx)[..., None] + span[..., None] * u
    with np.errstate(divide="ignore"):
        return log_y, log_y + np.log(span)[..., None] + np.log(w)


def pareto_terms(m: ParetoNbd, x, tx, age) -> tuple[np.ndarray, np.ndarray]:
    """Log of the two likelihood parts: still active at T, and dropped out between the last order and T."""
    x, tx, age = (np.asarray(v, dtype=float) for v in (x, tx, age))
    alive = -(m.r + x) * np.log(m.alpha + age) - m.s * np.log(m.beta + age)
    log_y, log_w = dropout_nodes(m.alpha, m.r + x + m.s + 1.0, tx, age)
    terms = log_w - (m.r + x)[..., None] * log_y - (m.s + 1.0) * np.log(m.beta - m.alpha + np.exp(log_y))
    top = np.maximum(terms.max(axis=-1), -1e300)
    with np.errstate(divide="ignore"):
        return alive, np.log(m.s) + top + np.log(np.exp(terms - top[..., None]).sum(axis=-1))


def pareto_alive(m: ParetoNbd, x, tx, age) -> np.ndarray:
    alive, gone = pareto_terms(m, x, tx, age)
    return np.exp(alive - np.logaddexp(alive, gone))


def pareto_expected(m: ParetoNbd, x, tx, age, t) -> np.ndarray:
    x, tx, age = (np.asarray(v, dtype=float) for v in (x, tx, age))
    t = np.asarray(t, dtype=float)[None, :]
    ratio = np.log((m.beta + age)[:, None] / ((m.beta + age)[:, None] + t))
    # (1 - e^((s-1) ratio)) / (s-1), with its limit -ratio at s = 1
    decay = -ratio if abs(m.s - 1.0) < 1e-9 else -np.expm1((m.s - 1.0) * ratio) / (m.s - 1.0)
    lead = (m.r + x) * (m.beta + age) / (m.alpha + age)
    return pareto_alive(m, x, tx, age)[:, None] * lead[:, None] * decay


# ------------------------------------------------------------------ Columns backed by the kernels

def expected_purchases(model, days: Sequence[float], x: str = "frequency", tx: str = "recency", age: str = "T") -> Column:
    """array<double> of expected purchases, one entry per horizon in days."""
    horizons = [float(d) for d in days]
    kernel = pareto_expected if isinstance(model, ParetoNbd) else bg_expected

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(xs: pd.Series, txs: pd.Series, ages: pd.Series) -> pd.Series:
        return pd.Series(list(kernel(model, xs.to_numpy(float), txs.to_numpy(float), ages.to_numpy(float), horizons)))

    return score(F.col(x).cast("double"), F.col(tx), F.col(age))


def pareto_p_alive(m: ParetoNbd, x: str = "frequency", tx: str = "recency", age: str = "T") -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(xs: pd.Series, txs: pd.Series, ages: pd.Series) -> pd.Series:
        return pd.Series(pareto_alive(m, xs.to_numpy(float), txs.to_numpy(float), ages.to_numpy(float)))
    return score(F.col(x).cast("double"), F.col(tx), F.col(age))


def discount_weights(months: int, rate: float) -> np.ndarray:
    """Weights on cumulative purchases at months 1..m: summation by parts of the discounted monthly increments."""
    d = (1.0 + rate) ** -np.arange(1, months + 1, dtype=float)
    return np.append(d[:-1] - d[1:], d[-1])


def discounted(path: Column, months: int, rate: float) -> Column:
    """Discounted purchases over the first ``months`` entries of a cumulative monthly path."""
    weights = F.array(*[F.lit(float(w)) for w in discount_weights(months, rate)])
    products = F.zip_with(F.slice(path, 1, months), weights, lambda e, w: e * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def score_customers(rfm: DataFrame, model: BetaGeometric, values: GammaGamma, settings: Settings = DEFAULTS,
                    horizons: Sequence[int] | None = None) -> DataFrame:
    """P(alive), expected order value, expected purchases and discounted value per horizon (months)."""
    horizons = sorted(set(horizons or settings.horizons))
    longest = max(horizons)
    days = [settings.days_per_month * k for k in range(1, longest + 1)]
    df = with_unified_value(with_expected_order_value(rfm, values, settings=settings), values, "__value", settings)
    df = (df.withColumn("estimation_method", F.lit(settings.estimation_method))
          .withColumn("p_alive", p_alive(model))
          .withColumn("__path", expected_purchases(model, days)))
    for m in horizons:
        df = (df.withColumn(f"expected_purchases_{m}m", round_half(F.col("__path")[m - 1], 2))
              .withColumn(f"clv_{m}m", round_half(F.col("__value") * discounted(F.col("__path"), m, settings.discount_rate), 2)))
    return df.drop("__path", "__value")


def bootstrap_bounds(scored: DataFrame, fits: Sequence[tuple[BetaGeometric, GammaGamma]], settings: Settings = DEFAULTS,
                     horizons: Sequence[int] | None = None) -> DataFrame:
    """2.5 / 97.5 percentiles of the value over refitted parameters, forced to contain the point value.

    Each customer is scored under every replicate inside one task; the replicates never become rows.
    """
    horizons = list(horizons or settings.horizons)
    longest = max(horizons)
    days = np.array([settings.days_per_month * k for k in range(1, longest + 1)])
    weights = {m: discount_weights(m, settings.discount_rate) for m in horizons}
    fields = [T.StructField(f"clv_{m}m_{side}", T.DoubleType()) for m in horizons for side in ("lower", "upper")]

    @F.pandas_udf(T.StructType(fields))
    def bounds(x: pd.Series, tx: pd.Series, age: pd.Series, repeat: pd.Series, base: pd.Series) -> pd.DataFrame:
        x, tx, age = x.to_numpy(float), tx.to_numpy(float), age.to_numpy(float)
        repeat, base = repeat.to_numpy(float), base.to_numpy(float)
        draws = {m: np.empty((len(x), len(fits))) for m in horizons}
        for i, (bg, gg) in enumerate(fits):
            path = bg_expected(bg, x, tx, age, days)
            value = np.where(x > 0, gg.p * (gg.v + x * repeat) / (gg.p * x + gg.q - 1.0), base)
            for m in horizons:
                draws[m][:, i] = value * (path[:, :m] @ weights[m])
        out = {}
        for m in horizons:
            low, high = np.percentile(draws[m], [2.5, 97.5], axis=1)
            out[f"clv_{m}m_lower"], out[f"clv_{m}m_upper"] = low, high
        return pd.DataFrame(out)

    mean = float(_mean_base(scored, settings).first()[0])  # a literal: inputs of a pandas UDF cannot hold a subquery
    base = F.when(F.col("monetary_value") > 0, F.col("monetary_value")).otherwise(F.lit(mean))
    df = scored.withColumn("__b", bounds(F.col("frequency").cast("double"), "recency", "T", monetary_column(scored), base))
    for m in horizons:
        point = F.col(f"clv_{m}m")
        df = (df.withColumn(f"clv_{m}m_lower", F.least(point, round_half(F.col(f"__b.clv_{m}m_lower"), 2)))
              .withColumn(f"clv_{m}m_upper", F.greatest(point, round_half(F.col(f"__b.clv_{m}m_upper"), 2))))
    return df.drop("__b")


def check_scores(scored: DataFrame, horizons: Sequence[int] = (12, 24)) -> DataFrame:
    """Raise on any missing, infinite, negative or out-of-range score."""
    require_valid(scored, ["p_alive"], 0.0, 1.0)
    return require_valid(scored, ["expected_avg_order_value", *[f"clv_{m}m" for m in horizons],
                                  *[f"expected_purchases_{m}m" for m in horizons]])
