"""Synthetic control on donor cohorts, placebo-in-space and leave-one-donor-out.

Customers are averaged into at most ``n_donors`` series by one aggregation; everything after that is a
weeks x donors table. The refits (one per placebo donor and one per left-out donor) run as independent
Spark groups of that table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tallyfield.config import DEFAULTS
from tallyfield.functions.durable import stored
from tallyfield.functions.numeric import hash_uniform, money_sum, round_half
from tallyfield.functions.ordering import with_row_number

# fixed values: kinds of refit
MAIN, PLACEBO, LEAVE_OUT = "main", "placebo", "leave_one_out"


def donor_cohorts(panel: DataFrame, n_donors: int = 50, seed: int = DEFAULTS.seed, treatment: str = "is_treated",
                  customer: str = "customer_id") -> DataFrame:
    """Control customers dealt into donor cohorts 0..J-1 in hash order. ``panel``: any rows that have every customer with its treatment."""
    controls = panel.where(F.col(treatment) == 0).select(customer).distinct() \
        .withColumn("__u", hash_uniform(customer, F.lit(seed)))
    ranked = with_row_number(controls, ["__u", customer], out="__rn")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.select(customer, F.pmod(F.col("__rn") - 1, F.least(F.lit(n_donors), total)).cast("int").alias("donor_cohort"))


def trajectories(panel: DataFrame, outcome: str, donors: DataFrame | None = None, treatment: str = "is_treated",
                 customer: str = "customer_id", time: str = "week_date") -> DataFrame:
    """Mean outcome (summed exactly, so it does not depend on row order) per week of the treated (series -1) and of each donor cohort; weeks x (donors + 1) rows.

    Without ``donors`` the panel has the column donor_cohort already.
    """
    series = F.when(F.col(treatment) == 1, F.lit(-1)).otherwise(F.col("donor_cohort"))
    if donors is not None:
        panel = panel.select(customer, time, treatment, outcome).join(donors, customer, "left")
    y, n = F.col(outcome), F.count(outcome)
    # most weeks are 0 and need no decimal addition
    total = F.coalesce(money_sum(F.when(y != 0, y)), F.lit(0.0))
    return (panel.groupBy(F.col(time).alias("week_date"), series.alias("series"))
            .agg(F.when(n > 0, total / n).alias("mean_outcome")))


def donor_matrix(series: DataFrame, t0: str) -> DataFrame:
    """One row per treated week: target value and the donor values in order, missing ones 0."""
    target = series.where(F.col("series") == -1).select("week_date", F.col("mean_outcome").alias("target"))
    top = series.agg(F.max("series")).scalar()
    # at most n_donors entries per week
    donors = (series.where(F.col("series") >= 0).groupBy("week_date").agg(
        F.map_from_entries(F.collect_list(F.struct("series", "mean_outcome"))).alias("__m")))
    filled = F.transform(F.sequence(F.lit(0), F.col("__top")), lambda j: F.coalesce(F.try_element_at("__m", j), F.lit(0.0)))
    return (target.join(donors, "week_date", "left").withColumn("__top", top).where(F.col("__top") >= 0)
            .select("week_date", "target",
                    F.when(F.col("__m").isNull(), F.transform(F.sequence(F.lit(0), F.col("__top")), lambda j: F.lit(0.0)))
                    .otherwise(filled).alias("donors"),
                    (F.col("week_date") >= F.lit(t0).cast("date")).alias("is_post")))


def _solve_kkt(kkt: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    try:
        v = np.linalg.solve(kkt, rhs)
        if np.all(np.isfinite(v)) and np.abs(kkt @ v - rhs).max() < 1e-9:
            return v
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(kkt, rhs, rcond=None)[0]  # more active donors than weeks, or equal donors


def kkt_residual(gram: np.ndarray, cross: np.ndarray, w: np.ndarray) -> float:
    """How far w is from the optimum over w >= 0, sum(w) = 1: at the optimum all donors in use have one slope and no other a smaller one."""
    if not w.size:
        return 0.0
    grad = gram @ w - cross
    level = float(grad @ w)
    used = w > 0
    worst = max(float(np.abs(grad[used] - level).max(initial=0.0)), float((level - grad).max(initial=0.0)))
    return max(worst / max(1.0, float(np.abs(gram).max())), abs(float(w.sum()) - 1.0), float(-w.min()))


def simplex_weights(y: np.ndarray, donors: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Least squares over w >= 0, sum(w) = 1: (weights, KKT residual, rounds).

    An active-set search: each round lets in the donor with the steepest slope and solves on the donors in use, leaving out those that
    would turn negative. The loss falls in every round, so no set of donors comes twice and the search ends by itself at the optimum; the residual says
    how exactly.
    """
    j = donors.shape[1]
    if j == 0:
        return np.zeros(0), 0.0, 0
    gram, cross = donors.T @ donors, donors.T @ y
    unit = float(np.mean(np.diag(gram))) or 1.0  # keeps the sum constraint on the scale of the rest
    gram, cross = gram / unit, cross / unit

    def loss(w: np.ndarray) -> float:
        return float(0.5 * w @ gram @ w - cross @ w)
    w = np.zeros(j)
    w[int(np.argmin(np.diag(gram) - 2.0 * cross))] = 1.0
    slack = 1e-12 * max(1.0, float(np.abs(gram).max()))
    rounds, barred = 0, np.zeros(j, dtype=bool)
    while True:
        grad = gram @ w - cross
        level = float(grad @ w)
        best = int(np.argmin(np.where(barred | (w > 0), np.inf, grad)))
        if barred[best] or w[best] > 0 or grad[best] >= level - slack:
            break
        rounds += 1
        new, active = w.copy(), w > 0
        active[best] = True
        while True:
            idx = np.flatnonzero(active)
            m = len(idx)
            kkt = np.zeros((m + 1, m + 1))
            kkt[:m, :m] = gram[np.ix_(idx, idx)]
            kkt[:m, m] = kkt[m, :m] = 1.0
            v = _solve_kkt(kkt, np.append(cross[idx], 1.0))[:m]
            if (v > 0).all():
                new = np.zeros(j)
                new[idx] = v / v.sum()
                break
            current, falling = new[idx], v <= 0
            gap = current[falling] - v[falling]
            step = min(1.0, float(np.where(gap > 0, current[falling] / np.where(gap > 0, gap, 1.0), 0.0).min()))
            moved = current + step * (v - current)
            leaving = falling & (moved <= 1e-15)
            if not leaving.any():
                leaving = falling & (np.arange(m) == np.flatnonzero(falling)[0])
            moved[leaving] = 0.0
            new = np.zeros(j)
            new[idx] = np.maximum(moved, 0.0)
            active[idx[leaving]] = False
            if not active.any():
                break
        if new.sum() > 0 and loss(new) < loss(w):
            w, barred = new / new.sum(), np.zeros(j, dtype=bool)
        else:
            barred[best] = True  # rounding ate the gain of this donor; another one may still gain
    return w, kkt_residual(gram, cross, w), rounds


_RESULT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("donor", T.IntegerType()), T.StructField("estimated_att", T.DoubleType()),
    T.StructField("pre_rmspe", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("kkt_residual", T.DoubleType()), T.StructField("rounds", T.IntegerType())])


def _solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    kind, donor = key
    pdf = pdf.sort_values("week_date")
    all_donors = np.stack(pdf["donors"].to_numpy())
    target = pdf["target"].to_numpy(float)
    keep = np.ones(all_donors.shape[1], dtype=bool)
    if kind != MAIN:
        keep[donor] = False
    if kind == PLACEBO:
        target = all_donors[:, donor]
    pool, post = all_donors[:, keep], pdf["is_post"].to_numpy(bool)
    if pool.shape[1] == 0:
        return pd.DataFrame(columns=[f.name for f in _RESULT])
    w, residual, rounds = simplex_weights(target[~post], pool[~post])
    gap = target - pool @ w
    rmspe = float(np.sqrt(np.mean(gap[~post] ** 2))) if (~post).any() else float("nan")
    full = np.zeros(all_donors.shape[1])
    full[keep] = w
    return pd.DataFrame([(kind, int(donor), float(gap[post].mean()) if post.any() else float("nan"), rmspe, full.tolist(), residual, rounds)],
                        columns=[f.name for f in _RESULT])


def refits(matrix: DataFrame, kinds: tuple[str, ...] = (MAIN, PLACEBO, LEAVE_OUT)) -> DataFrame:
    """Weights, effect and fit of the main problem and of every placebo / left-out donor."""
    every = F.sequence(F.lit(0), F.size("donors") - 1)

    def per_donor(kind: str):
        return F.transform(every, lambda j: F.struct(F.lit(kind).alias("kind"), j.alias("donor")))

    problems = []
    if MAIN in kinds:
        problems.append(F.array(F.struct(F.lit(MAIN).alias("kind"), F.lit(-1).alias("donor"))))
    problems += [per_donor(kind) for kind in (PLACEBO, LEAVE_OUT) if kind in kinds]
    spread = matrix.withColumn("p", F.explode(F.concat(*problems))).select("p.*", "week_date", "target", "donors", "is_post")
    return spread.groupBy("kind", "donor").applyInPandas(_solve, _RESULT)


def weight_table(fits: DataFrame) -> DataFrame:
    main = fits.where(F.col("kind") == MAIN).select(F.posexplode("weights").alias("j", "w"))
    return main.select(F.concat(F.lit("Donor_Cohort_"), F.lpad((F.col("j") + 1).cast("string"), 2, "0")).alias("donor_cohort"),
                       round_half("w", 4).alias("weight"))


def certificates(fits: DataFrame, matrix: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row per refit: feasible weights, optimal weights, and effect and fit worked out again from the weights by table operations."""
    pairs = fits.select("kind", "donor", F.col("estimated_att").alias("__att"), F.col("pre_rmspe").alias("__rmspe"), "weights", "kkt_residual")
    synthetic = F.aggregate(F.zip_with("donors", "weights", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    own = F.when(F.col("kind") == PLACEBO, F.element_at("donors", F.col("donor") + 1)).otherwise(F.col("target"))
    # every refit meets every week: donors x weeks rows, whatever the number of customers
    gaps = matrix.join(pairs.select("kind", "donor", "weights"), F.lit(True)).select("kind", "donor", "is_post", (own - synthetic).alias("g"))
    again = gaps.groupBy("kind", "donor").agg(F.avg(F.when(F.col("is_post"), F.col("g"))).alias("att"),
                                              F.sqrt(F.avg(F.when(~F.col("is_post"), F.col("g") * F.col("g")))).alias("rmspe"))

    def near(a: str, b: str):
        return F.abs(F.col(a) - F.col(b)) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(F.col(a)))
    total = F.aggregate("weights", F.lit(0.0), lambda acc, v: acc + v)
    return pairs.join(again, ["kind", "donor"]).select(
        "kind", "donor", ((F.array_min("weights") >= 0) & (F.abs(total - 1) <= 1e-9)).alias("feasible"), (F.col("kkt_residual") < tolerance).alias("optimal"),
        (near("__att", "att") & near("__rmspe", "rmspe")).alias("effect_confirmed"),
        F.when(F.col("donor") >= 0, F.element_at("weights", F.col("donor") + 1) == 0).otherwise(F.lit(True)).alias("own_weight_zero"))


def summary(fits: DataFrame) -> DataFrame:
    """Main estimate with its fit and the placebo-in-space p-value, in one pass over the refits."""
    main = F.col("kind") == MAIN
    agg = fits.agg(
        F.max(F.when(main, F.col("estimated_att"))).alias("estimated_att"), F.max(F.when(main, F.col("pre_rmspe"))).alias("pre_rmspe"),
        F.collect_list(F.when(F.col("kind") == PLACEBO, F.abs("estimated_att"))).alias("placebos"))  # one number per donor
    beyond = F.size(F.filter("placebos", lambda e: e >= F.abs(F.col("estimated_att"))))
    n = F.size("placebos")
    return agg.select("estimated_att", "pre_rmspe", n.alias("n_donors"),
                      F.when(n > 0, (beyond + 1) / (n + 1)).otherwise(F.lit(1.0)).alias("placebo_pval"),
                      F.col("estimated_att").isNull().alias("degenerate"))


def leave_one_out(fits: DataFrame) -> DataFrame:
    runs = fits.where(F.col("kind") == LEAVE_OUT)
    a = F.col("estimated_att")
    zero = F.lit(0.0)
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.avg(a), zero).alias("mean_att"),
                    F.coalesce(F.stddev_pop(a), zero).alias("std_att"), F.coalesce(F.min(a), zero).alias("min_att"),
                    F.coalesce(F.max(a), zero).alias("max_att"))


def gap_with_weights(matrix: DataFrame, weights: list[float]) -> DataFrame:
    """Effect and pre-period fit for given weights, without any optimization."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    synthetic = F.aggregate(F.zip_with("donors", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    g = matrix.select("is_post", (F.col("target") - synthetic).alias("g"))
    return g.agg(F.avg(F.when(F.col("is_post"), F.col("g"))).alias("estimated_att"),
                 F.sqrt(F.avg(F.when(~F.col("is_post"), F.col("g") * F.col("g")))).alias("pre_rmspe"))


def synthetic_control(panel: DataFrame, t0: str, outcome: str, n_donors: int = 50, seed: int = DEFAULTS.seed,
                      kinds: tuple[str, ...] = (MAIN, PLACEBO, LEAVE_OUT), beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All refits of one outcome. beside: gives the panel with columns per customer, where there is a cheaper way than a join with the panel."""
    donors = donor_cohorts(panel, n_donors, seed)
    series = trajectories(panel, outcome, donors) if beside is None else trajectories(beside(donors), outcome)
    return refits(donor_matrix(stored(series, "trajectories"), t0), kinds)
