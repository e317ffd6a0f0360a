"""Replicated power analysis of the fixed-effects estimator, evaluation tables and comparisons.

Replications are not copies of the panel. Before the policy and among controls every replication sees
the same data, and most cells of the panel are zero, so each task works on a block of customers with
their few order weeks and handles all replications of the block with array arithmetic. Two passes over
one row per customer give every estimate; what leaves a task are sums per replication.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tallyfield.config import DEFAULTS, Settings
from tallyfield.functions.durable import stored
from tallyfield.functions.selection import rows_at_ranks
from tallyfield.operators.did import finish_estimates
from tallyfield.operators.panel import COHORTS, OUTCOMES, last_week, monday_on_or_after, winsor_limit

HASH_BITS = 52
BLOCK = 4096  # customers handled at once inside a task
# fixed values: scenarios as (name, cumulative churn, seed offset) and the seed step per replication
SCENARIOS = (("baseline", 0.20, 0), ("hidden_degradation", 0.40, 1000))
SEED_STEP = 37


@dataclass(frozen=True)
class Run:
    scenario: str
    replication: int
    seed: int
    churn: float


def plan_runs(n: int, base_seed: int = 100, scenarios=SCENARIOS) -> list[Run]:
    return [Run(name, rep, base_seed + rep * SEED_STEP + offset, churn)
            for name, churn, offset in scenarios for rep in range(1, n + 1)]


# ------------------------------------------------------------------ assignment by thresholds

def _assignment_hash(seed):
    return F.pmod(F.xxhash64(F.col("customer_id"), seed), F.lit(1 << HASH_BITS))


def assignment_cuts(customers: DataFrame, runs: Sequence[Run], settings: Settings = DEFAULTS) -> dict[tuple[int, int], tuple[int, int]]:
    """(run, quintile) -> (hash, id) of the last treated customer, so that exactly round(n * share) are treated.

    The customer at that rank of the hash order is found by radix selection. The result has one row per run and quintile.
    """
    seeds = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(r.seed).alias("seed")) for i, r in enumerate(runs)])
    drawn = (customers.select("customer_id", "spend_quintile", F.explode(seeds).alias("s"))
             .select("customer_id", "spend_quintile", F.col("s.run").alias("run"), _assignment_hash(F.col("s.seed")).alias("h")))
    quotas = customers.groupBy("spend_quintile").agg(F.rint(F.count(F.lit(1)) * F.lit(settings.treatment_share)).cast("bigint").alias("rank")).where("rank > 0")
    wanted = quotas.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1))))
    rows = rows_at_ranks(drawn, ["run", "spend_quintile"], "h", HASH_BITS, ["customer_id"], wanted).collect()
    return {(r["run"], r["spend_quintile"]): (r["h"], r["customer_id"]) for r in rows}


def _treated_flags(runs: Sequence[Run], cuts: dict) -> "F.Column":
    flags = []
    q = F.col("spend_quintile")
    for i, r in enumerate(runs):
        h = _assignment_hash(F.lit(r.seed))
        flag = F.lit(False)
        for quintile in range(1, 6):
            at = cuts.get((i, quintile))
            if at:
                flag = F.when(q == quintile, (h < at[0]) | ((h == at[0]) & (F.col("customer_id") <= at[1]))).otherwise(flag)
        flags.append(flag)
    return F.array(*flags)


# ------------------------------------------------------------------ block kernels

def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(ids: np.ndarray, slots: np.ndarray, seed: int) -> np.ndarray:
    """Uniform draws keyed by (customer, slot, seed): the same in every task and on every retry."""
    with np.errstate(over="ignore"):
        key = _mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None]
        x = _mix(key + (slots.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(0xD1B54A32D192ED03))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


@dataclass(frozen=True)
class Design:
    weeks: int          # calendar length
    post: int           # post weeks, the last ones of the calendar
    limit: float        # winsor limit
    order_rate_change: float
    aov_change: float
    window: int


def _dense(pdf: pd.DataFrame, design: Design) -> tuple[np.ndarray, np.ndarray]:
    orders = np.zeros((len(pdf), design.weeks))
    spend = np.zeros((len(pdf), design.weeks))
    for i, (w, o, s) in enumerate(zip(pdf["w"], pdf["o"], pdf["s"])):
        at = np.asarray(w, dtype=int)
        orders[i, at] = o
        spend[i, at] = s
    return orders, spend


def _rolling_active(orders: np.ndarray, window: int) -> np.ndarray:
    total = np.cumsum(orders, axis=1)
    total[:, window:] -= total[:, :-window].copy()
    return (total > 0).astype(float)


def _effects(ids, rate, median, q5, orders, spend, run: Run, design: Design) -> np.ndarray:
    """Realized effects of treated customers in the post weeks: (outcome, customer, post week)."""
    k = design.post
    cf_o, cf_s = orders[:, -k:], spend[:, -k:]
    draws = _uniform(ids, np.arange(k), run.seed)
    prob = np.clip(rate * design.order_rate_change, 0.0, 1.0)[:, None]
    empty = cf_o == 0
    added = empty & (draws < prob)
    obs_o = np.where(added, 1.0, cf_o)
    obs_s = np.where(added, (median * (1.0 + design.aov_change))[:, None], cf_s * (1.0 + design.aov_change))
    obs_s = np.where(empty & ~added, 0.0, obs_s)
    hazard = 1.0 - (1.0 - run.churn) ** (1.0 / max(1, k))
    u = _uniform(ids, np.array([k + 1]), run.seed)[:, 0]
    step = np.maximum(1.0, np.ceil(np.log1p(-u) / np.log1p(-hazard)))
    churned = q5[:, None] & (np.arange(1, k + 1)[None, :] > step[:, None])
    obs_o, obs_s = np.where(churned, 0.0, obs_o), np.where(churned, 0.0, obs_s)
    lead = min(design.window - 1, orders.shape[1] - k)
    before = orders[:, orders.shape[1] - k - lead:orders.shape[1] - k]
    act_o = _rolling_active(np.hstack([before, obs_o]), design.window)[:, lead:]
    act_c = _rolling_active(np.hstack([before, cf_o]), design.window)[:, lead:]
    win = np.clip(obs_s, 0.0, design.limit) - np.clip(cf_s, 0.0, design.limit)
    return np.stack([obs_o - cf_o, win, act_o - act_c])


def _blocks(batches, design: Design):
    for pdf in batches:
        for start in range(0, len(pdf), BLOCK):
            part = pdf.iloc[start:start + BLOCK]
            orders, spend = _dense(part, design)
            yield (part["customer_id"].to_numpy(np.int64), part["f"].to_numpy(int), part["q"].to_numpy(int),
                   part["median_order_val"].to_numpy(float), part["pre_order_rate"].to_numpy(float),
                   np.stack(part["treated"].to_numpy()).astype(bool), orders, spend)


def _base_outcomes(orders, spend, design: Design) -> np.ndarray:
    return np.stack([orders, np.clip(spend, 0.0, design.limit), _rolling_active(orders, design.window)])


def _first_pass(runs: Sequence[Run], design: Design):
    """Per task: sums of base outcomes and effects by quintile, week and first week."""
    def fold(batches):
        n_out, w, k = len(OUTCOMES), design.weeks, design.post
        base = {}   # quintile -> (count by f, week sums, total by f)
        eff = {}    # (run, quintile) -> (treated by f, effect by post week, effect total by f)
        for ids, f, q, median, rate, treated, orders, spend in _blocks(batches, design):
            y = _base_outcomes(orders, spend, design)
            for quintile in np.unique(q):
                m = q == quintile
                acc = base.setdefault(int(quintile), np.zeros((1 + 2 * n_out, w)))
                acc[0] += np.bincount(f[m], minlength=w)
                acc[1:1 + n_out] += y[:, m].sum(axis=1)
                for o in range(n_out):
                    acc[1 + n_out + o] += np.bincount(f[m], weights=y[o, m].sum(axis=1), minlength=w)
            for i, run in enumerate(runs):
                t = treated[:, i]
                if not t.any():
                    continue
                e = _effects(ids[t], rate[t], median[t], q[t] == 5, orders[t], spend[t], run, design)
                ft, qt = f[t], q[t]
                for quintile in np.unique(qt):
                    m = qt == quintile
                    acc = eff.setdefault((i, int(quintile)), np.zeros((1 + 2 * n_out, w)))
                    acc[0] += np.bincount(ft[m], minlength=w)
                    acc[1:1 + n_out, w - k:] += e[:, m].sum(axis=1)
                    for o in range(n_out):
                        acc[1 + n_out + o] += np.bincount(ft[m], weights=e[o, m].sum(axis=1), minlength=w)
        rows = [(-1, quintile, r, v.tolist()) for quintile, a in base.items() for r, v in enumerate(a)]
        rows += [(i, quintile, r, v.tolist()) for (i, quintile), a in eff.items() for r, v in enumerate(a)]
        yield pd.DataFrame(rows, columns=["run", "q", "part", "sums"])
    return fold


def _second_pass(runs: Sequence[Run], design: Design, effects: dict):
    """Per task: cluster sums A = sum d~y~ and B = sum d~^2 by run, cohort and outcome."""
    members = [np.array(m) for _, _, m in COHORTS]

    def fold(batches):
        n_out, w, k = len(OUTCOMES), design.weeks, design.post
        acc = np.zeros((len(runs), len(COHORTS), n_out, 5))
        n_f = (w - np.arange(w)).astype(float)
        for ids, f, q, median, rate, treated, orders, spend in _blocks(batches, design):
            y = _base_outcomes(orders, spend, design)
            flat = y.reshape(n_out * len(ids), w)
            total, post = y.sum(axis=2), y[:, :, w - k:].sum(axis=2)
            share = k / n_f[f]
            for i, run in enumerate(runs):
                t = treated[:, i]
                tot_i, post_i = total.copy(), post.copy()
                e = None
                if t.any():
                    e = _effects(ids[t], rate[t], median[t], q[t] == 5, orders[t], spend[t], run, design)
                    tot_i[:, t] += e.sum(axis=2)
                    post_i[:, t] += e.sum(axis=2)
                for c, group in enumerate(members):
                    gd, gy = effects[(i, c)]
                    mine = np.isin(q, group)
                    if not mine.any():
                        continue
                    mean_d = np.cumsum(gd[::-1])[::-1] / n_f  # mean of gd over the weeks from f on
                    dot = (flat @ gd).reshape(n_out, len(ids))
                    if e is not None:
                        dot[:, t] += e @ gd[w - k:]
                    tr = t.astype(float)
                    # sum over weeks of d~ times the week effects of y, and of d~^2, by (treated, f)
                    tail = lambda v: np.cumsum(v[::-1])[::-1]
                    sum_dd = tail(gd * gd) - n_f * mean_d ** 2
                    p_gd, s_gd = gd[w - k:].sum(), tail(gd)
                    b0 = sum_dd
                    b1 = k - k * k / n_f - 2.0 * (p_gd - k / n_f * s_gd) + sum_dd
                    b_i = np.where(t, b1[f], b0[f])
                    for o in range(n_out):
                        g = gy[o]
                        s_g, p_g = tail(g), g[w - k:].sum()
                        own = -(tail(gd * g) - mean_d * s_g)
                        week_part = tr * (p_g - share * s_g[f]) + own[f]
                        a_i = tr * (post_i[o] - share * tot_i[o]) - dot[o] + mean_d[f] * tot_i[o] - week_part
                        a, b = a_i[mine], b_i[mine]
                        acc[i, c, o] += (a.sum(), (a * a).sum(), (a * b).sum(), b.sum(), (b * b).sum())
        yield pd.DataFrame([(i, c, o, *map(float, acc[i, c, o])) for i in range(len(runs)) for c in range(len(COHORTS))
                            for o in range(n_out)], columns=["run", "c", "o", "A", "AA", "AB", "B", "BB"])
    return fold


def _solve_week_effects(sums: dict, n_runs: int, design: Design) -> tuple[dict, dict, dict]:
    """Week effects of treatment and outcomes per (run, cohort), true effects, and sizes; weeks-sized algebra only."""
    n_out, w, k = len(OUTCOMES), design.weeks, design.post
    n_f = (w - np.arange(w)).astype(float)
    zero = np.zeros((1 + 2 * n_out, w))
    effects, truth, sizes = {}, {}, {}
    post = np.zeros(w)
    post[w - k:] = 1.0
    for c, (_, _, members) in enumerate(COHORTS):
        base = sum((sums.get((-1, q), zero) for q in members), zero)
        count = base[0]
        present = np.cumsum(count)
        used = np.flatnonzero(present > 0)
        # sum over f <= min(u, v) of N_f / n_f
        share = np.cumsum(count / n_f)
        system = np.diag(present) - share[np.minimum.outer(np.arange(w), np.arange(w))]
        inverse = np.linalg.pinv(system[np.ix_(used, used)], hermitian=True)
        sizes[c] = (float((count * n_f).sum()), float(count.sum()), float(len(used)))
        for i in range(n_runs):
            eff = sum((sums.get((i, q), zero) for q in members), zero)
            treated = eff[0]
            rhs = np.zeros((1 + n_out, w))
            rhs[0] = post * treated.sum() - np.cumsum(treated * k / n_f)
            for o in range(n_out):
                rhs[1 + o] = base[1 + o] + eff[1 + o] - np.cumsum((base[1 + n_out + o] + eff[1 + n_out + o]) / n_f)
            sol = np.zeros((1 + n_out, w))
            sol[:, used] = rhs[:, used] @ inverse
            effects[(i, c)] = (sol[0], sol[1:])
            rows = treated.sum() * k
            truth[(i, c)] = [float(eff[1 + o].sum() / rows) if rows else float("nan") for o in range(n_out)]
    return effects, truth, sizes


def replications(customers: DataFrame, weekly: DataFrame, t0: str, n_replications: int = 50, base_seed: int = 100,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """One row per scenario, replication, cohort and outcome: truth, estimate, SE, error, coverage, rejection."""
    spark = customers.sparkSession
    runs = plan_runs(n_replications, base_seed)
    bounds = customers.agg(F.min("first_week").alias("lo")).first()  # one row
    end = last_week(weekly, t0).first()["last_week"]
    limit = float(winsor_limit(weekly, customers, settings).first()["limit"])
    weeks = (end - bounds["lo"]).days // 7 + 1
    post = max(0, (end - monday_on_or_after(t0)).days // 7 + 1)
    design = Design(weeks, post, limit, settings.order_rate_change, settings.aov_change, settings.active_window_weeks)
    first = F.lit(bounds["lo"])
    cuts = assignment_cuts(customers, runs, settings)
    entries = (weekly.withColumn("w", F.floor(F.date_diff("week_date", first) / 7).cast("int"))
               .groupBy("customer_id").agg(F.collect_list(F.struct("w", "cf_orders", "cf_spend")).alias("e")))
    blocks = stored(customers.join(entries, "customer_id").select(
        "customer_id", F.floor(F.date_diff("first_week", first) / 7).cast("int").alias("f"),
        F.col("spend_quintile").alias("q"), "median_order_val", "pre_order_rate", _treated_flags(runs, cuts).alias("treated"),
        F.col("e.w").alias("w"), F.transform("e.cf_orders", lambda v: v.cast("double")).alias("o"), F.col("e.cf_spend").alias("s")),
        "replication-blocks")
    partial = blocks.mapInPandas(_first_pass(runs, design), "run int, q int, part int, sums array<double>")
    merged = (partial.select("run", "q", "part", F.posexplode("sums").alias("week", "x"))
              .groupBy("run", "q", "part", "week").agg(F.sum("x").alias("x")).where(F.col("x") != 0).collect())
    sums: dict[tuple[int, int], np.ndarray] = {}
    for r in merged:
        sums.setdefault((r["run"], r["q"]), np.zeros((1 + 2 * len(OUTCOMES), weeks)))[r["part"], r["week"]] = r["x"]
    effects, truth, sizes = _solve_week_effects(sums, len(runs), design)
    clusters = (blocks.mapInPandas(_second_pass(runs, design, effects),
                                   "run int, c int, o int, A double, AA double, AB double, B double, BB double")
                .groupBy("run", "c", "o").agg(*[F.sum(x).alias(x) for x in ("A", "AA", "AB", "B", "BB")]))
    labels = spark.createDataFrame(
        [(i, c, o, r.scenario, r.replication, COHORTS[c][1], OUTCOMES[o][0], truth[(i, c)][o], *map(int, sizes[c]))
         for i, r in enumerate(runs) for c in range(len(COHORTS)) for o in range(len(OUTCOMES))],
        "run int, c int, o int, scenario string, replication int, cohort string, outcome string, true_att double, "
        "n_obs long, n_customers long, W long")
    flat = clusters.join(labels, ["run", "c", "o"]).withColumn("raw", F.lit(0.0))
    keys = ["scenario", "replication", "cohort", "true_att"]
    est = finish_estimates(flat, keys, "cr1")
    err = F.col("estimated_att") - F.col("true_att")
    covered = (F.col("ci_lower") <= F.col("true_att")) & (F.col("true_att") <= F.col("ci_upper"))
    return est.select(
        "scenario", "replication", "cohort", "outcome", "true_att", "estimated_att", F.col("std_err").alias("standard_error"),
        err.alias("error"), (err * err).alias("sq_error"), F.coalesce(covered, F.lit(False)).cast("int").alias("ci_covered"),
        F.coalesce(F.col("p_value") < 0.05, F.lit(False)).cast("int").alias("rejected_at_5pct"))


def replication_summary(reps: DataFrame) -> DataFrame:
    return reps.groupBy(F.col("scenario").alias("Scenario"), F.col("cohort").alias("Cohort"), F.col("outcome").alias("Outcome")).agg(
        F.count(F.lit(1)).alias("Replications"), F.avg("true_att").alias("Mean_True_ATT"),
        F.avg("estimated_att").alias("Mean_Estimated_ATT"), F.avg("error").alias("Mean_Bias"),
        F.sqrt(F.avg("sq_error")).alias("RMSE"), F.avg("standard_error").alias("Mean_SE"),
        F.avg("ci_covered").alias("Coverage_95pct"), F.avg("rejected_at_5pct").alias("Rejection_Rate_5pct"))


def side_by_side(results: DataFrame, summary: DataFrame, model: str) -> DataFrame:
    """Truth, estimate, interval and simulated coverage per scenario, cohort and outcome."""
    est = results.where(F.col("Estimator_Model") == model).select(
        "scenario", F.col("Cohort").alias("cohort"), F.col("Outcome_Metric").alias("outcome"), F.col("True_ATT").alias("true_att"),
        F.col("Estimated_ATT").alias("estimated_att"), "ci_lower", "ci_upper")
    cov = summary.select(F.col("Scenario").alias("scenario"), F.col("Cohort").alias("cohort"), F.col("Outcome").alias("outcome"),
                         F.col("Coverage_95pct").alias("mc_coverage"))
    return est.join(cov, ["scenario", "cohort", "outcome"], "left")
