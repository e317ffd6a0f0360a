"""Two-way fixed effects difference-in-differences by exact elimination of customer and week effects.

No iteration over the panel and no dummy matrix: week effects solve a (weeks x weeks) system whose
entries are counts, built from aggregates; customer effects drop out through within-customer sums.
The systems are sums over customers, so those of pooled cohorts are sums over their groups: the panel is never copied
per cohort. Each system is solved in a task of its own from one row per week and one per distinct (first week, last week) span; nothing but
the results reaches the driver, and there is no limit on weeks, groups or customers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyfield.functions.durable import stored
from tallyfield.functions.ordering import with_row_number
from tallyfield.functions.numeric import decile_label, qcut_bin
from tallyfield.operators.panel import COHORTS

Z95 = 1.95996  # fixed value: normal quantile used for the 95% interval
TINY = 1e-12   # fixed value: treatment variation at or below this counts as none
ROUNDOFF = 1e-10  # and so does variation lost in the rounding of the sums it comes from


def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v is not None and v == v else np.nan)


def normal_p_value(z: Column) -> Column:
    """Two-sided normal p-value; applied to result rows only."""
    udf = F.pandas_udf(_two_sided, T.DoubleType())
    return F.nanvl(udf(z), F.lit(None).cast("double"))


BATCH_CELLS = 1 << 22  # customers times weeks that a task holds as one matrix


def _gap_products(indexed: DataFrame, keys: list[str], customer: str, values: list[str]) -> DataFrame:
    """Presence cross products for customers with missing weeks, summed: (keys, i, at, x) with columns weeks, then values behind -1, -2, ..."""
    per = indexed.groupBy(*keys, customer).agg(F.sort_array(F.collect_list("__i")).alias("weeks"), *[F.avg(v).alias(v) for v in values])

    def fold(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            top = 1 + max(int(ws[-1]) for ws in pdf["weeks"]) if len(pdf) else 0
            for key, part in (pdf.groupby(keys, sort=False) if keys else [((), pdf)]):
                key = key if isinstance(key, tuple) else (key,)
                for lo in range(0, len(part), max(1, BATCH_CELLS // max(top, 1))):
                    piece = part.iloc[lo:lo + max(1, BATCH_CELLS // max(top, 1))]
                    sizes = piece["weeks"].map(len).to_numpy()
                    present = np.zeros((len(piece), top))
                    present[np.repeat(np.arange(len(piece)), sizes), np.concatenate(piece["weeks"].to_list()).astype(int)] = 1.0
                    block = np.hstack([present.T @ piece[values].to_numpy(float), present.T @ (present / sizes[:, None])])
                    old = acc.get(key)
                    if old is not None:  # tasks may see later weeks later
                        big, small = (block, old) if block.shape[0] >= old.shape[0] else (old, block)
                        big[:small.shape[0], :small.shape[1]] += small
                        block = big
                    acc[key] = block
        for key, block in acc.items():
            for w, row in enumerate(block):
                at = np.flatnonzero(row)
                if at.size:
                    yield pd.DataFrame([(*key, w, (at - len(values)).tolist(), row[at].tolist())], columns=[*keys, "i", "at", "x"])

    schema = T.StructType([*[per.schema[k] for k in keys], T.StructField("i", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    partial = per.mapInPandas(fold, schema).select(*keys, "i", F.explode(F.arrays_zip("at", "x")).alias("e"))
    summed = partial.groupBy(*keys, "i", F.col("e.at").alias("at")).agg(F.sum("e.x").alias("x"))
    return summed.groupBy(*keys, "i").agg(F.collect_list("at").alias("at"), F.collect_list("x").alias("x"))


def solve_weeks(rows: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weeks that occur and their effects (one column per value), from rows (kind, i, j, at, x) of one system.

    kind 0: week i with [count, sums]; 1: customers present from week i to j with [number, sums of their means]; 2: presence products of week i.
    """
    weeks = 1 + int(max(rows["i"].max(), rows["j"].max(skipna=True) if rows["j"].notna().any() else 0))
    count, rhs = np.zeros(weeks), np.zeros((weeks + 1, k))
    for kind, part in rows.groupby("kind"):
        if kind < 2:
            i = part["i"].to_numpy(int)
            x = np.array(part["x"].to_list(), dtype=float)
        if kind == 0:
            np.add.at(count, i, x[:, 0])
            np.add.at(rhs, i, x[:, 1:])
    # blocks of ones from lo to hi are differences at their four corners
    corners, slope = np.zeros((weeks + 1, weeks + 1)), np.zeros((weeks + 1, k))
    spans = rows[rows["kind"] == 1]
    if len(spans):
        lo, hi = spans["i"].to_numpy(int), spans["j"].to_numpy(int) + 1
        x = np.array(spans["x"].to_list(), dtype=float)
        share = x[:, 0] / (hi - lo)
        for a, b, sign in ((lo, lo, 1), (lo, hi, -1), (hi, lo, -1), (hi, hi, 1)):
            np.add.at(corners, (a, b), sign * share)
        np.add.at(slope, lo, x[:, 1:])
        np.add.at(slope, hi, -x[:, 1:])
        np.cumsum(corners, axis=0, out=corners)
        np.cumsum(corners, axis=1, out=corners)
        rhs -= np.cumsum(slope, axis=0)
    system, rhs = corners[:weeks, :weeks], rhs[:weeks]
    for i, at, x in zip(*(rows.loc[rows["kind"] == 2, c] for c in ("i", "at", "x"))):
        at, x = np.asarray(at), np.asarray(x)
        system[i, at[at >= 0]] += x[at >= 0]
        rhs[i, k + at[at < 0]] -= x[at < 0]
    used = np.flatnonzero(count)
    system, rhs = system[np.ix_(used, used)], rhs[used]
    # weeks that share no customer are apart; in each connected part a common shift is absorbed by the customers
    joined = system > ROUNDOFF * max(1.0, float(count.max()) if used.size else 1.0) / max(used.size, 1)
    np.negative(system, out=system)
    system[np.arange(used.size), np.arange(used.size)] += count[used]
    free = np.ones(used.size, dtype=bool)
    while free.any():
        part = new = np.flatnonzero(free)[:1]
        free[new] = False
        while new.size:
            new = np.flatnonzero(joined[new].any(axis=0) & free)
            free[new] = False
            part = np.r_[part, new]
        system[np.ix_(part, part)] += count[used[part]].mean() / part.size
    return used, np.linalg.solve(system, rhs)


def _pool_column(key: str, pools: Mapping[str, Sequence]) -> Column:
    """Names of the pools that a group belongs to, in order."""
    flags = [F.when(F.col(key).isin(*members), F.lit(name)) for name, members in sorted(pools.items())]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def week_effects(panel: DataFrame, values: Sequence[str], groups: Sequence[str] = (), customer: str = "customer_id", time: str = "week_date",
                 pools: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Week effects of each value after removing customer means: (groups or pool, time, __g_<value>, __W), one row per system and week, stored.

    pools: name -> values of the one group column; a system then is that of a pool, the sum of those of its groups.
    """
    keys, values = list(groups), list(values)
    k = len(values)
    narrow = panel.select(*keys, customer, time, *[F.col(v).cast("double").alias(v) for v in values])
    cells = stored(narrow.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values]), "week-cells")
    calendar = stored(cells.select(time).distinct().withColumn("__i", F.row_number().over(Window.orderBy(time)) - 1), "calendar")  # one row per week
    ends = narrow.groupBy(*keys, customer).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"), *[F.avg(v).alias(v) for v in values])
    for c in ("lo", "hi"):
        ends = ends.join(calendar.select(F.col(time).alias(c), F.col("__i").alias(f"{c}_i")), c)
    ends = stored(ends.withColumn("gap", F.col("n") < F.col("hi_i") - F.col("lo_i") + 1).drop("lo", "hi"), "week-ends")
    none = F.lit(None).cast("array<int>")

    def parts(number: Column) -> Column:
        return F.array(number.cast("double"), *[F.coalesce(v, F.lit(0.0)) for v in values])
    rows = cells.join(calendar, time).select(*keys, F.lit(0).alias("kind"), F.col("__i").alias("i"), F.lit(None).cast("int").alias("j"), none.alias("at"), parts(F.col("n")).alias("x"))
    spans = ends.where(~F.col("gap")).groupBy(*keys, "lo_i", "hi_i").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values])
    rows = rows.union(spans.select(*keys, F.lit(1), "lo_i", "hi_i", none, parts(F.col("n"))))
    held = ends.where("gap").select(*keys, customer)
    if not held.isEmpty():
        same = [narrow[c].eqNullSafe(held[c]) for c in (*keys, customer)]
        apart = _gap_products(narrow.join(held, same, "left_semi").join(calendar, time), keys, customer, values)
        rows = rows.union(apart.select(*keys, F.lit(2), "i", F.lit(None).cast("int"), "at", "x"))
    names = keys
    if pools is not None:
        names = ["pool"]
        rows = rows.withColumn("pool", F.explode(_pool_column(keys[0], pools))).drop(*keys)
    fields = [rows.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("__i", T.IntegerType()), *[T.StructField(f"__g_{v}", T.DoubleType()) for v in values], T.StructField("__W", T.IntegerType())])

    def solved(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        used, effect = solve_weeks(part, k)
        out = pd.DataFrame(effect, columns=[f"__g_{v}" for v in values])
        out.insert(0, "__i", used.astype("int32"))
        for c, value in reversed(list(zip(names, key))):
            out.insert(0, c, value)
        return out.assign(__W=np.int32(used.size))
    # one system per task: weeks x weeks numbers, whatever the number of customers
    effects = rows.groupBy(*names).applyInPandas(solved, schema)
    return stored(effects.join(calendar, "__i").drop("__i"), "week-effects")


def two_way_within(panel: DataFrame, value: str, groups: Sequence[str] = (), customer: str = "customer_id",
                   time: str = "week_date", out: str = "within") -> DataFrame:
    """The value with customer and week effects projected out, row by row."""
    effects = week_effects(panel, [value], groups, customer, time)
    joined = panel.join(effects, [*groups, time])
    w = Window.partitionBy(*groups, customer)  # one customer's calendar
    left = F.col(value).cast("double") - F.col(f"__g_{value}")
    return joined.withColumn("__left", left).withColumn(out, F.col("__left") - F.avg("__left").over(w)) \
        .drop("__left", "__W", f"__g_{value}")


def twfe(panel: DataFrame, outcomes: Sequence[tuple[str, str]], groups: Sequence[str] = (), treatment: str = "is_treated",
         post: str = "is_post_period", customer: str = "customer_id", time: str = "week_date",
         dof: str = "absorbed", pools: Mapping[str, Sequence] | None = None, pool: str = "cohort") -> DataFrame:
    """One row per group (or pool) and outcome: ATT, clustered SE, t, p, 95% interval, sizes, degenerate flag.

    ``outcomes``: (label, column). ``dof``: 'absorbed' scales by n / (n - G - W), 'cr1' by
    G / (G - 1) * (n - 1) / (n - G - W). ``pools``: name -> values of the one group column, which may overlap; results then have the column
    ``pool`` instead. All outcomes, groups and pools share the passes; a customer's row is widened by the pools of its group, never copied.
    """
    keys = list(groups)
    names = [f"__y{i}" for i in range(len(outcomes))]
    base = panel.select(*keys, customer, time, (F.col(treatment) * F.col(post)).cast("double").alias("__d"),
                        *[F.col(c).cast("double").alias(n) for n, (_, c) in zip(names, outcomes)])
    effects = week_effects(base, ["__d", *names], keys, customer, time, pools)
    slot = F.struct(*([F.col("pool")] if pools is not None else []), F.col("__W").alias("W"), *[F.col(f"__g_{v}").alias(v) for v in ("__d", *names)])
    slots = 1
    if pools is None:
        slotted = effects.select(*keys, time, F.array(slot).alias("__e"))
    else:
        members = sorted({m for v in pools.values() for m in v})
        slots = max(sum(m in v for v in pools.values()) for m in members)
        of_group = panel.select(keys[0]).limit(0).select(keys[0])  # the group column's type
        named = panel.sparkSession.createDataFrame([(m, name) for name, v in pools.items() for m in v], T.StructType(
            [T.StructField(keys[0], of_group.schema[0].dataType), T.StructField("pool", T.StringType())]))  # one row per group and pool
        slotted = stored(effects.join(named, "pool").groupBy(*keys, time).agg(F.sort_array(F.collect_list(slot)).alias("__e")), "week-slots")
    left = base.join(slotted, [*keys, time])

    def shifted(i: int, v: str) -> Column:
        return F.col(v) - F.col("__e")[i][v]
    sums = []
    for i in range(slots):
        a = shifted(i, "__d")
        sums += [F.sum(a).alias(f"a{i}"), F.sum(a * a).alias(f"aa{i}"), F.max(F.col("__e")[i]["W"]).alias(f"W{i}")]
        sums += [x for n in names for x in (F.sum(shifted(i, n)).alias(f"{n}_{i}"), F.sum(a * shifted(i, n)).alias(f"{n}a{i}"))]
    per = left.groupBy(*keys, customer).agg(F.count(F.lit(1)).alias("n"), *sums)
    n = F.col("n")
    row = F.explode(F.array(*[F.struct(
        F.lit(i).alias("slot"), F.col(f"W{i}").alias("W"), F.col(f"aa{i}").alias("aa"), (F.col(f"aa{i}") - F.col(f"a{i}") * F.col(f"a{i}") / n).alias("B"),
        *[(F.col(f"{y}a{i}") - F.col(f"a{i}") * F.col(f"{y}_{i}") / n).alias(f"{y}A") for y in names]) for i in range(slots)]))
    if pools is not None:
        per = per.withColumn("__pools", _pool_column(keys[0], pools))
    per = per.select(*keys, "n", *(["__pools"] if pools is not None else []), row.alias("r")).select("*", "r.*").where("W is not null")
    by = keys
    if pools is not None:
        by = [pool]
        per = per.withColumn(pool, F.col("__pools")[F.col("slot")])  # slots are sorted by name, as the pools are
    total = per.groupBy(*by).agg(
        F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_customers"), F.max("W").cast("bigint").alias("W"),
        F.sum("B").alias("B"), F.sum(F.col("B") * F.col("B")).alias("BB"), F.sum("aa").alias("raw"),
        *[F.sum(f"{y}A").alias(f"{y}A") for y in names],
        *[F.sum(F.col(f"{y}A") * F.col(f"{y}A")).alias(f"{y}AA") for y in names],
        *[F.sum(F.col(f"{y}A") * F.col("B")).alias(f"{y}AB") for y in names])
    rows = F.explode(F.array(*[
        F.struct(F.lit(label).alias("outcome"), F.col(f"{y}A").alias("A"), F.col(f"{y}AA").alias("AA"),
                 F.col(f"{y}AB").alias("AB")) for y, (label, _) in zip(names, outcomes)]))
    flat = total.select(*by, "n_obs", "n_customers", "W", "B", "BB", "raw", rows.alias("r")).select("*", "r.*").drop("r")
    return finish_estimates(flat, by, dof)


def twfe_by_cohort(panel: DataFrame, outcomes: Sequence[tuple[str, str]], dof: str = "absorbed", quintile: str = "spend_quintile") -> DataFrame:
    """``twfe`` for the cohorts of spend quintiles: overall, and Q1-Q4 or Q5."""
    return twfe(panel, outcomes, [quintile], dof=dof, pools={key: members for key, _, members in COHORTS})


def finish_estimates(flat: DataFrame, keys: Sequence[str], dof: str = "absorbed") -> DataFrame:
    """ATT, SE and inference from the cluster sums A = sum d~y~ and B = sum d~^2 of each result row."""
    tau = F.col("A") / F.col("B")
    meat = F.greatest(F.lit(0.0), F.col("AA") - F.lit(2.0) * tau * F.col("AB") + tau * tau * F.col("BB"))
    n, g, w = (F.col(c).cast("double") for c in ("n_obs", "n_customers", "W"))
    if dof == "cr1":
        scale = g / F.nullif(g - 1, F.lit(0.0)) * (n - 1) / F.nullif(n - g - w, F.lit(0.0))
    else:
        scale = n / F.greatest(F.lit(1.0), n - (g + w - 1) - 1)
    ok = F.col("B") > F.greatest(F.lit(TINY), F.lit(ROUNDOFF) * F.col("raw"))
    out = flat.select(
        *keys, "outcome", "n_obs", "n_customers",
        F.when(ok, tau).alias("estimated_att"),
        F.when(ok, F.sqrt(meat / (F.col("B") * F.col("B")) * scale)).alias("std_err"),
        (~F.coalesce(ok, F.lit(False))).alias("degenerate"))
    att, se = F.col("estimated_att"), F.col("std_err")
    t = F.when(se > 0, att / se).when(se.isNotNull(), F.lit(0.0))
    return (out.withColumn("t_stat", t).withColumn("p_value", normal_p_value(F.col("t_stat")))
            .withColumn("ci_lower", att - F.lit(Z95) * se).withColumn("ci_upper", att + F.lit(Z95) * se))


def placebo_date(panel: DataFrame, t0: str, outcome: str, treatment: str = "is_treated", time: str = "week_date",
                 customer: str = "customer_id") -> DataFrame:
    """TWFE on the weeks before t0 with the policy moved to the middle of that window."""
    pre = panel.where(F.col(time) < F.lit(t0).cast("date"))
    span = pre.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    moved = pre.withColumn("__placebo_post", (
        F.date_diff(F.col(time), span.getField("lo")) * 2
        >= F.date_diff(span.getField("hi"), span.getField("lo"))).cast("int"))
    est = twfe(moved, [(outcome, outcome)], (), treatment, "__placebo_post", customer, time)
    att, p = F.coalesce("estimated_att", F.lit(0.0)), F.coalesce("p_value", F.lit(1.0))
    return est.select("outcome", att.alias("placebo_att"), F.coalesce("std_err", F.lit(0.0)).alias("std_err"),
                      p.alias("p_value"), ((p > 0.05) | (F.abs(att) < 0.5)).alias("test_passed"))


def pre_spend_deciles(panel: DataFrame, spend: str = "observed_weekly_spend", customer: str = "customer_id") -> DataFrame:
    """Customer deciles D01..D10 by observed spend before the policy."""
    per = panel.where(F.col("is_post_period") == 0).groupBy(customer).agg(F.sum(spend).alias("pre_spend"))
    # spend is re-rounded so that equal totals tie whatever order they were added in
    ranked = with_row_number(per.withColumn("pre_spend", F.round("pre_spend", 4)), ["pre_spend", customer], out="__rn")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.select(customer, decile_label(qcut_bin("__rn", n, 10)).alias("decile"))


def heterogeneity(panel: DataFrame, min_treated: int = 10, outcome: str = "observed_weekly_spend_winsor",
                  effect: str = "realized_effect_spend_winsor", customer: str = "customer_id",
                  time: str = "week_date", beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per decile: sizes, true ATT, DiD estimate, SE, raw and Bonferroni p, degenerate flag.

    beside: gives the panel with columns per customer, where there is a cheaper way than a join with the panel.
    """
    deciles = pre_spend_deciles(panel, customer=customer)
    columns = [customer, time, "is_treated", "is_post_period", outcome, effect]
    joined = panel.select(*columns).join(deciles, customer, "left") if beside is None else beside(deciles).select(*columns, "decile")
    marked = (joined
              .withColumn("decile", F.coalesce("decile", F.lit("D01"))))
    hit = (F.col("is_treated") == 1) & (F.col("is_post_period") == 1)
    per = marked.groupBy("decile", customer).agg(
        F.max("is_treated").alias("t"), F.sum(F.when(hit, F.col(effect))).alias("e"), F.count(F.when(hit, 1)).alias("k"))
    sizes = per.groupBy("decile").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("t").cast("bigint").alias("treated_count"),
        F.coalesce(F.sum("e") / F.nullif(F.sum("k"), F.lit(0)), F.lit(0.0)).alias("true_att"))
    est = twfe(marked, [(outcome, outcome)], ["decile"], customer=customer, time=time).select(
        "decile", "estimated_att", "std_err", "p_value", F.col("degenerate").alias("__flat"))
    usable = (F.col("treated_count") >= min_treated) & (F.col("treated_count") < F.col("customer_count")) & ~F.col("__flat")
    p = F.when(usable, F.col("p_value"))
    return sizes.join(est, "decile").select(
        "decile", "customer_count", "treated_count", "true_att", F.when(usable, F.col("estimated_att")).alias("estimated_did_att"),
        F.when(usable, F.col("std_err")).alias("std_err"), p.alias("p_value"),
        F.least(F.lit(1.0), p * F.lit(10.0)).alias("p_value_bonferroni"), (~usable).alias("degenerate"))
