"""Maximum likelihood for the purchase and order-value models.

Customers are compressed to distinct sufficient tuples with one weight per *problem*: a cutoff, a
penalty or a bootstrap replicate. One Spark aggregation returns value, gradient and Hessian of every problem
that is still open, from closed-form derivatives in the logarithms of the parameters; the driver only
updates 3 or 4 numbers per problem. Cutoffs and penalties move together. Resamples start at the point fit,
with the step that the influence of their weights on its score gives, and leave the passes once they
have converged. Spark SQL has no log-gamma, hence the numpy kernels in the tasks; each task
returns a few partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyfield.config import DEFAULTS, Settings
from tallyfield.functions.special import digamma, lgamma, lrising, rising_derivatives, trigamma
from tallyfield.operators.rfm import monetary_column
from tallyfield.operators.scoring import BetaGeometric, GammaGamma, ParetoNbd, dropout_nodes

STEP = 3.0     # longest step in any log-parameter: the trust region
AHEAD = 4.0    # Newton steps that a trial on a slope looks ahead
SCORE = 1e-5    # slope of the mean log-likelihood in any log-parameter that a finished fit may have
UPWARDS = 1e-10  # negative curvature beyond the rounding of the sums
FLAT = 1e-7    # curvature of the mean log-likelihood below which a direction counts as not identified by the data


@dataclass(frozen=True)
class Fit:
    """A fit and its certificate: ``score`` is the largest slope of the mean log-likelihood in a log-parameter, ``gain`` what the Newton step left
    promises, ``curvature`` the least eigenvalue of the negative Hessian. ``identified`` is False where the likelihood is flat in a
    direction, as at its limits for parameters that run to 0 or infinity."""
    params: dict[str, float]
    log_likelihood: float  # mean per customer, on scaled time or value
    n: float
    iterations: int
    converged: bool
    score: float = float("nan")
    gain: float = float("nan")
    curvature: float = float("nan")

    @property
    def identified(self) -> bool:
        return bool(self.curvature > FLAT)


# ------------------------------------------------------------------ log-likelihoods with first and second derivatives
#
# A jet is (value, gradient, Hessian) over the rows, shapes (n), (k, n), (k, k, n), in the parameters themselves.

class Jet:
    def __init__(self, k: int, value: np.ndarray):
        self.value = value
        self.g = np.zeros((k, value.size))
        self.h = np.zeros((k, k, value.size))

    def first(self, i: int, d) -> "Jet":
        self.g[i] += d
        return self

    def second(self, i: int, j: int, d) -> "Jet":
        self.h[i, j] += d
        if i != j:
            self.h[j, i] += d
        return self

    def plus(self, other: "Jet") -> "Jet":
        self.value = self.value + other.value
        self.g += other.g
        self.h += other.h
        return self


def _log_sum(one: Jet, two: Jet) -> Jet:
    """log(e^one + e^two)."""
    out = Jet(one.g.shape[0], np.logaddexp(one.value, two.value))
    p = np.exp(one.value - out.value)
    q = 1.0 - p
    gap = one.g - np.where(q > 0, two.g, 0.0)
    out.g = p * one.g + np.where(q > 0, q * two.g, 0.0)
    out.h = p * one.h + np.where(q > 0, q * two.h, 0.0) + (p * q) * gap[:, None] * gap[None, :]
    return out


def _rising(out: Jet, sign: float, params: tuple[int, ...], z: float, k: np.ndarray) -> Jet:
    """Adds sign * log(Gamma(z + k) / Gamma(z)), z being the sum of the parameters named. Orders repeat, so each is worked out once."""
    kinds, at = np.unique(k, return_inverse=True)
    one, two = rising_derivatives(z, kinds)
    out.value = out.value + sign * lrising(z, kinds)[at]
    for i in params:
        out.g[i] += sign * one[at]
        for j in params:
            out.h[i, j] += sign * two[at]
    return out


def _decay(k: int, r, alpha, x, t) -> Jet:
    """log of alpha^r / (alpha + t)^(r + x) in parameters 0 and 1: exact where r and alpha are large and only their ratio matters."""
    late, share = 1.0 / (alpha + t), t / (alpha * (alpha + t))
    out = Jet(k, -r * np.log1p(t / alpha) - x * np.log(alpha + t))
    out.first(0, -np.log1p(t / alpha)).first(1, r * share - x * late)
    return out.second(0, 1, share).second(1, 1, x * late * late - r * share * (1.0 / alpha + late))


def _jet_bg(theta, d) -> Jet:
    r, alpha, a, b = theta
    x, tx, age = d["x"], d["tx"], d["age"]
    left = np.where(x > 0, b + x - 1.0, 1.0)
    gone = _decay(4, r, alpha, x, tx)
    with np.errstate(divide="ignore"):
        gone.value = np.where(x > 0, gone.value + np.log(a) - np.log(left), -np.inf)
    gone.first(2, 1.0 / a).second(2, 2, -1.0 / (a * a)).first(3, np.where(x > 0, -1.0 / left, 0.0)).second(3, 3, np.where(x > 0, 1.0 / (left * left), 0.0))
    out = _log_sum(_decay(4, r, alpha, x, age), gone)
    _rising(out, 1.0, (0,), r, x)
    _rising(out, 1.0, (3,), b, x)
    return _rising(out, -1.0, (2, 3), a + b, x)


def _jet_mbg(theta, d) -> Jet:
    r, alpha, a, b = theta
    x, tx, age = d["x"], d["tx"], d["age"]
    alive, gone = _decay(4, r, alpha, x, age), _decay(4, r, alpha, x, tx)
    # B(a, b + x + 1) against B(a + 1, b + x): a factor b + x or a beside the same gammas
    alive.value = alive.value + np.log(b + x)
    alive.first(3, 1.0 / (b + x)).second(3, 3, -1.0 / (b + x) ** 2)
    gone.value = gone.value + np.log(a)
    gone.first(2, 1.0 / a).second(2, 2, -1.0 / (a * a))
    out = _log_sum(alive, gone)
    _rising(out, 1.0, (0,), r, x)
    _rising(out, 1.0, (3,), b, x)
    return _rising(out, -1.0, (2, 3), a + b, x + 1.0)


def _jet_pareto(theta, d) -> Jet:
    r, alpha, s, beta = theta
    x, tx, age = d["x"], d["tx"], d["age"]
    alive = _decay(4, r, alpha, x, age)
    late = 1.0 / (beta + age)
    alive.value = alive.value - s * np.log1p(age / beta)
    alive.first(2, -np.log1p(age / beta)).first(3, s * age * late / beta).second(2, 3, age * late / beta).second(3, 3, -s * age * late / beta * (1.0 / beta + late))
    # the dropout integral from tx to age; its derivatives are moments under the integrand
    log_y, log_w = dropout_nodes(alpha, r + x + s + 1.0, tx, age)  # log(alpha + y)
    y = np.exp(log_y) - alpha
    other = np.log1p(y / beta)
    terms = log_w + r * np.log(alpha) - (r + x)[:, None] * log_y + np.log(s / beta) - (s + 1.0) * other
    top = terms.max(axis=1, keepdims=True)
    share = np.exp(terms - np.where(np.isfinite(top), top, 0.0))
    total = share.sum(axis=1)
    gone = Jet(4, np.where(total > 0, np.log(np.where(total > 0, total, 1.0)) + top[:, 0], -np.inf))
    share = share / np.where(total > 0, total, 1.0)[:, None]
    near, far = np.exp(-log_y), 1.0 / (beta + y)
    slopes = [np.log(alpha) - log_y, r / alpha - (r + x)[:, None] * near, 1.0 / s - other, s / beta - (s + 1.0) * far]
    curves = {(0, 1): 1.0 / alpha - near, (1, 1): (r + x)[:, None] * near * near - r / (alpha * alpha), (2, 2): np.full_like(near, -1.0 / (s * s)),
              (2, 3): 1.0 / beta - far, (3, 3): (s + 1.0) * far * far - s / (beta * beta)}
    for i in range(4):
        gone.first(i, (share * slopes[i]).sum(axis=1))
    for i in range(4):
        for j in range(i, 4):
            product = slopes[i] * slopes[j] + curves.get((i, j), 0.0)
            gone.second(i, j, (share * product).sum(axis=1) - gone.g[i] * gone.g[j])
    out = _log_sum(alive, gone)
    return _rising(out, 1.0, (0,), r, x)


def _jet_gg(theta, d) -> Jet:
    p, q, v = theta
    x, m = d["x"], d["m"]
    spent, total = x * m, v + x * m
    kinds, at = np.unique(x, return_inverse=True)
    shape, alone = p * x, p * kinds
    # differences of gammas and powers in forms that stay exact where q and v grow together without end
    one, two = (c[at] for c in rising_derivatives(q, alone))
    value = (lrising(q, alone) - lgamma(alone))[at] - q * np.log1p(spent / v) - shape * np.log(total) + (shape - 1.0) * np.log(m) + shape * np.log(x)
    out = Jet(3, value)
    out.first(0, x * ((digamma(alone + q) - digamma(alone))[at] + np.log(spent) - np.log(total)))
    out.first(1, one - np.log1p(spent / v)).first(2, (q * spent - shape * v) / (v * total))
    out.second(0, 0, x * x * (trigamma(alone + q) - trigamma(alone))[at]).second(0, 1, x * trigamma(alone + q)[at]).second(0, 2, -x / total)
    return out.second(1, 1, two).second(1, 2, spent / (v * total)).second(2, 2, shape / (total * total) - q * spent * (v + total) / (v * v * total * total))


def _grid(*axes) -> np.ndarray:
    return np.log(np.array(np.meshgrid(*axes, indexing="ij")).reshape(len(axes), -1).T)


@dataclass(frozen=True)
class ModelSpec:
    kernel: Callable
    names: tuple[str, ...]
    columns: tuple[str, ...]
    scaled: tuple[str, ...]   # data columns divided by the scale
    unscale: tuple[str, ...]  # parameters multiplied back by it
    starts: np.ndarray


SPECS = {
    "bgnbd": ModelSpec(_jet_bg, ("r", "alpha", "a", "b"), ("x", "tx", "age"), ("tx", "age"), ("alpha",),
                       _grid([0.3, 1.5, 8.0], [0.03, 0.3, 2.0], [0.1, 1.0], [1.0, 8.0])),
    "mbgnbd": ModelSpec(_jet_mbg, ("r", "alpha", "a", "b"), ("x", "tx", "age"), ("tx", "age"), ("alpha",),
                        _grid([0.3, 1.5, 8.0], [0.03, 0.3, 2.0], [0.1, 1.0], [1.0, 8.0])),
    "pareto": ModelSpec(_jet_pareto, ("r", "alpha", "s", "beta"), ("x", "tx", "age"), ("tx", "age"), ("alpha", "beta"),
                        _grid([0.3, 1.5, 8.0], [0.03, 0.3, 2.0], [0.2, 1.0], [0.1, 3.0])),
    "gammagamma": ModelSpec(_jet_gg, ("p", "q", "v"), ("x", "m"), ("m",), ("v",),
                            _grid([0.7, 3.0, 15.0], [1.5, 4.0, 15.0], [0.1, 1.0, 5.0])),
}


# ------------------------------------------------------------------ sufficient tuples

def purchase_tuples(rfm: DataFrame, weights: Sequence[Column]) -> DataFrame:
    """Distinct (frequency, recency, age) with a weight per problem."""
    names = [f"__w{i}" for i in range(len(weights))]
    return (rfm.select(F.col("frequency").cast("double").alias("x"), F.col("recency").alias("tx"), F.col("T").alias("age"),
                       *[w.cast("double").alias(n) for n, w in zip(names, weights)])
            .groupBy("x", "tx", "age").agg(*[F.sum(n).alias(n) for n in names])
            .select("x", "tx", "age", F.array(*names).alias("w")))


def value_tuples(rfm: DataFrame, weights: Sequence[Column]) -> DataFrame:
    """Distinct (frequency, repeat value) of repeat customers with a weight per problem."""
    m = monetary_column(rfm)
    names = [f"__w{i}" for i in range(len(weights))]
    return (rfm.where((F.col("frequency") > 0) & (F.col(m) > 0))
            .select(F.col("frequency").cast("double").alias("x"), F.col(m).alias("m"),
                    *[w.cast("double").alias(n) for n, w in zip(names, weights)])
            .groupBy("x", "m").agg(*[F.sum(n).alias(n) for n in names])
            .select("x", "m", F.array(*names).alias("w")))


def bootstrap_weights(n: int, seed: int, key: str = "customer_id") -> list[Column]:
    """Poisson(1) resampling weights per customer and replicate: the distributed form of drawing with replacement."""
    cdf, term, total = [], np.exp(-1.0), 0.0
    for k in range(14):
        total += term
        cdf.append(total)
        term /= k + 1
    steps = F.array(*[F.lit(float(c)) for c in cdf])

    def weight(b: int) -> Column:
        u = F.pmod(F.xxhash64(F.col(key), F.lit(b), F.lit(seed)), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
        return F.size(F.filter(steps, lambda c: u >= c))

    return [weight(b) for b in range(n)]


# ------------------------------------------------------------------ optimizer

def _columns(batch: pa.RecordBatch, spec: ModelSpec, scale: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    d = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) / (scale if c in spec.scaled else 1.0) for c in spec.columns}
    return d, batch.column("w").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _spread(tuples: DataFrame) -> DataFrame:
    """Dealt over all cores: adaptive coalescing sees the few bytes of the tuples, not the work that each of them makes."""
    session = tuples.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return tuples.repartition(n, *[c for c in tuples.columns if c != "w"])


def evaluate(tuples: DataFrame, spec: ModelSpec, scale: float, points: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Weighted sums per problem and point, from one aggregation over the tuples: value, gradient and upper Hessian in the log-parameters.

    points: for each problem the log-parameters asked for, one row each. A point that several problems ask for is worked out once.
    """
    k = len(spec.names)
    upper = np.triu_indices(k)
    wanted: dict[bytes, list[tuple[int, int]]] = {}
    for i, rows in points.items():
        for j, row in enumerate(rows):
            wanted.setdefault(np.asarray(row, dtype=float).tobytes(), []).append((i, j))
    width = 1 + k + len(upper[0])

    def partial(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            d, w = _columns(batch, spec, scale)
            for key, users in wanted.items():
                theta = np.exp(np.frombuffer(key, dtype=float))
                columns = w[:, [i for i, _ in users]]
                used = columns.any(axis=1)
                if not used.any():
                    continue
                jet = spec.kernel(theta, {c: v[used] for c, v in d.items()})
                weights = columns[used]
                g = theta[:, None] * (jet.g @ weights)
                h = theta[:, None, None] * theta[None, :, None] * (jet.h @ weights)
                h[np.arange(k), np.arange(k)] += g
                sums = np.concatenate([(jet.value @ weights)[None], g, h[upper]])
                for user, total in zip(users, sums.T):
                    totals[user] = totals.get(user, 0.0) + total
        if totals:
            i, j = zip(*totals)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))],
                                             names=["problem", "point", "sums"])

    sums = tuples.mapInArrow(partial, "problem int, point int, sums array<double>")
    rows = sums.groupBy("problem", "point").agg(*[F.sum(F.col("sums")[c]).alias(f"s{c}") for c in range(width)]).collect()
    out = {i: np.zeros((len(p), width)) for i, p in points.items()}
    for r in rows:
        out[r[0]][r[1]] = r[2:]
    return out


def _direction(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Newton step with the curvature made positive, within the trust region."""
    values, vectors = np.linalg.eigh(hess)
    values = np.maximum(np.abs(values), 1e-10 * max(1.0, np.abs(values).max()))
    step = -vectors @ ((vectors.T @ grad) / values)
    longest = np.abs(step).max()
    return step * min(1.0, STEP / longest) if longest > 0 else step


@dataclass
class _Problem:
    """Where one problem stands: best point with its objective (mean negative log-likelihood plus penalty), and the step under trial."""
    n: float
    penalty: float
    theta: np.ndarray
    f: float = float("inf")
    grad: np.ndarray | None = None
    hess: np.ndarray | None = None
    step: np.ndarray | None = None
    scale: float = 1.0
    slope: bool = False  # the last steps did not shrink: a likelihood that only flattens out
    rounds: int = 0
    done: bool = False
    converged: bool = False

    def trials(self) -> np.ndarray:
        """Points of the next pass; on a slope also one several steps ahead."""
        if self.step is None:
            return self.theta[None]
        return np.array([self.theta + self.scale * self.step, *([self.theta + AHEAD * self.step] if self.slope else [])])

    def objective(self, sums: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        k = theta.size
        square = 2.0 * self.penalty * np.exp(2.0 * theta)
        hess = np.zeros((k, k))
        hess[np.triu_indices(k)] = -sums[1 + k:] / self.n
        hess = hess + np.triu(hess, 1).T + np.diag(2.0 * square)
        return -sums[0] / self.n + 0.5 * square.sum(), -sums[1:1 + k] / self.n + square, hess

    def take(self, rows: np.ndarray, tolerance: float) -> None:
        self.rounds += 1
        points = self.trials()
        found = [(*self.objective(sums, theta), theta) for sums, theta in zip(rows, points)]
        f, grad, hess, theta = min(found, key=lambda v: v[0] if np.isfinite(v[0]) and np.isfinite(v[1]).all() else np.inf)
        flat = self.grad is not None and f <= self.f + 1e-14 * max(1.0, abs(self.f)) and np.abs(grad).max() < np.abs(self.grad).max()
        if np.isfinite(f) and np.isfinite(grad).all() and (f < self.f or flat):
            gain, full, old = self.f - f, self.scale == 1.0, self.step
            self.theta, self.f, self.grad, self.hess, self.scale = theta, f, grad, hess, 1.0
            self.step = _direction(grad, hess)
            self.slope = old is not None and full and bool(np.abs(self.step).max() > 0.4 * np.abs(old).max())
            # what the step left promises; on a slope that flattens for ever also what the last full step brought. Where the likelihood curves
            # upwards the promise of a Newton step means nothing: such a plateau is walked on
            upwards = np.linalg.eigvalsh(hess)[0] < -UPWARDS
            self.done = self.converged = bool(not upwards and np.abs(grad).max() < SCORE and (abs(grad @ self.step) < tolerance or (full and gain < tolerance)))
        elif self.grad is None:
            self.done = True
        elif self.scale > 1e-6:
            self.scale, self.slope = self.scale * 0.25, False
        else:
            self.done, self.converged = True, bool(abs(self.grad @ self.step) < 1e3 * tolerance)


def fit(tuples: DataFrame, model: str, n_problems: int = 1, penalties: Sequence[float] | None = None, tolerance: float = 1e-7, warm: bool = False) -> list[Fit]:
    """Newton in log-parameters for all problems at once. The tuples are cached for the passes.

    A fit ends when the step left promises less than ``tolerance`` in mean log-likelihood. There is no bound on the parameters: where the data are
    nearly Poisson the likelihood rises ever more slowly towards a limit in which only the ratio r / alpha matters, and the fit
    ends on that slope by the same rule; its certificate says that it is not identified.
    warm: problem 0 is fitted first, all others start from it.
    """
    spec = SPECS[model]
    penalties = list(penalties or [0.0] * n_problems)
    data = _spread(tuples).persist()
    try:
        size = data.agg(*[F.sum(F.col("w")[i]).alias(str(i)) for i in range(n_problems)],
                        (F.max("age") if "age" in data.columns else F.avg("m")).alias("scale")).first()
        scale = float(size["scale"] or 1.0)
        problems = [_Problem(size[str(i)] or 0.0, penalties[i], spec.starts[0]) for i in range(n_problems)]
        for p in problems:
            p.done = p.n <= 0
        tolerance = max(1e-13, min(tolerance, 1e-4 / max([1.0, *[p.n for p in problems]])))

        def start(ids: list[int]) -> None:
            """The best point of the grid."""
            for i, sums in evaluate(data, spec, scale, {i: spec.starts for i in ids}).items():
                p = problems[i]
                values = [p.objective(s, t)[0] for s, t in zip(sums, spec.starts)]
                p.theta = spec.starts[int(np.argmin(np.where(np.isfinite(values), values, np.inf)))]

        def run(ids: list[int]) -> None:
            while ids := [i for i in ids if not problems[i].done]:
                for i, rows in evaluate(data, spec, scale, {i: problems[i].trials() for i in ids}).items():
                    problems[i].take(rows, tolerance)

        open_ = [i for i in range(n_problems) if not problems[i].done]
        if warm and open_ and open_[0] == 0:
            start([0])
            run([0])
            for i in open_[1:]:
                problems[i].theta = problems[0].theta  # the first pass gives each resample its score here, hence its influence step
            run(open_[1:])
        elif open_:
            start(open_)
            run(open_)
    finally:
        data.unpersist()
    fits = []
    for p in problems:
        values = {name: float(v) * (scale if name in spec.unscale else 1.0) for name, v in zip(spec.names, np.exp(p.theta))}
        if p.grad is None:
            fits.append(Fit(values, float("nan"), float(p.n), p.rounds, False))
            continue
        ll = -float(p.f - p.penalty * np.sum(np.exp(p.theta) ** 2))
        fits.append(Fit(values, ll, float(p.n), p.rounds, p.converged, float(np.abs(p.grad).max()), float(abs(p.grad @ p.step)), float(np.linalg.eigvalsh(p.hess)[0])))
    return fits


def log_likelihoods(tuples: DataFrame, model: str, params: Sequence[Sequence[float]], n_problems: int = 1) -> dict[tuple[int, int], float]:
    """{(problem, point): total log-likelihood} at given parameters, from the kernels the fits use."""
    found = evaluate(_spread(tuples), SPECS[model], 1.0, {i: np.log(np.array(params, dtype=float)) for i in range(n_problems)})
    return {(i, j): float(row[0]) for i, rows in found.items() for j, row in enumerate(rows)}


def _settled(f: Fit) -> Fit:
    if not f.converged and f.n > 0:
        raise ArithmeticError(f"the fit over {f.n:g} rows has not converged (slope {f.score:.3g}); its parameters must not be used")
    return f


def _bg(f: Fit, modified: bool = False) -> BetaGeometric:
    return BetaGeometric(**f.params, modified=modified)


def fit_bg(rfm: DataFrame, penalizer: float = 0.0) -> tuple[BetaGeometric, Fit]:
    f = fit(purchase_tuples(rfm, [F.lit(1)]), "bgnbd", 1, [penalizer])[0]
    return _bg(_settled(f)), f


def fit_mbg(rfm: DataFrame, penalizer: float = 0.0) -> tuple[BetaGeometric, Fit]:
    f = fit(purchase_tuples(rfm, [F.lit(1)]), "mbgnbd", 1, [penalizer])[0]
    return _bg(_settled(f), True), f


def fit_pareto(rfm: DataFrame, penalizer: float = 0.0) -> tuple[ParetoNbd, Fit]:
    f = fit(purchase_tuples(rfm, [F.lit(1)]), "pareto", 1, [penalizer])[0]
    return ParetoNbd(**_settled(f).params), f


def fit_gamma_gamma(rfm: DataFrame, penalizer: float = 0.0) -> tuple[GammaGamma, Fit]:
    f = fit(value_tuples(rfm, [F.lit(1)]), "gammagamma", 1, [penalizer])[0]
    return GammaGamma(**_settled(f).params), f


def fit_penalties(rfm: DataFrame, grid: Sequence[float] = DEFAULTS.penalizer_grid) -> list[Fit]:
    """BG/NBD under several penalties, all in the same passes."""
    return fit(purchase_tuples(rfm, [F.lit(1)] * len(grid)), "bgnbd", len(grid), grid)


def labelled_tuples(frames: DataFrame, label: str, labels: Sequence[str], model: str) -> DataFrame:
    """The tuples of a model with one weight per value of ``label``."""
    weights = [(F.col(label) == v).cast("int") for v in labels]
    return (value_tuples if model == "gammagamma" else purchase_tuples)(frames, weights)


def fit_labelled(frames: DataFrame, *given) -> dict[str, Fit]:
    """One fit per label (for instance a cutoff), all in the same passes.

    ``(tuples, labels, model)`` takes the rows of ``labelled_tuples``, ``(frames, label, labels, model)`` the rows that those are made from.
    """
    *label, labels, model = given
    tuples = labelled_tuples(frames, *label, labels, model) if label else frames
    return dict(zip(labels, fit(tuples, model, len(labels))))


def fit_bootstrap(rfm: DataFrame, n: int, seed: int = 42, penalizer: float = 0.0
                  ) -> tuple[BetaGeometric, GammaGamma, list[tuple[BetaGeometric, GammaGamma]], int]:
    """Point fit and ``n`` refits on resamples, which start at the point fit and share their passes.

    Returns both point models, the refitted pairs and the number of replicates left out because a
    fit did not converge to a finite likelihood.
    """
    weights = [F.lit(1), *bootstrap_weights(n, seed)]
    bg = fit(purchase_tuples(rfm, weights), "bgnbd", n + 1, [penalizer] * (n + 1), warm=True)
    gg = fit(value_tuples(rfm, weights), "gammagamma", n + 1, [penalizer] * (n + 1), warm=True)
    pairs = [(_bg(a), GammaGamma(**b.params)) for a, b in zip(bg[1:], gg[1:])
             if a.converged and b.converged and np.isfinite(a.log_likelihood) and np.isfinite(b.log_likelihood)]
    return _bg(_settled(bg[0])), GammaGamma(**_settled(gg[0]).params), pairs, n - len(pairs)


def fits_frame(spark, rows: Sequence[tuple[str, Fit]]) -> DataFrame:
    """Fitted parameters as rows (label, parameter, value, ...)."""
    schema = ("label string, parameter string, value double, log_likelihood double, customers double, "
              "iterations int, converged boolean, score double, gain double, curvature double, identified boolean")
    return spark.createDataFrame(
        [(label, k, v, f.log_likelihood, f.n, f.iterations, f.converged, f.score, f.gain, f.curvature, f.identified)
         for label, f in rows for k, v in f.params.items()], schema)
