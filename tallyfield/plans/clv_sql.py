"""SQL of lifetime-value scoring with pinned parameters, term by term from the published formulas."""

from __future__ import annotations

from tallyfield.operators.scoring import BetaGeometric, GammaGamma, ParetoNbd
from tallyfield.plans.frames import CUTOFFS, HOLDOUT_END
from tallyfield.plans.sqltext import LINES, holdout, rfm, rnd

# pinned parameters of the comparison runs
BG = BetaGeometric(2.5, 400.0, 0.6, 6.0)
MBG = BetaGeometric(2.5, 400.0, 0.6, 6.0, modified=True)
PARETO = ParetoNbd(2.5, 400.0, 0.7, 900.0)
GG = GammaGamma(6.0, 4.0, 15000.0)
TERMS = 200  # z stays below 0.65 with these parameters


def d(v: float) -> str:
    return f"{v!r}e0"


def nodes(name: str, steps: int = 48, h: float = 0.08) -> str:
    """Double-exponential rule on (0, 1): u = 1 / (1 + exp(-pi sinh t)) at equal steps of t. The operators use Gauss-Legendre."""
    return f"""{name}(u, w) AS (SELECT u, {d(h)} * pi() * cosh(t) * u * (1.0e0 - u) FROM (SELECT t, 1.0e0 / (1.0e0 + exp(-pi() * sinh(t))) AS u
  FROM (SELECT k * {d(h)} AS t FROM range({-steps}, {steps + 1}) r(k))) WHERE u < 1.0e0)"""


def alive(m: BetaGeometric) -> str:
    power = f"pow(({d(m.alpha)} + T) / ({d(m.alpha)} + recency), {d(m.r)} + frequency)"
    if m.modified:
        return f"(1.0e0 / (1.0e0 + {d(m.a)} / ({d(m.b)} + frequency) * {power}))"
    return f"(CASE WHEN frequency = 0 THEN 1.0e0 ELSE 1.0e0 / (1.0e0 + {d(m.a)} / ({d(m.b)} + frequency - 1.0e0) * {power}) END)"


def purchases(name: str, source: str, m: BetaGeometric, horizon: str, extra: str = "") -> str:
    """CTEs ending in ``name``: all columns of ``source`` plus E (expected purchases to ``horizon`` days)."""
    bb = f"({d(m.b)} + frequency{' + 1.0e0' if m.modified else ''})"
    q = m.a - 1.0
    return f"""{name}_co AS (SELECT frequency, n, {d(q)} * exp(lgamma(c - {d(m.r)} - frequency + n) - lgamma(c - {d(m.r)} - frequency)
    + lgamma({d(q)} + n) - lgamma({d(q + 1)}) + lgamma(c) - lgamma(c + n) - lgamma(n + 1)) AS k
  FROM (SELECT DISTINCT frequency, {d(m.a)} + {bb} - 1.0e0 AS c FROM {source} WHERE frequency > 0), range(1, {TERMS + 1}) r(n)),
{name}_z AS (SELECT s.*, {horizon} / ({d(m.alpha)} + T + {horizon}) AS z, row_number() OVER () AS rid FROM {source} s),
{name}_f AS (SELECT rid, 1.0e0 + sum(k * pow(z, n)) AS F FROM {name}_z s JOIN {name}_co c ON s.frequency = c.frequency GROUP BY rid),
{name}_q AS (SELECT rid, sum(w * CASE WHEN p * {horizon} / ({d(m.alpha)} + T) < 1e-6
      THEN {d(m.r)} * {horizon} / ({d(m.alpha)} + T) * (1.0e0 - 0.5e0 * ({d(m.r)} + 1.0e0) * p * {horizon} / ({d(m.alpha)} + T))
      ELSE (1.0e0 - pow(({d(m.alpha)} + T) / ({d(m.alpha)} + T + p * {horizon}), {d(m.r)})) / p END
      * exp(({bb} - 1.0e0) * ln(1.0e0 - p) - ln({d(m.a)}) - (lgamma({d(m.a)}) + lgamma({bb}) - lgamma({d(m.a)} + {bb})))) AS F
  FROM {name}_z, (SELECT greatest(1e-15, least(1.0e0 - 1e-15, pow(u, 1.0e0 / {d(m.a)}))) AS p, w FROM gl) WHERE frequency = 0 GROUP BY rid),
{name} AS (SELECT s.*, {alive(m)} * CASE WHEN frequency = 0 THEN qq.F ELSE
    ({d(m.a)} + {bb} - 1.0e0) / {d(q)} * (1.0e0 - pow(1.0e0 - z, {d(q)}) * ff.F) END AS E
  FROM {name}_z s LEFT JOIN {name}_f ff ON s.rid = ff.rid LEFT JOIN {name}_q qq ON s.rid = qq.rid)"""


def pareto(name: str, source: str, m: ParetoNbd, horizon: str) -> str:
    k = f"({d(m.r)} + frequency + {d(m.s)})"
    return f"""{name}_z AS (SELECT s.*, row_number() OVER () AS rid FROM {source} s),
{name}_i AS (SELECT rid, sum(w * (1.0e0 - low) * pow(nd, ({d(m.r)} + frequency - 1.0e0) / {k} - 1.0e0)
    * pow(({d(m.beta)} + ({d(m.alpha)} + recency) * pow(nd, -1.0e0 / {k}) - {d(m.alpha)}) / ({d(m.beta)} + recency), {d(-(m.s + 1))})) AS I
  FROM (SELECT z.*, low, low + (1.0e0 - low) * u AS nd, w FROM (SELECT *, pow(({d(m.alpha)} + recency) / ({d(m.alpha)} + T), {k}) AS low
     FROM {name}_z) z, glp) GROUP BY rid),
{name} AS (SELECT z.*, 1.0e0 / (1.0e0 + {d(m.s)} * I / {k} * pow({d(m.alpha)} + recency, 1.0e0 - {d(m.r)} - frequency)
     * pow({d(m.beta)} + recency, {d(-(m.s + 1))}) * pow({d(m.alpha)} + T, {d(m.r)} + frequency) * pow({d(m.beta)} + T, {d(m.s)})) AS pa
  FROM {name}_z z JOIN {name}_i i ON z.rid = i.rid),
{name}_e AS (SELECT *, pa * ({d(m.r)} + frequency) * ({d(m.beta)} + T) / (({d(m.alpha)} + T) * {d(m.s - 1)})
   * (1.0e0 - pow(({d(m.beta)} + T) / ({d(m.beta)} + T + {horizon}), {d(m.s - 1)})) AS pe FROM {name})"""


ORDER_VALUE = f"({d(GG.p)} * ({d(GG.v)} + frequency * monetary_value_repeat) / ({d(GG.p)} * frequency + {d(GG.q - 1)}))"
NODES = nodes("gl")

HOLDOUTS = LINES + ", " + ", ".join(holdout(f"h{i}", c, HOLDOUT_END) for i, c in enumerate(CUTOFFS)) + """,
hall AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS cutoff, * FROM h{i}" for i, c in enumerate(CUTOFFS)) + ")"

BASE = HOLDOUTS + f""", f0 AS (SELECT cutoff, avg(actual_holdout_purchases) AS m FROM hall WHERE frequency = 0 GROUP BY cutoff),
bl AS (SELECT hall.*, frequency / greatest(1.0e0, T) * holdout_duration_days AS naive1_purchases,
  frequency * (holdout_duration_days / 365.0e0) AS naive2_purchases,
  CASE WHEN frequency = 0 THEN coalesce(m / holdout_duration_days, 0.002465e0) * holdout_duration_days
       ELSE frequency / greatest(1.0e0, T) * holdout_duration_days END AS naive3_purchases
  FROM hall LEFT JOIN f0 ON hall.cutoff = f0.cutoff)"""

_DAYS = "holdout_duration_days"
PREDS = BASE + f""", {NODES}, {nodes('glp')}, {purchases('b1', 'bl', BG, _DAYS)},
b2s AS (SELECT * EXCLUDE (z, rid, E), E AS e_bg FROM b1), {purchases('b2', 'b2s', MBG, _DAYS)},
b3s AS (SELECT * EXCLUDE (z, rid, E), E AS e_mbg FROM b2), {pareto('b3', 'b3s', PARETO, _DAYS)},
ro AS (SELECT *, {rnd('e_bg', 6)} AS predicted_purchases, {rnd(alive(BG), 9)} AS p_alive, {rnd('e_mbg', 6)} AS mbgnbd_predicted_purchases,
  {rnd(alive(MBG), 9)} AS mbgnbd_p_alive, {rnd('pe', 6)} AS paretonbd_predicted_purchases, {rnd('pa', 9)} AS paretonbd_p_alive,
  {rnd(f'CASE WHEN frequency > 0 THEN {ORDER_VALUE} ELSE monetary_value END', 4)} AS expected_order_value FROM b3_e),
preds AS (SELECT cutoff, customer_id, frequency, recency, T, monetary_value, monetary_value_repeat, expected_order_value,
  actual_holdout_purchases AS actual_purchases, actual_holdout_spend AS actual_revenue, predicted_purchases,
  predicted_purchases * expected_order_value AS predicted_revenue, p_alive,
  naive1_purchases, naive1_purchases * expected_order_value AS naive1_revenue, naive2_purchases,
  naive2_purchases * expected_order_value AS naive2_revenue, naive3_purchases, naive3_purchases * expected_order_value AS naive3_revenue,
  mbgnbd_predicted_purchases, mbgnbd_predicted_purchases * expected_order_value AS mbgnbd_predicted_revenue, mbgnbd_p_alive,
  paretonbd_predicted_purchases, paretonbd_predicted_purchases * expected_order_value AS paretonbd_predicted_revenue, paretonbd_p_alive,
  holdout_duration_days FROM ro)"""

_RFM = LINES + ", " + rfm("rfm", "lines", "TRUE", "(SELECT max(invoice_date) FROM stg)")
_MONTHS = "months AS (SELECT rfm.*, CAST(mm AS DOUBLE) * 30.0e0 AS days, mm FROM rfm, range(1, 25) r(mm))"


def _value(m: int) -> str:
    return f"sum(CASE WHEN mm <= {m} THEN (E - prev) / pow(1.01e0, mm) ELSE 0 END)"


SCORES = f"""{_RFM}, {NODES}, {_MONTHS}, {purchases('pm', 'months', BG, 'days')},
mp AS (SELECT coalesce(avg({ORDER_VALUE}), 350.0e0) AS v FROM rfm WHERE frequency > 0),
mb AS (SELECT coalesce(avg(monetary_value), 350.0e0) AS v FROM rfm WHERE monetary_value > 0),
inc AS (SELECT *, lag(E, 1, 0.0e0) OVER (PARTITION BY customer_id ORDER BY mm) AS prev FROM pm),
cum AS (SELECT customer_id, max(CASE WHEN mm = 12 THEN E END) AS e12, max(CASE WHEN mm = 24 THEN E END) AS e24,
  {_value(12)} AS d12, {_value(24)} AS d24 FROM inc GROUP BY customer_id),
val AS (SELECT r.*, CASE WHEN frequency > 0 THEN {ORDER_VALUE} WHEN monetary_value > 0 THEN monetary_value ELSE mb.v END AS uv,
  CASE WHEN frequency > 0 AND monetary_value_repeat > 0 THEN {ORDER_VALUE} ELSE mp.v END AS aov FROM rfm r, mp, mb),
scores AS (SELECT v.customer_id, frequency, recency, T, monetary_value, monetary_value_repeat, total_orders, total_monetary,
  'Maximum Likelihood Estimation (MLE)' AS estimation_method, {rnd(alive(BG), 9)} AS p_alive, {rnd('aov', 4)} AS expected_avg_order_value,
  {rnd('e12')} AS expected_purchases_12m, {rnd('uv * d12')} AS clv_12m, {rnd('e24')} AS expected_purchases_24m, {rnd('uv * d24')} AS clv_24m
  FROM val v JOIN cum c ON v.customer_id = c.customer_id)"""
RFM = _RFM


# ------------------------------------------------------------------ log-likelihoods at pinned points

GRID = {
    "bgnbd": ((2.5, 400.0, 0.6, 6.0), (0.9, 150.0, 1.4, 3.0), (40.0, 9000.0, 0.05, 2.0)),
    "mbgnbd": ((2.5, 400.0, 0.6, 6.0), (0.9, 150.0, 1.4, 3.0), (40.0, 9000.0, 0.05, 2.0)),
    "pareto": ((2.5, 400.0, 0.7, 900.0), (0.9, 150.0, 1.4, 300.0), (40.0, 9000.0, 0.05, 2000.0)),
    "gammagamma": ((6.0, 4.0, 15000.0), (1.5, 2.5, 60000.0), (20.0, 9.0, 30000.0)),
}


def _plus(u: str, v: str) -> str:
    """log(e^u + e^v)."""
    return f"(greatest({u}, {v}) + ln(exp({u} - greatest({u}, {v})) + exp({v} - greatest({u}, {v}))))"


def likelihood(model: str) -> str:
    """CTE ll(cutoff, point, v): the log-likelihood of every customer at every pinned point, from the published densities."""
    names = {"gammagamma": "p, q, v"}.get(model, "r, alpha, s, beta" if model == "pareto" else "r, alpha, a, b")
    points = ", ".join(f"({i}, {', '.join(d(x) for x in point)})" for i, point in enumerate(GRID[model]))
    grid = f"pt(point, {names}) AS (VALUES {points})"
    decay = "(r * ln(alpha) - (r + x) * ln(alpha + {t}))"
    rows = "cu AS (SELECT cutoff, CAST(frequency AS DOUBLE) AS x, recency AS tx, T AS age, row_number() OVER () AS rid FROM hall)"
    if model == "gammagamma":
        return f"""{grid}, cu AS (SELECT cutoff, CAST(frequency AS DOUBLE) AS x, monetary_value_repeat AS m FROM hall WHERE frequency > 0 AND monetary_value_repeat > 0),
ll AS (SELECT cutoff, point, lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * ln(v) + (p * x - 1.0e0) * ln(m) + p * x * ln(x) - (p * x + q) * ln(x * m + v) AS v FROM cu, pt)"""
    if model == "pareto":
        return f"""{grid}, {rows}, {nodes('de', 60, 0.06)},
gone AS (SELECT rid, point, sum(w * span * exp(ln(s) + r * ln(alpha) + s * ln(beta) + (1.0e0 - r - x) * ly - (s + 1.0e0) * ln(beta - alpha + exp(ly)))) AS g
  FROM (SELECT rid, point, x, r, alpha, s, beta, w, ln((alpha + age) / (alpha + tx)) AS span, ln(alpha + tx) + ln((alpha + age) / (alpha + tx)) * u AS ly FROM cu, pt, de)
  GROUP BY rid, point),
ll AS (SELECT cutoff, point, lgamma(r + x) - lgamma(r) + ln(exp({decay.format(t='age')} + s * ln(beta / (beta + age))) + g) AS v
  FROM cu JOIN gone USING (rid) JOIN pt USING (point))"""
    if model == "mbgnbd":
        alive = f"({decay.format(t='age')} + ln(b + x))"
        gone = f"({decay.format(t='tx')} + ln(a))"
        rest = "lgamma(b + x) - lgamma(b) - lgamma(a + b + x + 1.0e0) + lgamma(a + b)"
        value = _plus("la", "lg")
    else:
        alive = decay.format(t="age")
        gone = f"({decay.format(t='tx')} + ln(a) - ln(b + x - 1.0e0))"
        rest = "lgamma(b + x) - lgamma(b) - lgamma(a + b + x) + lgamma(a + b)"
        value = f"CASE WHEN x > 0 THEN {_plus('la', 'lg')} ELSE la END"
    return f"""{grid}, {rows}, lp AS (SELECT cutoff, point, x, {alive} AS la, CASE WHEN x > 0 OR {str(model == 'mbgnbd').upper()} THEN {gone} END AS lg,
  lgamma(r + x) - lgamma(r) + {rest} AS rest FROM cu, pt),
ll AS (SELECT cutoff, point, rest + {value} AS v FROM lp)"""
