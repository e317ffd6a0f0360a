"""SQL of the policy panel, from order lines to effects."""

from __future__ import annotations

from tallyfield.plans.frames import T0
from tallyfield.plans.sqltext import LINES, money, qcut, u01

SEED = 42
WEEK = "CAST(date_trunc('week', invoice_date) AS DATE)"

WEEKLY = f"""weekly AS (
  SELECT customer_id, {WEEK} AS week_date, count(DISTINCT invoice_no) AS cf_orders, {money('line_total')} AS cf_spend
  FROM lines GROUP BY customer_id, {WEEK})"""


def customers(t0: str = T0, mode: str = "stratified_random", share: str = "0.4e0", seed: int = SEED) -> str:
    base = f"""{LINES}, {WEEKLY},
pre_inv AS (SELECT customer_id, invoice_no, invoice_date, {money('line_total')} AS order_val FROM lines
  WHERE invoice_date < TIMESTAMP '{t0}' GROUP BY customer_id, invoice_no, invoice_date),
pre AS (SELECT customer_id, {money('order_val')} AS pre_spend, count(*) AS pre_orders,
  CAST(date_trunc('week', min(invoice_date)) AS DATE) AS first_week, quantile_cont(order_val, 0.5) AS median_order_val,
  min(invoice_date) AS first_date FROM pre_inv GROUP BY customer_id),
growth AS (SELECT p.customer_id,
  coalesce({money('CASE WHEN NOT late THEN order_val END')}, 0) AS early_spend,
  coalesce({money('CASE WHEN late THEN order_val END')}, 0) AS late_spend
  FROM (SELECT i.customer_id, order_val,
          (epoch_us(invoice_date) - epoch_us(first_date)) * 2 >= epoch_us(TIMESTAMP '{t0}') - epoch_us(first_date) AS late
        FROM pre_inv i JOIN pre ON i.customer_id = pre.customer_id) p GROUP BY p.customer_id),
rates AS (SELECT pre.*, greatest(1, date_diff('day', first_week, CAST(date_trunc('week', DATE '{t0}') AS DATE)) // 7) AS pre_weeks,
  greatest(0, pre_orders - 1) AS repeats, (late_spend - early_spend) / (late_spend + early_spend + 10.0e0) AS spend_growth,
  row_number() OVER (ORDER BY pre_spend, pre.customer_id) AS rn, count(*) OVER () AS n
  FROM pre JOIN growth ON pre.customer_id = growth.customer_id),
pool AS (SELECT CAST(sum(repeats) AS DOUBLE) / sum(pre_weeks) AS lam FROM rates),
base AS (SELECT rates.*, CAST(pre_orders AS DOUBLE) / pre_weeks AS raw_pre_order_rate,
  (repeats + lam * 4.0e0) / (pre_weeks + 4.0e0) AS pre_order_rate, {qcut('rn', 'n', 5)} AS spend_quintile FROM rates, pool)"""
    if mode == "confounded":
        return base + f""",
gr AS (SELECT *, (rank() OVER (ORDER BY spend_growth) + (count(*) OVER (PARTITION BY spend_growth) - 1) / 2.0e0) / n AS growth_rank FROM base),
cut AS (SELECT quantile_cont(growth_rank, 1.0e0 - {share}) AS c FROM gr),
cust AS (SELECT gr.*, CASE WHEN growth_rank >= c THEN 1 ELSE 0 END AS is_treated FROM gr, cut)"""
    return base + f""",
drawn AS (SELECT *, row_number() OVER (PARTITION BY spend_quintile ORDER BY {u01('customer_id', str(seed))}, customer_id) AS arn,
  count(*) OVER (PARTITION BY spend_quintile) AS nq FROM base),
cust AS (SELECT *, CASE WHEN arn <= round_even(nq * {share}, 0) THEN 1 ELSE 0 END AS is_treated FROM drawn)"""


def last(t0: str = T0) -> str:
    return f"""lastw AS (SELECT max(l) AS last_week FROM (SELECT customer_id, min(week_date) AS f, max(week_date) AS l
  FROM weekly GROUP BY customer_id) WHERE f < DATE '{t0}')"""


def grid(t0: str = T0) -> str:
    return f"""{last(t0)},
grid AS (SELECT customer_id, CAST(unnest(generate_series(CAST(first_week AS TIMESTAMP), CAST(last_week AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_date
  FROM cust, lastw),
bal AS (SELECT g.customer_id, g.week_date, CAST(coalesce(cf_orders, 0) AS INTEGER) AS cf_orders, coalesce(cf_spend, 0.0e0) AS cf_spend
  FROM grid g LEFT JOIN weekly w ON g.customer_id = w.customer_id AND g.week_date = w.week_date)"""


def panel(t0: str = T0, scenario: str = "baseline", mode: str = "stratified_random", seed: int = SEED) -> str:
    first_post = (f"CAST(date_trunc('week', DATE '{t0}' + INTERVAL 6 DAY) AS DATE)")
    k = f"greatest(0, date_diff('day', {first_post}, last_week) // 7 + 1)"
    hazard = {"severe": "0.2e0",
              "hidden_degradation": f"1.0e0 - pow(0.6e0, 1.0e0 / greatest(1, {k}))",
              "baseline": f"1.0e0 - pow(0.8e0, 1.0e0 / greatest(1, {k}))"}[scenario]
    return customers(t0, mode, seed=seed) + ", " + grid(t0) + f""",
hz AS (SELECT {hazard} AS h FROM lastw),
lim AS (SELECT coalesce(quantile_cont(cf_spend, 0.99), 5000.0e0) AS p99 FROM bal WHERE cf_spend > 0),
churn AS (SELECT c.*, CASE WHEN spend_quintile = 5 AND is_treated = 1
  THEN CAST(greatest(1, ceil(ln(1.0e0 - {u01('customer_id', "'churn'", str(seed))}) / ln(1.0e0 - h))) AS BIGINT) END AS churn_step FROM cust c, hz),
j AS (SELECT b.customer_id, b.week_date, cf_orders, cf_spend, is_treated, spend_quintile, median_order_val, pre_order_rate,
  raw_pre_order_rate, spend_growth, churn_step, p99,
  CASE WHEN b.week_date >= DATE '{t0}' THEN CAST(date_diff('day', {first_post}, b.week_date) // 7 + 1 AS INTEGER) END AS post_step
  FROM bal b JOIN churn c ON b.customer_id = c.customer_id, lim),
k AS (SELECT *, CASE WHEN post_step IS NOT NULL THEN 1 ELSE 0 END AS is_post_period,
  coalesce(post_step > churn_step, FALSE) AS is_churned,
  least(greatest(pre_order_rate * 0.15e0, 0.0e0), 1.0e0) AS prob FROM j),
a AS (SELECT *, is_treated = 1 AND is_post_period = 1 AND is_churned AS m_churn,
  is_treated = 1 AND is_post_period = 1 AND NOT is_churned AND cf_orders = 0 AS m_zero,
  is_treated = 1 AND is_post_period = 1 AND NOT is_churned AND cf_orders > 0 AS m_buy,
  {u01('customer_id', 'week_date', str(seed))} < prob AS added FROM k),
o AS (SELECT *, CASE WHEN m_churn THEN 0.0e0 WHEN m_zero THEN CASE WHEN added THEN 1.0e0 ELSE 0.0e0 END ELSE CAST(cf_orders AS DOUBLE) END AS observed_weekly_orders,
  CASE WHEN m_churn THEN 0.0e0 WHEN m_zero THEN CASE WHEN added THEN median_order_val * 1.1e0 ELSE 0.0e0 END
       WHEN m_buy THEN cf_spend * 1.1e0 ELSE cf_spend END AS observed_weekly_spend,
  CAST(cf_orders AS DOUBLE) AS counterfactual_weekly_orders, cf_spend AS counterfactual_weekly_spend,
  least(greatest(cf_spend, 0.0e0), p99) AS counterfactual_weekly_spend_winsor FROM a),
panel AS (SELECT *, least(greatest(observed_weekly_spend, 0.0e0), p99) AS observed_weekly_spend_winsor,
  observed_weekly_orders - counterfactual_weekly_orders AS realized_effect_orders,
  observed_weekly_spend - counterfactual_weekly_spend AS realized_effect_spend,
  least(greatest(observed_weekly_spend, 0.0e0), p99) - counterfactual_weekly_spend_winsor AS realized_effect_spend_winsor,
  CASE WHEN m_churn THEN -counterfactual_weekly_orders WHEN m_zero THEN prob ELSE 0.0e0 END AS expected_effect_orders,
  CASE WHEN m_churn THEN -cf_spend WHEN m_zero THEN prob * (median_order_val * 1.1e0) WHEN m_buy THEN cf_spend * 0.1e0 ELSE 0.0e0 END AS expected_effect_spend,
  CASE WHEN m_churn THEN -counterfactual_weekly_spend_winsor
       WHEN m_zero THEN prob * least(greatest(median_order_val * 1.1e0, 0.0e0), p99)
       WHEN m_buy THEN least(greatest(cf_spend * 1.1e0, 0.0e0), p99) - counterfactual_weekly_spend_winsor ELSE 0.0e0 END AS expected_effect_spend_winsor,
  CASE WHEN sum(counterfactual_weekly_orders) OVER w > 0 THEN 1.0e0 ELSE 0.0e0 END AS counterfactual_active_last_90d,
  CASE WHEN sum(observed_weekly_orders) OVER w > 0 THEN 1.0e0 ELSE 0.0e0 END AS observed_active_last_90d,
  CASE WHEN sum(observed_weekly_orders) OVER w > 0 THEN 1.0e0 ELSE 0.0e0 END
    - CASE WHEN sum(counterfactual_weekly_orders) OVER w > 0 THEN 1.0e0 ELSE 0.0e0 END AS realized_effect_active_last_90d
  FROM o WINDOW w AS (PARTITION BY customer_id ORDER BY week_date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))"""
