"""Building blocks of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations


def rnd(x: str, d: int = 2) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


def money(x: str) -> str:
    """Exact sum of amounts, as the nearest double (a cast from DECIMAL straight to DOUBLE is not)."""
    return f"CAST(CAST(sum(CAST({x} AS DECIMAL(38,8))) AS VARCHAR) AS DOUBLE)"


def u01(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0e0)"


def qcut(rn: str, n: str, q: int) -> str:
    return (f"CAST(CASE WHEN ({n}) <= 1 THEN 1 ELSE greatest(1, ((({rn}) - 1) * {q} + ({n}) - 2) // "
            f"greatest(({n}) - 1, 1)) END AS INTEGER)")


RAW = """raw AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS Invoice,
         CAST(l_partkey AS VARCHAR) AS StockCode, p_name AS Description,
         CAST(CAST(l_quantity AS INTEGER) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS INTEGER) AS Quantity,
         o_orderdate AS InvoiceDate, l_extendedprice / l_quantity AS Price,
         o_custkey AS "Customer ID", n_name AS Country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

STG = RAW + """, kept AS (
  FROM raw SELECT *, starts_with(Invoice, 'C') OR Quantity < 0 AS back WHERE Price > 0 AND "Customer ID" IS NOT NULL),
stg AS (
  SELECT back AS is_return, back AS is_cancelled, "Customer ID" AS customer_id, Country AS country, Invoice AS invoice_no, InvoiceDate AS invoice_date,
         StockCode AS stock_code, trim(Description) AS description, Quantity AS quantity, Price AS unit_price, Quantity::DOUBLE * Price AS line_total
  FROM kept)"""

LINES = STG + ", lines AS (SELECT * FROM stg WHERE NOT is_return)"

INT_ORDERS = STG + """, int_orders AS (
  SELECT CAST(row_number() OVER (ORDER BY invoice_date, customer_id, stock_code, invoice_no, description, quantity,
              unit_price, country, line_total, is_cancelled, is_return) AS BIGINT) AS transaction_id, *
  FROM stg)"""

# invoice grain first: an invoice is either all returns or none, so its kind can be read from any of its lines
INVOICES = f"""invoices AS (
  SELECT customer_id, invoice_no, bool_or(is_return) AS back, min(invoice_date) AS lo, max(invoice_date) AS hi, max(country) AS country,
         coalesce(sum(quantity) FILTER (quantity > 0), 0) AS units_out, coalesce(-sum(quantity) FILTER (quantity < 0), 0) AS units_back,
         count(*) FILTER (quantity > 0) AS lines_out, {money("line_total")} AS net,
         coalesce({money("CASE WHEN quantity > 0 THEN line_total END")}, 0) AS taken,
         coalesce({money("CASE WHEN quantity < 0 THEN -line_total END")}, 0) AS refunded
  FROM stg GROUP BY ALL)"""

DIM_CUSTOMERS = INVOICES + f""", per_customer AS (
  SELECT customer_id, max(country) AS country, min(lo) AS lo, max(hi) AS hi, count(*) FILTER (NOT back) AS bought, count(*) FILTER (back) AS brought,
         sum(units_out) AS units_out, sum(units_back) AS units_back, sum(lines_out) AS lines_out,
         {money("net")} AS net, {money("taken")} AS taken, {money("refunded")} AS refunded
  FROM invoices GROUP BY customer_id),
dim_customers AS (
  SELECT customer_id, country, lo AS first_purchase_date, hi AS last_purchase_date, bought AS total_orders, brought AS total_return_orders,
         units_out::BIGINT AS total_items_purchased, units_back::BIGINT AS total_items_returned,
         {rnd("taken")} AS gross_spend, {rnd("refunded")} AS return_spend, {rnd("net")} AS total_spend,
         {rnd("taken / nullif(lines_out, 0)")} AS avg_line_item_value, {rnd("net / nullif(bought, 0)")} AS avg_order_value
  FROM per_customer)"""

DIM_PRODUCTS = f"""sold AS (
  SELECT stock_code, description, invoice_no, is_return, {money("unit_price")} AS prices, count(*) AS lines, sum(quantity) AS units, {money("line_total")} AS net
  FROM stg GROUP BY ALL),
dim_products AS (
  SELECT stock_code, max(description) AS description, {rnd(money("prices") + " / sum(lines)")} AS avg_unit_price,
         count(DISTINCT invoice_no) FILTER (NOT is_return) AS total_orders, sum(units)::BIGINT AS total_quantity_sold, {rnd(money("net"))} AS total_revenue
  FROM sold GROUP BY stock_code)"""


def rfm(name: str, source: str, where: str, end: str) -> str:
    """RFM columns from ``source`` rows satisfying ``where``; ``end`` is a timestamp expression."""
    days = "date_diff('day', days[1], days[-1])::DOUBLE"
    return f"""{name}_baskets AS (
  SELECT customer_id, min(invoice_date) AS bought_at, {money("line_total")} AS worth FROM {source} WHERE {where} GROUP BY customer_id, invoice_no),
{name}_lists AS (
  SELECT customer_id, list(bought_at ORDER BY bought_at) AS days, list(worth ORDER BY worth) AS worths, {money("worth")} AS total
  FROM {name}_baskets GROUP BY customer_id),
{name} AS (
  SELECT customer_id, len(days) - 1 AS frequency, {days} AS recency, greatest({days}, date_diff('day', days[1], {end})::DOUBLE) AS T,
         {rnd("total / len(days)")} AS monetary_value,
         {rnd("coalesce((total - worths[1]) / nullif(len(days) - 1, 0), 0)")} AS monetary_value_repeat,
         len(days) AS total_orders, {rnd("total")} AS total_monetary
  FROM {name}_lists)"""


def holdout(name: str, cal: str, end: str, lines: str = "lines") -> str:
    return rfm(f"{name}_cal", lines, f"invoice_date <= TIMESTAMP '{cal}'", f"TIMESTAMP '{cal}'") + f""",
{name}_h AS (
  SELECT customer_id, count(DISTINCT invoice_no) AS p, {rnd(money("line_total"))} AS s FROM {lines}
  WHERE invoice_date > TIMESTAMP '{cal}' AND invoice_date <= TIMESTAMP '{end}' GROUP BY customer_id),
{name} AS (
  SELECT c.customer_id, frequency, recency, T, monetary_value, monetary_value_repeat, total_monetary, total_orders,
         coalesce(p, 0) AS actual_holdout_purchases, coalesce(s, 0.0e0) AS actual_holdout_spend,
         CAST(date_diff('day', DATE '{cal}', DATE '{end}') AS INTEGER) AS holdout_duration_days,
         '{cal}' AS calibration_end_date, '{end}' AS holdout_end_date
  FROM {name}_cal c LEFT JOIN {name}_h h ON c.customer_id = h.customer_id)"""
