"""Sources, warehouse models, quality checks and reports on the test tables (S, M, Q, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.numeric import round_half
from tallyfield.operators import quality, reporting, rfm, warehouse
from tallyfield.plans.frames import CUTOFFS, HOLDOUT_END, HOME_COUNTRY, Frames, mart
from tallyfield.plans.sqltext import DIM_CUSTOMERS, DIM_PRODUCTS, INT_ORDERS, LINES, RAW, STG, rnd, u01
from tallyfield.plans.sqltext import rfm as rfm_sql
from tallyfield.sources import tables, transactions

SAMPLE_SIZE = 5000
MONTH_END = "2001-08-01"

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Frames(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ------------------------------------------------------------------ sources

@query("s1_union_parts", f"WITH {RAW} SELECT * FROM raw")
def s1(f):
    raw = f.raw()
    returned = F.col("Invoice").startswith("C")
    return transactions.union_parts([raw.where(returned), raw.where(~returned)])


@query("s3_scan_table", "SELECT * FROM orders")
def s3(f):
    return tables.read_table(f.spark, f"{f.sf_dir}/orders.parquet", view="scanned_orders")


@query("s4_resolve_columns", f"WITH {STG} SELECT invoice_no AS Invoice, stock_code AS StockCode, description AS "
       "Description, quantity AS Quantity, invoice_date AS InvoiceDate, unit_price AS Price, "
       'customer_id AS "Customer ID", country AS Country FROM stg')
def s4(f):
    stg = warehouse.stg_orders(f.raw())
    return transactions.resolve_columns(stg).select(*[F.col(f"`{c}`") for c in transactions.RAW_COLUMNS])


@query("s5_ingest_profile", f"""WITH {RAW} SELECT count(*) AS row_count, min(InvoiceDate) AS min_date,
  max(InvoiceDate) AS max_date, count(DISTINCT "Customer ID") AS unique_customers,
  {rnd("sum(Quantity * Price) / nullif(count(DISTINCT Invoice), 0)", 4)} AS avg_order_value FROM raw""")
def s5(f):
    return transactions.ingest_profile(f.raw(description=False, country=False)).withColumn(
        "avg_order_value", round_half("avg_order_value", 4))


@query("s6_stratified_sample", f"""WITH {RAW},
  top AS (SELECT Country AS c FROM raw GROUP BY Country ORDER BY count(*) DESC, Country LIMIT 10),
  marked AS (SELECT raw.*, CASE WHEN c IS NOT NULL THEN Country ELSE 'Other' END || '_' ||
               CASE WHEN Quantity < 0 THEN '1' ELSE '0' END AS stratum,
               {u01('Invoice', 'StockCode', 'Quantity', '42')} AS u FROM raw LEFT JOIN top ON Country = c),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, Invoice, StockCode, Quantity, Price) AS rn,
               count(*) OVER (PARTITION BY stratum) AS size, count(*) OVER () AS total FROM marked),
  flagged AS (SELECT *, CASE WHEN rn > least(greatest(round_even(size / total * {SAMPLE_SIZE}.0e0, 0), 1.0e0), size)
                 THEN 1 ELSE 0 END AS skip, {u01('stratum', 'rn', '43')} AS v FROM ranked),
  picked AS (SELECT *, row_number() OVER (ORDER BY skip, v, stratum, rn) AS final FROM flagged)
  SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country
  FROM picked WHERE final <= {SAMPLE_SIZE}""")
def s6(f):
    return transactions.stratified_sample(f.raw(), SAMPLE_SIZE, ["Invoice", "StockCode", "Quantity"], ["Price"])


# ------------------------------------------------------------------ warehouse models

@query("m1_stg_orders", f"WITH {STG} SELECT * FROM stg")
def m1(f):
    return warehouse.stg_orders(f.raw())


@query("m2_stg_customers", f"""WITH {STG} SELECT customer_id, max(country) AS country,
  min(invoice_date) AS first_order_date, max(invoice_date) AS last_order_date FROM stg GROUP BY customer_id""")
def m2(f):
    return warehouse.stg_customers(f.stg())


@query("m3_int_orders", f"""WITH {INT_ORDERS} SELECT *,
  CASE WHEN NOT is_return THEN line_total ELSE 0.0e0 END AS gross_line_total,
  CASE WHEN is_return THEN abs(line_total) ELSE 0.0e0 END AS return_line_total FROM int_orders""")
def m3(f):
    return f.int_orders()


@query("m4_customer_rfm", f"WITH {LINES}, " + rfm_sql(
    "rfm", "lines", "TRUE", "(SELECT max(invoice_date) FROM stg)") + " SELECT * FROM rfm")
def m4(f):
    return warehouse.customer_rfm(f.stg())


@query("m5_customer_week_panel", f"""WITH {STG} SELECT customer_id, country,
  CAST(date_trunc('week', invoice_date) AS TIMESTAMP) AS week_date, {rnd("sum(line_total)", 4)} AS weekly_spend,
  count(DISTINCT invoice_no) AS weekly_orders, CAST(sum(quantity) AS BIGINT) AS weekly_items,
  CASE WHEN country <> '{HOME_COUNTRY}' THEN 1 ELSE 0 END AS is_treated_cohort,
  CASE WHEN date_trunc('week', invoice_date) >= TIMESTAMP '2000-06-01' THEN 1 ELSE 0 END AS is_post_period
  FROM stg GROUP BY customer_id, country, date_trunc('week', invoice_date)""")
def m5(f):
    return warehouse.customer_week_panel(f.stg(), HOME_COUNTRY, "2000-06-01").withColumn(
        "weekly_spend", round_half("weekly_spend", 4))


@query("m6_dim_customers", f"WITH {STG}, {DIM_CUSTOMERS} SELECT * FROM dim_customers")
def m6(f):
    return f.dim_customers()


@query("m7_dim_products", f"WITH {STG}, {DIM_PRODUCTS} SELECT * FROM dim_products")
def m7(f):
    return warehouse.dim_products(f.stg())


@query("m8_fact_orders", f"""WITH {INT_ORDERS} SELECT transaction_id AS order_id, invoice_no, stock_code, customer_id,
  invoice_date, quantity, unit_price, line_total, country, is_cancelled, is_return FROM int_orders WHERE NOT is_return""")
def m8(f):
    return warehouse.fact_orders(f.int_orders())


@query("m9_fact_returns", f"""WITH {INT_ORDERS} SELECT transaction_id AS return_id, invoice_no, stock_code, customer_id,
  invoice_date, abs(quantity) AS quantity_returned, unit_price, abs(line_total) AS return_amount, country,
  is_cancelled, is_return FROM int_orders WHERE is_return""")
def m9(f):
    return warehouse.fact_returns(f.int_orders())


# ------------------------------------------------------------------ quality

def _star(f):
    io = f.int_orders()
    stg = f.stg()
    # the numbered lines are the staged lines in date and customer order: a task meets the lines of an invoice next to each other and
    # sends one row for them, whereas the staged table scatters them
    return dict(stg=stg, stg_cust=mart(f.spark, f.sf_dir, "stg_customers", lambda: warehouse.stg_customers(io)), lines=io,
                dim_cust=f.dim_customers(io), dim_prod=mart(f.spark, f.sf_dir, "dim_products", lambda: warehouse.dim_products(stg)), orders=warehouse.fact_orders(io),
                returns=warehouse.fact_returns(io))


_FACTS = INT_ORDERS + f""", {DIM_CUSTOMERS}, {DIM_PRODUCTS},
  fact_orders AS (SELECT *, transaction_id AS order_id FROM int_orders WHERE NOT is_return),
  fact_returns AS (SELECT *, transaction_id AS return_id FROM int_orders WHERE is_return),
  stg_customers AS (SELECT customer_id FROM stg GROUP BY customer_id)"""


def _nn(t, c):
    return (f"SELECT 'not_null' AS check_name, '{t}' AS table_name, '{c}' AS column_name, "
            f"count(*) AS failing_rows FROM {'stg' if t == 'stg_orders' else t} WHERE {c} IS NULL")


def _uq(t, c):
    return (f"SELECT 'unique' AS check_name, '{t}' AS table_name, '{c}' AS column_name, count(*) AS failing_rows "
            f"FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)")


def _fk(t, c, p):
    return (f"SELECT 'relationships' AS check_name, '{t}' AS table_name, '{c}' AS column_name, count(*) AS failing_rows "
            f"FROM {t} a WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} b WHERE b.{c} = a.{c})")


_NULLS = [("stg_orders", "customer_id"), ("stg_orders", "is_return"), ("stg_customers", "customer_id"),
          ("int_orders", "transaction_id"), ("dim_customers", "customer_id"), ("dim_products", "stock_code"),
          ("fact_orders", "order_id"), ("fact_orders", "customer_id"), ("fact_orders", "stock_code"),
          ("fact_returns", "return_id"), ("fact_returns", "customer_id"), ("fact_returns", "stock_code")]
_UNIQUE = [("stg_customers", "customer_id"), ("int_orders", "transaction_id"), ("dim_customers", "customer_id"),
           ("dim_products", "stock_code"), ("fact_orders", "order_id"), ("fact_returns", "return_id")]
_KEYS = [("fact_orders", "customer_id", "dim_customers"), ("fact_orders", "stock_code", "dim_products"),
         ("fact_returns", "customer_id", "dim_customers"), ("fact_returns", "stock_code", "dim_products")]
_ACCEPTED = ("SELECT 'accepted_values' AS check_name, 'stg_orders' AS table_name, 'is_return' AS column_name, "
             "count(*) AS failing_rows FROM stg WHERE is_return IS NOT NULL AND is_return NOT IN (TRUE, FALSE)")
_IDENTITY = (f"SELECT 'revenue_identity' AS check_name, 'dim_customers' AS table_name, 'total_spend' AS column_name, "
             f"count(*) AS failing_rows FROM dim_customers WHERE abs(total_spend - {rnd('gross_spend - return_spend')}) > 0.01e0")
_STATUS = "SELECT *, CASE WHEN failing_rows = 0 THEN 'pass' ELSE 'fail' END AS status FROM "


def _report(parts):
    return f"WITH {_FACTS}, checks AS ({' UNION ALL '.join(parts)}) {_STATUS} checks"


@query("q1_not_null", _report([_nn(*x) for x in _NULLS]))
def q1(f):
    s = _star(f)
    return quality.union_reports([
        quality.null_counts(s["stg"], "stg_orders", ["customer_id", "is_return"]),
        quality.null_counts(s["stg_cust"], "stg_customers", ["customer_id"]),
        quality.null_counts(s["lines"], "int_orders", ["transaction_id"]),
        quality.null_counts(s["dim_cust"], "dim_customers", ["customer_id"]),
        quality.null_counts(s["dim_prod"], "dim_products", ["stock_code"]),
        quality.null_counts(s["orders"], "fact_orders", ["order_id", "customer_id", "stock_code"]),
        quality.null_counts(s["returns"], "fact_returns", ["return_id", "customer_id", "stock_code"])])


@query("q2_unique", f"""WITH lk AS (SELECT l_orderkey * 10 + l_linenumber AS line_key FROM lineitem)
  SELECT line_key, count(*) AS row_count FROM lk GROUP BY line_key HAVING count(*) > 1""")
def q2(f):
    """Line keys that repeat (the generated lines do repeat them, so the result is not empty)."""
    lines = transactions.table(f.spark, f.sf_dir, "lineitem")
    keyed = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key"))
    return quality.duplicates(keyed, "line_key")


@query("q3_accepted_values", """SELECT o_orderkey, o_orderstatus FROM orders
  WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')""")
def q3(f):
    orders = transactions.table(f.spark, f.sf_dir, "orders")
    return quality.not_accepted(orders, "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("q4_relationships", """SELECT o_orderkey, o_custkey FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def q4(f):
    """Orders without lines: a foreign key that really is violated in the test tables."""
    orders = transactions.table(f.spark, f.sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = transactions.table(f.spark, f.sf_dir, "lineitem")
    return quality.orphans(orders, "o_orderkey", lines, "l_orderkey")


@query("q5_revenue_identity", f"""WITH {STG}, {DIM_CUSTOMERS} SELECT customer_id, gross_spend, return_spend, total_spend,
  {rnd('gross_spend - return_spend')} AS calculated_net_spend FROM dim_customers
  WHERE abs(total_spend - {rnd('gross_spend - return_spend')}) > 0.01e0""")
def q5(f):
    return quality.revenue_identity(f.dim_customers())


@query("q6_table_assertions", f"""WITH {_FACTS}, checks AS (
  SELECT 'required_table' AS check_name, t AS table_name, '' AS column_name, CAST(0 AS BIGINT) AS failing_rows
    FROM (VALUES ('dim_customers'), ('dim_products'), ('fact_orders'), ('fact_returns')) v(t)
  UNION ALL SELECT 'min_rows', 'raw', '', CASE WHEN count(*) < 5000 THEN 1 ELSE 0 END FROM raw
  UNION ALL SELECT 'min_last_date', 'raw', 'InvoiceDate', CASE WHEN max(InvoiceDate) < TIMESTAMP '2001-07-01' THEN 1 ELSE 0 END FROM raw
  UNION ALL {_nn('fact_orders', 'customer_id')} UNION ALL {_fk('fact_orders', 'customer_id', 'dim_customers')})
  {_STATUS} checks""")
def q6(f):
    s = _star(f)
    marts = {"dim_customers": s["dim_cust"], "dim_products": s["dim_prod"],
             "fact_orders": s["orders"], "fact_returns": s["returns"]}
    return quality.table_assertions(marts, f.raw(False, False), 5000, "2001-07-01")


@query("q7_revenue_reconciliation", f"""WITH {STG}, {DIM_CUSTOMERS},
  g AS (SELECT sum(line_total) AS v FROM stg WHERE NOT is_return),
  r AS (SELECT sum(abs(line_total)) AS v FROM stg WHERE is_return),
  d AS (SELECT sum(gross_spend) AS g, sum(return_spend) AS r, sum(total_spend) AS n FROM dim_customers)
  SELECT {rnd('g.v')} AS fact_gross, {rnd('r.v')} AS fact_returns, {rnd('g.v - r.v')} AS fact_net,
         {rnd('d.g')} AS dim_gross, {rnd('d.r')} AS dim_returns, {rnd('d.n')} AS dim_net,
         {rnd('d.g - d.r - d.n')} AS dim_difference, {rnd('g.v - r.v - d.n')} AS fact_dim_difference FROM g, r, d""")
def q7(f):
    stg = f.stg()
    return quality.revenue_reconciliation(warehouse.order_lines(stg), warehouse.return_lines(stg),
                                          f.dim_customers())


_ALL_CHECKS = [_nn(*x) for x in _NULLS] + [_uq(*x) for x in _UNIQUE] + [_fk(*x) for x in _KEYS] + [_ACCEPTED, _IDENTITY]


@query("q8_quality_report", _report(_ALL_CHECKS))
def q8(f):
    return quality.star_schema_report(**_star(f))


@query("q8_quality_summary", f"""WITH {_FACTS}, checks AS ({' UNION ALL '.join(_ALL_CHECKS)}), r AS ({_STATUS} checks)
  SELECT count(*) AS total_checks, count(CASE WHEN status = 'pass' THEN 1 END) AS passed_checks,
  count(CASE WHEN status <> 'pass' THEN 1 END) AS failed_checks, CAST(sum(failing_rows) AS BIGINT) AS failing_rows FROM r""")
def q8s(f):
    return quality.report_summary(quality.star_schema_report(**_star(f)))


_FRAMES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS cutoff, customer_id FROM lines WHERE invoice_date <= TIMESTAMP '{c}' GROUP BY customer_id" for c in CUTOFFS)


@query("q11_calibration_frames", f"""WITH {LINES}, frames AS ({_FRAMES_SQL}),
  firsts AS (SELECT customer_id, min(invoice_date) AS d FROM lines GROUP BY customer_id),
  sizes AS (SELECT cutoff, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers FROM frames GROUP BY cutoff),
  seen AS (SELECT cutoff, count(*) AS n FROM sizes JOIN firsts ON d <= CAST(cutoff AS TIMESTAMP) GROUP BY cutoff)
  SELECT s.cutoff, n_rows, n_customers, coalesce(n, 0) AS n_first_orders, n_rows = n_customers AS unique_ids,
  n_customers <= coalesce(n, 0) AS within_first_orders,
  coalesce(n_customers >= lag(n_customers) OVER (ORDER BY s.cutoff), TRUE) AS monotone
  FROM sizes s LEFT JOIN seen ON s.cutoff = seen.cutoff""")
def q11(f):
    lines = f.lines()
    frames = None
    for c in CUTOFFS:
        one = rfm.holdout_split(lines, c, HOLDOUT_END, adjust=False).select(F.lit(c).alias("cutoff"), "customer_id")
        frames = one if frames is None else frames.unionByName(one)
    firsts = lines.groupBy("customer_id").agg(F.min("invoice_date").alias("first_date"))
    return quality.calibration_frames(frames, firsts, CUTOFFS)


# ------------------------------------------------------------------ reports

@query("o1_executive_kpis", f"""WITH {STG}, {DIM_CUSTOMERS}
  SELECT (SELECT count(*) FROM dim_customers) AS total_customers,
  (SELECT count(DISTINCT invoice_no) FROM stg WHERE NOT is_return) AS total_orders,
  {rnd('(SELECT sum(line_total) FROM stg WHERE NOT is_return)')} AS gross_revenue,
  {rnd('(SELECT sum(total_spend) FROM dim_customers)')} AS net_revenue,
  {rnd('(SELECT sum(abs(line_total)) FROM stg WHERE is_return)')} AS returns_value""")
def o1(f):
    stg = f.stg()
    return reporting.executive_kpis(warehouse.order_lines(stg), warehouse.return_lines(stg), f.dim_customers())


@query("o2_monthly_revenue", f"""WITH {LINES} SELECT CAST(date_trunc('month', invoice_date) AS TIMESTAMP) AS month,
  {rnd('sum(line_total)')} AS monthly_revenue, count(DISTINCT invoice_no) AS order_count FROM lines
  WHERE invoice_date < TIMESTAMP '{MONTH_END}' GROUP BY 1""")
def o2(f):
    return reporting.monthly_revenue(f.lines(), MONTH_END)


@query("o3_top_countries", f"""WITH {STG}, {DIM_CUSTOMERS} SELECT country, count(customer_id) AS customer_count,
  {rnd('sum(total_spend)')} AS total_spend FROM dim_customers GROUP BY country
  ORDER BY customer_count DESC, country LIMIT 8""")
def o3(f):
    return reporting.top_countries(f.dim_customers())
