"""Raw lines to staging, intermediate and star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyfield.functions.numeric import any_of, money_sum, ratio, round_half, week_of
from tallyfield.functions.ordering import with_row_number

MONEY = 2


def stg_orders(raw: DataFrame) -> DataFrame:
    """Typed lines with a customer and a positive price; returns kept as rows and flagged."""
    quantity = F.col("Quantity").cast("int")
    returned = F.col("Invoice").cast("string").like("C%") | (quantity < 0)
    return (raw
            .where(F.col("`Customer ID`").isNotNull() & (F.col("Price") > 0))
            .select(
                F.col("Invoice").cast("string").alias("invoice_no"),
                F.col("StockCode").cast("string").alias("stock_code"),
                F.trim(F.col("Description").cast("string")).alias("description"),
                quantity.alias("quantity"),
                F.col("InvoiceDate").cast("timestamp_ntz").alias("invoice_date"),
                F.col("Price").cast("double").alias("unit_price"),
                F.col("`Customer ID`").cast("bigint").alias("customer_id"),
                F.col("Country").cast("string").alias("country"),
                (F.col("Quantity").cast("double") * F.col("Price").cast("double")).alias("line_total"),
                F.coalesce(returned, F.lit(False)).alias("is_cancelled"),
                F.coalesce(returned, F.lit(False)).alias("is_return"),
            ))


def largest_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """MAX of a text column per key, over the distinct pairs.

    A text maximum cannot live in a hash-aggregation buffer, so asking for it next to other aggregates
    makes Spark sort every line. Distinct pairs collapse map-side first; only they are sorted.
    """
    return df.select(key, column).distinct().groupBy(key).agg(F.max(column).alias(column))


def stg_customers(stg: DataFrame) -> DataFrame:
    pairs = stg.groupBy("customer_id", "country").agg(F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi"))
    return pairs.groupBy("customer_id").agg(
        F.max("country").alias("country"),
        F.min("lo").alias("first_order_date"),
        F.max("hi").alias("last_order_date"))


def int_orders(stg: DataFrame) -> DataFrame:
    """Lines with a dense surrogate key in (date, customer, stock code) order.

    Ties are broken by the remaining columns, and copies of a line by a salt, so that one range shuffle places every row and neither a
    hot day nor a hot group of copies lands in one task.
    """
    cols = ["invoice_date", "customer_id", "stock_code",
            *[c for c in stg.columns if c not in ("invoice_date", "customer_id", "stock_code")]]
    salted = stg.withColumn("__salt", F.monotonically_increasing_id())
    # a line is as wide as a row gets here: staged lines are counted, which reads no column of a stored table, so that no task sorts more than fits
    numbered = with_row_number(salted, [*cols, "__salt"], out="transaction_id", rows=stg.count())
    return numbered.select(
        "transaction_id", "invoice_no", "stock_code", "description", "customer_id", "invoice_date", "quantity", "unit_price",
        "line_total", "country", "is_cancelled", "is_return",
        F.when(~F.col("is_return"), F.col("line_total")).otherwise(F.lit(0.0)).alias("gross_line_total"),
        F.when(F.col("is_return"), F.abs("line_total")).otherwise(F.lit(0.0)).alias("return_line_total"))


def fact_orders(int_orders_df: DataFrame) -> DataFrame:
    return int_orders_df.where(~F.col("is_return")).select(
        F.col("transaction_id").alias("order_id"), "invoice_no", "stock_code", "customer_id", "invoice_date",
        "quantity", "unit_price", "line_total", "country", "is_cancelled", "is_return")


def fact_returns(int_orders_df: DataFrame) -> DataFrame:
    return int_orders_df.where(F.col("is_return")).select(
        F.col("transaction_id").alias("return_id"), "invoice_no", "stock_code", "customer_id", "invoice_date",
        F.abs("quantity").alias("quantity_returned"), "unit_price", F.abs("line_total").alias("return_amount"),
        "country", "is_cancelled", "is_return")


def order_lines(stg: DataFrame) -> DataFrame:
    """Non-return lines without the surrogate key: what every downstream aggregate of fact_orders needs."""
    return stg.where(~F.col("is_return"))


def return_lines(stg: DataFrame) -> DataFrame:
    return stg.where(F.col("is_return"))


def order_grain(lines: DataFrame, *extra_keys: str) -> DataFrame:
    return lines.groupBy("customer_id", "invoice_no", *extra_keys).agg(
        F.min("invoice_date").alias("order_date"), money_sum("line_total").alias("order_value"))


def customer_rfm(stg: DataFrame) -> DataFrame:
    """Frequency, recency, age and monetary value per customer over the whole table.

    Age runs to the last date of all lines, returns included; the repeat value leaves out the smallest order.
    """
    # a literal, not a subquery: age feeds Python scoring functions, whose inputs cannot hold a subquery
    last = stg.agg(F.max("invoice_date")).first()[0]
    end = F.lit(None if last is None else last.isoformat(sep=" ")).cast("timestamp_ntz")
    return rfm_from_orders(order_grain(order_lines(stg)), end)


def rfm_from_orders(orders: DataFrame, end) -> DataFrame:
    per = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.min("order_date").alias("__first"), F.max("order_date").alias("__last"),
        money_sum("order_value").alias("__sum"), F.min("order_value").alias("__min"))
    recency = F.greatest(F.lit(0.0), F.date_diff("__last", "__first").cast("double"))
    age = F.date_diff(end, F.col("__first")).cast("double")
    n = F.col("total_orders")
    repeat = F.when(n > 1, (F.col("__sum") - F.col("__min")) / (n - 1)).otherwise(F.lit(0.0))
    return per.select(
        "customer_id",
        (n - 1).alias("frequency"),
        recency.alias("recency"),
        F.greatest(age, recency).alias("T"),
        round_half(F.col("__sum") / n, MONEY).alias("monetary_value"),
        round_half(repeat, MONEY).alias("monetary_value_repeat"),
        n.alias("total_orders"),
        round_half("__sum", MONEY).alias("total_monetary"))


def customer_week_panel(stg: DataFrame, home_country: str = "United Kingdom", post_from: str = "2010-06-01") -> DataFrame:
    """Sparse customer x country x week table, net of returns."""
    return (stg.withColumn("week_date", week_of("invoice_date").cast("timestamp_ntz"))
            .groupBy("customer_id", "country", "week_date")
            .agg(money_sum("line_total").alias("weekly_spend"),
                 F.count_distinct("invoice_no").alias("weekly_orders"),
                 F.sum("quantity").cast("bigint").alias("weekly_items"))
            .withColumn("is_treated_cohort", F.when(F.col("country") != home_country, 1).otherwise(0))
            .withColumn("is_post_period",
                        F.when(F.col("week_date") >= F.lit(post_from).cast("timestamp_ntz"), 1).otherwise(0)))


def dim_customers(stg: DataFrame) -> DataFrame:
    """Customer dimension. Counting invoices at invoice grain first replaces two distinct counts
    (and the row expansion they cost) by plain sums, and spreads a hot customer over its invoices.
    Only the two flags go to that grain: the sums, ten times as wide, are shuffled once, one row per customer and task.
    All sides of the joins are already partitioned by customer."""
    q, amount = F.col("quantity"), F.col("line_total")
    invoices = (stg.groupBy("customer_id", "invoice_no")
                .agg(any_of(~F.col("is_return")).alias("bought"), any_of(F.col("is_return")).alias("returned"))
                .groupBy("customer_id").agg(F.sum("bought").alias("total_orders"), F.sum("returned").alias("total_return_orders")))
    per = stg.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_purchase_date"), F.max("invoice_date").alias("last_purchase_date"),
        F.sum(F.when(q > 0, q).otherwise(0)).alias("total_items_purchased"),
        F.sum(F.when(q < 0, F.abs(q)).otherwise(0)).alias("total_items_returned"),
        money_sum(F.when(q > 0, amount).otherwise(0.0)).alias("__gross"),
        money_sum(F.when(q < 0, F.abs(amount)).otherwise(0.0)).alias("__refund"),
        money_sum(amount).alias("__net"),
        F.count(F.when(q > 0, amount)).alias("__lines"))
    return per.join(invoices, "customer_id").join(largest_text(stg, "customer_id", "country"), "customer_id").select(
        "customer_id", "country", "first_purchase_date", "last_purchase_date",
        "total_orders", "total_return_orders", "total_items_purchased", "total_items_returned",
        round_half("__gross", MONEY).alias("gross_spend"), round_half("__refund", MONEY).alias("return_spend"),
        round_half("__net", MONEY).alias("total_spend"),
        round_half(ratio("__gross", "__lines"), MONEY).alias("avg_line_item_value"),
        round_half(ratio("__net", "total_orders"), MONEY).alias("avg_order_value"))


def dim_products(stg: DataFrame) -> DataFrame:
    """Product dimension. As for customers, only what counts invoices goes to the grain of product and invoice, where most lines stay rows of
    their own; the sums are shuffled once."""
    invoices = (stg.groupBy(F.col("stock_code").alias("__bought"), "invoice_no").agg(any_of(~F.col("is_return")).alias("bought"))
                .groupBy("__bought").agg(F.sum("bought").alias("total_orders")))
    per = stg.groupBy("stock_code").agg(
        round_half(ratio(money_sum("unit_price"), F.count("unit_price")), MONEY).alias("avg_unit_price"),
        F.sum("quantity").alias("total_quantity_sold"),
        round_half(money_sum("line_total"), MONEY).alias("total_revenue"))
    names = largest_text(stg, "stock_code", "description").withColumnRenamed("stock_code", "__code")
    # null-safe: lines without a stock code form a product of their own
    per = per.join(invoices, F.col("stock_code").eqNullSafe(F.col("__bought")))
    return per.join(names, F.col("stock_code").eqNullSafe(F.col("__code"))).select(
        "stock_code", "description", "avg_unit_price", "total_orders", "total_quantity_sold", "total_revenue")
