"""Transaction lines: reading parts, coercion, profile, stratified sample, adapter for the test tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyfield.functions.durable import stored
from tallyfield.functions.numeric import hash_uniform, ratio
from tallyfield.functions.selection import rows_at_ranks

# fixed values: columns of a transaction line
RAW_COLUMNS = ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country")
# fixed values: accepted spellings of the columns in other exports
COLUMN_VARIANTS = {
    "Invoice": ("Invoice", "invoice_no", "InvoiceNo"),
    "StockCode": ("StockCode", "stock_code"),
    "Description": ("Description", "description"),
    "Quantity": ("Quantity", "quantity"),
    "InvoiceDate": ("InvoiceDate", "invoice_date"),
    "Price": ("Price", "price", "unit_price", "UnitPrice"),
    "Customer ID": ("Customer ID", "customer_id", "CustomerID"),
    "Country": ("Country", "country"),
}


RANKS_PER_ROW = 1_000_000  # ranks that one row is unfolded to at once


class IngestError(ValueError):
    pass


def resolve_columns(df: DataFrame, variants: dict[str, Sequence[str]] = COLUMN_VARIANTS) -> DataFrame:
    """Rename whichever known spelling is present to the standard column names."""
    present = set(df.columns)
    renames = {}
    for standard, spellings in variants.items():
        found = next((s for s in spellings if s in present), None)
        if found is None:
            raise IngestError(f"no column for {standard!r}; looked for {list(spellings)}")
        if found != standard:
            renames[found] = standard
    return df.withColumnsRenamed(renames)


def coerce(raw: DataFrame) -> DataFrame:
    """Typed lines. A quantity that does not parse stays visible in ``bad_quantity``; a bad price becomes
    0.0, a bad customer id becomes NULL."""
    text = {c: F.col(f"`{c}`").cast("string") for c in RAW_COLUMNS}
    quantity = text["Quantity"].try_cast("double")
    return raw.select(
        text["Invoice"].alias("Invoice"),
        text["StockCode"].alias("StockCode"),
        text["Description"].alias("Description"),
        quantity.cast("int").alias("Quantity"),
        text["InvoiceDate"].try_cast("timestamp_ntz").alias("InvoiceDate"),
        F.coalesce(text["Price"].try_cast("double"), F.lit(0.0)).alias("Price"),
        text["Customer ID"].try_cast("double").cast("bigint").alias("Customer ID"),
        text["Country"].alias("Country"),
        quantity.isNull().alias("bad_quantity"),
    )


def union_parts(parts: Iterable[DataFrame], check: bool = True) -> DataFrame:
    """All parts (sheets, files, folders) concatenated with duplicates kept, then coerced.

    With ``check`` an unparseable quantity is an error, found by one counting pass.
    """
    merged = None
    for part in parts:
        part = resolve_columns(part).select(*[f"`{c}`" for c in RAW_COLUMNS])
        part = part.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in RAW_COLUMNS])
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise IngestError("no input parts")
    typed = coerce(merged)
    if check:
        bad = typed.where("bad_quantity").count()
        if bad:
            raise IngestError(f"{bad} rows with an unparseable quantity")
    return typed.drop("bad_quantity")


def read_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", check: bool = True) -> DataFrame:
    """Read every part (``parquet`` or ``csv`` with a header) and union them."""
    frames = []
    for path in paths:
        if fmt == "csv":
            # all columns as text: a value that does not parse must be seen by coerce, not dropped by the reader
            frames.append(spark.read.option("header", True).option("multiLine", False)
                          .option("escape", '"').csv(path))
        else:
            frames.append(spark.read.format(fmt).load(path))
    return union_parts(frames, check)


def ingest_profile(raw: DataFrame) -> DataFrame:
    """One row: line count, date range, distinct customers, average order value.

    Two narrow distinct passes; a single aggregate with two distinct counts would expand every line.
    """
    invoices = raw.groupBy("Invoice").agg(
        F.count(F.lit(1)).alias("lines"), F.min("InvoiceDate").alias("lo"), F.max("InvoiceDate").alias("hi"),
        F.sum(F.col("Quantity") * F.col("Price")).alias("value"))
    customers = (raw.select(F.col("`Customer ID`").alias("c")).where(F.col("c").isNotNull()).distinct()
                 .agg(F.count(F.lit(1)).alias("n")))
    return invoices.agg(
        F.sum("lines").alias("row_count"), F.min("lo").alias("min_date"), F.max("hi").alias("max_date"),
        ratio(F.sum("value"), F.count("Invoice")).alias("avg_order_value"),
    ).withColumn("unique_customers", customers.scalar())


def stratified_sample(lines: DataFrame, size: int, keys: Sequence[str], tie_break: Sequence[str] = (),
                      seed: int = 42, top: int = 10, country: str = "Country", quantity: str = "Quantity",
                      date: str = "InvoiceDate") -> DataFrame:
    """Exactly ``min(size, rows)`` rows, proportional over (top countries or 'Other') x (return or not).

    Draws are hashes of ``keys``; ``tie_break`` orders rows that share them. Rows equal in both are
    interchangeable, so the result is a fixed multiset whatever the partitioning.
    """
    counts = lines.groupBy(F.col(country).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    leading = counts.orderBy(F.desc("__n"), "__c").limit(top).select("__c", F.lit(True).alias("__top"))
    # at most `top` rows by construction, so this broadcast is bounded
    marked = (lines.join(F.broadcast(leading), F.col(country) == F.col("__c"), "left")
              .withColumn("__stratum", F.concat_ws(
                  "_", F.when(F.col("__top"), F.col(country)).otherwise(F.lit("Other")),
                  (F.col(quantity) < 0).cast("int").cast("string")))
              .drop("__c", "__top")
              .withColumn("__u", hash_uniform(*[F.col(f"`{k}`") for k in keys], F.lit(seed))))
    marked = marked.withColumn("__draw", (F.col("__u") * F.lit(4294967296.0)).cast("bigint")).drop("__u")
    # one row for each stratum: at most two for each top country and two for the rest
    sizes = marked.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__n"))
    share = F.col("__n") / F.sum("__n").over(Window.partitionBy()) * F.lit(float(size))
    quotas = stored(sizes.withColumn("__q", F.least(F.greatest(F.rint(share), F.lit(1.0)), F.col("__n").cast("double")).cast("bigint")), "quotas")
    inside = quotas.agg(F.coalesce(F.sum("__q"), F.lit(0))).first()[0]
    # trim or top up by a second draw that depends on stratum and rank alone, so it needs no line
    second = hash_uniform(F.col("__stratum"), F.col("__rn"), F.lit(seed + 1))
    wanted = quotas.select("__stratum", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__q"))).alias("__rn"))
    if inside >= size:
        wanted = wanted.withColumn("__v", second).orderBy("__v", "__stratum", "__rn").limit(size).drop("__v")
    else:
        slices = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - F.col("__q") - 1) / RANKS_PER_ROW)))
        rest = quotas.where("__n > __q").withColumn("__s", slices).repartition("__stratum", "__s")
        first = F.col("__q") + F.col("__s") * RANKS_PER_ROW
        rest = rest.select("__stratum", F.explode(F.sequence(first + 1, F.least(first + RANKS_PER_ROW, F.col("__n")))).alias("__rn"))
        wanted = wanted.unionByName(rest.withColumn("__v", second).orderBy("__v", "__stratum", "__rn").limit(size - inside).drop("__v"))
    picked = rows_at_ranks(marked, ["__stratum"], "__draw", 32, [f"`{k}`" for k in (*keys, *tie_break)], wanted, "__rn")
    return picked.select(*[F.col(f"`{c}`") for c in lines.columns]).orderBy(date)


# ---------------------------------------------------------------- adapter for the test tables

# fixed values: schemas of the test tables, given so that no footer has to be read for planning
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def adapt_orders(spark: SparkSession, sf_dir: str, description: bool = True, country: bool = True, slice_of: tuple[int, int] = (0, 1)) -> DataFrame:
    """Transaction lines from lineitem/orders (and customer, nation, part only where asked for).

    Lookups are outer joins: a line whose order, customer or part is unknown stays, with NULL in the columns it lacks, whichever lookups are asked for.
    ``slice_of``: (k, n) gives the lines of every n-th order only, by a hash of its key; all n slices together are the lines.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", (F.col("l_returnflag") == "R").alias("returned"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if slice_of[1] > 1:
        line, orders = (t.where(F.pmod(F.xxhash64(key), F.lit(slice_of[1])) == F.lit(slice_of[0]))
                        for t, key in ((line, "l_orderkey"), (orders, "o_orderkey")))
    if country:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        # attach the country to the order before the large join: one row per order instead of one per line
        orders = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
                  .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if description:
        joined = joined.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"),
                             F.col("l_partkey") == F.col("p_partkey"), "left")
    returned = F.col("returned")
    return joined.select(
        F.concat(F.when(returned, F.lit("C")).otherwise(F.lit("")), F.col("l_orderkey").cast("string")).alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        (F.col("p_name") if description else F.lit(None).cast("string")).alias("Description"),
        (F.col("l_quantity").cast("int") * F.when(returned, F.lit(-1)).otherwise(F.lit(1))).alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
        F.col("o_custkey").alias("Customer ID"),
        (F.col("n_name") if country else F.lit(None).cast("string")).alias("Country"),
    )
