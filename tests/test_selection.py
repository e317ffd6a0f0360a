import random

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import selection
from tallyfield.functions.selection import rows_at_ranks
from tallyfield.sources.transactions import stratified_sample


@pytest.mark.parametrize("bits,draws", [(32, 1 << 32), (52, 1 << 52), (8, 6)])
def test_rows_at_ranks_match_a_sort(spark, bits, draws):
    """Few draws mean many ties; a hot row has hundreds of copies; some ranks lie beyond their group."""
    rng = random.Random(bits)
    rows = [(rng.choice("ab"), rng.randrange(draws), rng.randrange(40)) for _ in range(900)]
    rows += [("a", rows[5][1], 7)] * 400
    df = spark.createDataFrame(rows, "g string, d long, x int").repartition(5)
    ranks = [(g, r) for g in "ab" for r in (1, 2, 57, 300, 301, 302, 5000)]
    got = rows_at_ranks(df, ["g"], "d", bits, ["x"], spark.createDataFrame(ranks, "g string, rank long")).collect()
    order = {g: sorted((d, x) for h, d, x in rows if h == g) for g in "ab"}
    want = sorted((g, *order[g][r - 1], r) for g, r in ranks if r <= len(order[g]))
    assert sorted((r["g"], r["d"], r["x"], r["rank"]) for r in got) == want


def lines(spark, n):
    return spark.range(n).select(
        (F.col("id") % 997).cast("string").alias("Invoice"), (F.col("id") % 13).cast("string").alias("StockCode"), F.lit("d").alias("Description"),
        F.when(F.col("id") % 11 == 0, -1).otherwise(1).alias("Quantity"), F.lit("2020-01-01").cast("timestamp_ntz").alias("InvoiceDate"),
        (F.col("id") % 7).cast("double").alias("Price"), F.col("id").alias("Customer ID"), F.concat(F.lit("C"), F.col("id") % 14).alias("Country"))


def test_sample_sizes_and_strata(spark):
    raw = lines(spark, 6000)
    for size in (10, 500, 5999, 7000):
        out = stratified_sample(raw, size, ["Invoice", "StockCode", "Quantity"], ["Price"])
        assert out.columns == raw.columns and out.count() == min(size, 6000)
        assert out.distinct().count() == out.count() and out.exceptAll(raw).isEmpty()
    again = stratified_sample(raw.repartition(7), 500, ["Invoice", "StockCode", "Quantity"], ["Price"])
    keys = ["Invoice", "StockCode", "Quantity", "Price"]
    assert again.select(*keys).exceptAll(stratified_sample(raw, 500, ["Invoice", "StockCode", "Quantity"], ["Price"]).select(*keys)).isEmpty()


def test_selection_never_sorts_the_lines(spark, monkeypatch):
    """Outside the last prefixes the lines are only scanned, filtered and counted."""
    sizes = []
    stored = selection.stored
    monkeypatch.setattr(selection, "stored", lambda df, name="t": sizes.append((name, (out := stored(df, name)).count())) or out)
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("d"), "id")
    got = rows_at_ranks(df, ["g"], "d", 32, ["id"], spark.createDataFrame([("g", 77_777)], "g string, rank long"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 1 and "RepartitionByExpression" not in plan
    assert all(n <= 1 for _, n in sizes)
