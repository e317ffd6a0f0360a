import datetime
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import raw_lines
from tallyfield.functions import durable, ordering
from tallyfield.functions.durable import stored
from tallyfield.operators import quality, reporting, rfm, warehouse
from tallyfield.plans import frames
from tallyfield.sources import tables, transactions


@pytest.fixture(scope="module")
def raw(spark):
    return raw_lines(spark).cache()


@pytest.fixture(scope="module")
def stg(raw):
    return warehouse.stg_orders(raw).cache()


def test_line_numbers_are_sorted_in_pieces_that_fit(spark, monkeypatch):
    """The number of ranges follows the number of lines, not the session's fixed number of partitions; the numbers stay dense and ordered."""
    monkeypatch.setattr(ordering, "SORTED_ROWS", 10)
    seen = []
    monkeypatch.setattr(ordering, "stored", lambda df, name="table": seen.append(df) or stored(df, name))
    lines = spark.range(200).select(
        F.concat(F.lit("i"), "id").alias("invoice_no"), F.lit("s").alias("stock_code"), F.lit(None).cast("string").alias("description"), F.lit(1).alias("quantity"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("invoice_date"), F.lit(1.0).alias("unit_price"), F.lit(7).cast("bigint").alias("customer_id"),
        F.lit("x").alias("country"), F.lit(1.0).alias("line_total"), F.lit(False).alias("is_cancelled"), F.lit(False).alias("is_return"))
    rows = warehouse.int_orders(lines).orderBy("transaction_id").collect()
    assert [r["transaction_id"] for r in rows] == list(range(1, 201))
    assert [r["invoice_no"] for r in rows] == sorted(r["invoice_no"] for r in rows)
    assert seen[0].rdd.getNumPartitions() >= 15


def test_storing_a_table_leaves_no_shuffle_on_disk(spark):
    """A stored table is read back from its file, so nothing of the shuffles that made it may stay, and the caller's setting does."""
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}
    before = kept()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    table = stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count().repartitionByRange(3, "k"))
    until = time.time() + 20
    while kept() - before and time.time() < until:
        time.sleep(0.2)
    assert not kept() - before and spark.conf.get(name, "false") == was
    assert table.count() == 700 and table.agg(F.sum("count")).first()[0] == 5000


def test_line_numbers_in_slices_are_those_of_one_piece(spark, monkeypatch):
    """A large table is moved slice by slice of its dates: NULL dates first, a date that most lines share, dates that fall on a cut."""
    lines = spark.range(3000).select(
        F.concat(F.lit("i"), F.col("id") % 40).alias("invoice_no"), (F.col("id") % 7).cast("string").alias("stock_code"), F.lit(None).cast("string").alias("description"),
        (F.col("id") % 3).cast("int").alias("quantity"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 2 == 0, F.lit("2020-02-03")).otherwise(
            F.concat(F.lit("2020-02-0"), F.col("id") % 5 + 1, F.lit(" 10:00:00.00000"), F.col("id") % 3)).cast("timestamp_ntz").alias("invoice_date"),
        F.lit(1.0).alias("unit_price"), (F.col("id") % 13).alias("customer_id"), F.lit("x").alias("country"), F.col("id").cast("double").alias("line_total"),
        F.lit(False).alias("is_cancelled"), F.lit(False).alias("is_return"))
    whole = sorted(map(tuple, warehouse.int_orders(lines).collect()))
    written = []
    monkeypatch.setattr(durable, "SHUFFLED_ROWS", 400)
    monkeypatch.setattr(ordering, "stored", lambda df, name="table", *more: written.extend([df, *more]) or stored(df, name, *more))
    assert sorted(map(tuple, warehouse.int_orders(lines).collect())) == whole
    assert [r[0] for r in whole] == list(range(1, 3001))
    sizes = [w.count() for w in written]
    assert len(sizes) > 3 and sum(sizes) == 3000 and max(sizes) < 1600
    undated = lines.withColumn("invoice_date", F.lit(None).cast("timestamp_ntz"))
    assert sorted(r[0] for r in warehouse.int_orders(undated).collect()) == list(range(1, 3001))


def test_staged_in_slices_of_orders(spark, monkeypatch, tmp_path):
    """Every line is staged once, also one without an order key, without its order or part, and one whose order comes twice."""
    def put(name, rows):
        spark.createDataFrame(rows, transactions.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    day = datetime.datetime(2020, 1, 1)
    put("nation", [(0, "N0", 0), (1, "N1", 0)])
    put("customer", [(c, "c", c % 3, 0.0, "m") for c in range(9)])
    put("part", [(p, f"p{p}", "b", "t", 1, 1.0) for p in range(6)])
    put("orders", [(o, o % 10, "F", 1.0, day + datetime.timedelta(days=o % 17), "1") for o in [*range(60), 3]])
    put("lineitem", [(None if i % 50 == 0 else i % 70, None if i % 31 == 0 else i % 8, 1, 1, float(i % 5 + 1), float(i + 1), 0.0, 0.0,
                      (None, "R", "N")[i % 3], "O", day) for i in range(400)])
    found = []
    for rows in (1000, 100):
        monkeypatch.setattr(durable, "SHUFFLED_ROWS", rows)
        monkeypatch.setattr(frames, "_MARTS", {})
        staged = frames.Frames(spark, str(tmp_path)).stg()
        found.append(sorted(map(str, staged.collect())))
        assert len(found[-1]) == warehouse.stg_orders(transactions.adapt_orders(spark, str(tmp_path))).count()
    assert found[0] == found[1]


def test_dimensions_count_an_invoice_once(spark):
    """Sums come from the lines and counts from the invoices, whatever an invoice repeats; without a stock code, a product of its own."""
    rows = [(None if i % 9 == 0 else f"{'C' if i % 4 == 0 else ''}{i % 12}", None if i % 7 == 0 else f"s{i % 5}", f"d{i % 3}", None if i % 10 == 0 else (-1 if i % 4 == 0 else i % 6),
             datetime.datetime(2020, 1, 1 + i % 28), i / 3, i % 4, f"c{i % 2}", None if i % 13 == 0 else i / 7, i % 4 == 0, i % 4 == 0) for i in range(200)]
    names = ["invoice_no", "stock_code", "description", "quantity", "invoice_date", "unit_price", "customer_id", "country", "line_total", "is_cancelled", "is_return"]
    lines = spark.createDataFrame(rows, "invoice_no string, stock_code string, description string, quantity int, invoice_date timestamp_ntz, unit_price double, "
                                  "customer_id bigint, country string, line_total double, is_cancelled boolean, is_return boolean").repartition(5)
    pdf = pd.DataFrame(rows, columns=names)
    got = {r["customer_id"]: r for r in warehouse.dim_customers(lines).collect()}
    assert set(got) == set(pdf["customer_id"])
    for c, own in pdf.groupby("customer_id"):
        assert got[c]["total_orders"] == own[~own["is_return"]]["invoice_no"].nunique(dropna=False)
        assert got[c]["total_return_orders"] == own[own["is_return"]]["invoice_no"].nunique(dropna=False)
        assert got[c]["total_items_purchased"] == own["quantity"].clip(lower=0).sum() and got[c]["total_items_returned"] == -own["quantity"].clip(upper=0).sum()
        assert got[c]["total_spend"] == pytest.approx(own["line_total"].sum(), abs=0.006)
        assert got[c]["last_purchase_date"] == own["invoice_date"].max() and got[c]["country"] == own["country"].max()
    goods = {r["stock_code"]: r for r in warehouse.dim_products(lines).collect()}
    for s, own in pdf.groupby("stock_code", dropna=False):
        r = goods[None if pd.isna(s) else s]
        assert r["total_orders"] == own[~own["is_return"]]["invoice_no"].nunique(dropna=False)
        assert r["total_quantity_sold"] == own["quantity"].sum() and r["avg_unit_price"] == pytest.approx(own["unit_price"].mean(), abs=0.006)
    assert len(goods) == pdf["stock_code"].nunique(dropna=False)


def test_staging_drops_and_flags(stg):
    rows = {(r["invoice_no"], r["stock_code"]): r for r in stg.collect()}
    assert ("7", "A") not in rows and ("8", "A") not in rows
    assert rows[("C4", "B")]["is_return"] and rows[("C3", "A")]["is_return"] and not rows[("1", "A")]["is_return"]
    assert rows[("1", "A")]["description"] == "mug" and rows[("1", "A")]["line_total"] == 10.0


def test_surrogate_key_is_dense_and_ordered(stg):
    got = warehouse.int_orders(stg).orderBy("transaction_id").collect()
    assert [r["transaction_id"] for r in got] == list(range(1, stg.count() + 1))
    keys = [(r["invoice_date"], r["customer_id"], r["stock_code"]) for r in got]
    assert keys == sorted(keys)


def test_facts_split_the_lines(stg):
    io = warehouse.int_orders(stg)
    orders, returns = warehouse.fact_orders(io), warehouse.fact_returns(io)
    assert orders.count() + returns.count() == stg.count()
    assert returns.where("quantity_returned < 0 or return_amount < 0").count() == 0


def test_dim_customers_uses_quantity_sign_for_spend(stg):
    one = warehouse.dim_customers(stg).where("customer_id = 1").first()
    # the C invoice with a positive quantity counts as gross spend but as a return order
    assert one["gross_spend"] == 14.0 + 15.0 + 8.0 and one["return_spend"] == 5.0
    assert one["total_orders"] == 2 and one["total_return_orders"] == 2
    assert one["total_spend"] == 32.0 and one["avg_order_value"] == 16.0
    only_returns = warehouse.dim_customers(stg).where("customer_id = 4").first()
    assert only_returns["total_orders"] == 0 and only_returns["avg_order_value"] is None


def test_rfm_ends_at_last_line_including_returns(stg):
    r = {x["customer_id"]: x for x in warehouse.customer_rfm(stg).collect()}
    assert set(r) == {1, 2, 3}
    assert r[3]["T"] == 12.0  # 2010-03-20 to the return of 2010-04-01
    assert r[1]["frequency"] == 1 and r[1]["recency"] == 28.0
    assert r[1]["monetary_value"] == 14.5 and r[1]["monetary_value_repeat"] == 15.0  # the smallest order is left out


def test_cutoff_is_midnight(stg):
    lines = warehouse.order_lines(stg)
    split = {x["customer_id"]: x for x in rfm.holdout_split(lines, "2010-03-01", "2010-03-20").collect()}
    assert split[2]["total_orders"] == 1 and split[2]["actual_holdout_purchases"] == 1
    assert split[2]["actual_holdout_spend"] == 20.0
    assert split[1]["actual_holdout_purchases"] == 0 and split[1]["actual_holdout_spend"] == 0.0
    assert 3 not in split and split[1]["holdout_duration_days"] == 19


def test_early_cutoff_moves_to_midpoint(stg):
    lines = warehouse.order_lines(stg)
    assert rfm.effective_cutoff(lines, "2000-01-01") == "2010-02-10"
    assert rfm.effective_cutoff(lines, "2010-02-01") == "2010-02-01"


def test_quality_report_passes_and_fails(stg, raw):
    io = warehouse.int_orders(stg)
    report = quality.star_schema_report(
        stg, warehouse.stg_customers(stg), io, warehouse.dim_customers(stg), warehouse.dim_products(stg),
        warehouse.fact_orders(io), warehouse.fact_returns(io))
    assert quality.report_summary(report).first()["failed_checks"] == 0
    quality.require_clean(report)
    broken = warehouse.dim_customers(stg).where("customer_id <> 3")
    assert quality.orphan_count(warehouse.fact_orders(io), "customer_id", broken).first()[0] == 2
    assert quality.orphans(warehouse.fact_orders(io), "customer_id", broken).count() == 2
    bad = quality.union_reports([quality.check_row("relationships", "t", "c", quality.orphans(stg, "customer_id", broken))])
    with pytest.raises(quality.QualityError):
        quality.require_clean(bad)


def test_reconciliation_and_reports(stg):
    rec = quality.revenue_reconciliation(warehouse.order_lines(stg), warehouse.return_lines(stg), warehouse.dim_customers(stg)).first()
    assert rec["dim_difference"] == 0.0
    kpi = reporting.executive_kpis(warehouse.order_lines(stg), warehouse.return_lines(stg), warehouse.dim_customers(stg)).first()
    assert kpi["total_customers"] == 4 and kpi["total_orders"] == 5
    months = reporting.monthly_revenue(warehouse.order_lines(stg), "2010-03-01").collect()
    assert [m["month"].month for m in months] == [1, 2]


def test_validity_and_errors_on_bad_scores(spark):
    df = spark.createDataFrame([(0, 1.0), (0, float("nan")), (2, -1.0), (3, float("inf"))], "frequency long, v double")
    out = {r["stratum"]: r for r in quality.prediction_validity(df, "v").collect()}
    assert (out["all"]["nan_count"], out["all"]["inf_count"], out["all"]["negative_count"]) == (1, 1, 1)
    assert out["f0"]["nan_count"] == 1 and out["fpos"]["negative_count"] == 1
    with pytest.raises(quality.QualityError):
        quality.require_valid(df, ["v"])


def test_ingest_coercion_and_errors(spark, raw, tmp_path):
    names = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "CustomerID", "Country"]
    good = spark.createDataFrame([("1", "A", "x", "2", "2010-01-01 00:00:00", "oops", "12.0", "UK"),
                                  ("2", "A", "x", "-1", "2010-01-02 00:00:00", "3.5", "n/a", "UK")], ", ".join(f"{n} string" for n in names))
    rows = transactions.union_parts([good, good]).orderBy("Invoice").collect()
    assert len(rows) == 4 and rows[0]["Price"] == 0.0 and rows[0]["Customer ID"] == 12 and rows[2]["Customer ID"] is None
    bad = good.withColumn("Quantity", F.lit("two"))
    with pytest.raises(transactions.IngestError):
        transactions.union_parts([good, bad])
    path = tables.write_csv(raw, str(tmp_path / "part"))
    assert transactions.read_parts(spark, [path, path], "csv").count() == 2 * raw.count()


@pytest.mark.parametrize("size", [1, 4, 9, 12, 50])
def test_sample_has_exact_size(raw, size):
    got = transactions.stratified_sample(raw, size, ["Invoice", "StockCode", "Quantity"], ["Price"], top=1)
    assert got.count() == min(size, raw.count())
    assert got.exceptAll(raw).count() == 0


def test_stored_tables_and_gate(spark, stg, tmp_path):
    root = str(tmp_path)
    calls = []

    def build():
        calls.append(1)
        return stg.select("customer_id").distinct()
    for force in (False, False, True):
        tables.read_or_compute(spark, f"{root}/cache", build, force).count()
    assert len(calls) == 2
    stg.createOrReplaceTempView("stg_view")
    sizes = tables.export_tables(spark, ["stg_view", "absent"], f"{root}/out")
    assert sizes["absent"] is None and sizes["stg_view"] > 0
    assert tables.register_directory(spark, f"{root}/out") == ["stg_view"]
    with pytest.raises(ValueError):
        tables.export_tables(spark, ["stg_view"], f"{root}/out2", max_bytes=10)
    good = {"source_script": "job", "panel_row_count": "5", "code_version": "abcdef1", "assignment_mode": "random"}

    def record(**changes):
        return spark.createDataFrame(list({**good, **changes}.items()), "metric string, value string")
    assert tables.verify_record(record(), "random", 5, "job")["code_version"] == "abcdef1"
    for change in ({"panel_row_count": "6"}, {"code_version": "unknown_commit"}, {"source_script": "x"},
                   {"assignment_mode": "confounded"}, {"note": "from test_synthetic run"}):
        with pytest.raises(tables.ProvenanceError):
            tables.verify_record(record(**change), "random", 5, "job")
