"""Raw CSV ingest (A1, E1, N13), sinks and readers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shiplens.sources.raw import RAW_COLUMNS, ingest_rejects, read_raw_csv, typed_order_lines
from shiplens.sources.sinks import read_kpi, summary_value, write_enriched, write_kpi

HEADER = list(RAW_COLUMNS) + ["Customer City"]  # plus a column the job never uses


def _csv(path, rows, encoding="latin-1"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(",".join(HEADER) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def _row(**kw):
    base = {
        "Order Id": "77", "Order Item Id": "1", "order date (DateOrders)": "1/31/2016 21:56",
        "shipping date (DateOrders)": "2/3/2016 21:56", "Order Status": "COMPLETE",
        "Delivery Status": "Advance shipping", "Days for shipping (real)": "3",
        "Days for shipment (scheduled)": "4", "Late_delivery_risk": "0",
        "Shipping Mode": "Standard Class", "Order Region": "Canada", "Market": "USCA",
        "Customer Segment": "Corporate", "Category Name": "Cleats", "Order Item Quantity": "2",
        "Sales": "99.5", "Customer City": "Montréal",
    }
    base.update(kw)
    return [base[h] for h in HEADER]


def test_latin1_csv_is_typed_and_pruned(spark, tmp_out):
    path = os.path.join(tmp_out, "raw.csv")
    _csv(path, [_row(), _row(**{"Order Item Id": "2", "Category Name": "Pêche"})])
    raw = read_raw_csv(spark, path)
    assert raw.where(F.col("`Category Name`") == "Pêche").count() == 1
    lines = typed_order_lines(raw)
    r = lines.orderBy("line_key").first()
    assert r.order_id == 77 and r.real_days == 3 and r.qty == 2 and r.sales == 99.5
    assert str(r.order_ts) == "2016-01-31 21:56:00"
    assert dict(lines.dtypes)["order_ts"] == "timestamp_ntz"
    assert "Customer City" not in lines.columns


def test_bad_values_become_null_and_are_counted(spark, tmp_out):
    path = os.path.join(tmp_out, "bad.csv")
    _csv(path, [_row(), _row(**{"Days for shipping (real)": "three",
                                "order date (DateOrders)": "not a date",
                                "Sales": ""})])
    raw = read_raw_csv(spark, path)
    lines = typed_order_lines(raw).collect()
    bad = [r for r in lines if r.real_days is None]
    assert len(bad) == 1 and bad[0].order_ts is None and bad[0].sales is None
    rej = ingest_rejects(raw).first()
    assert rej.raw_rows == 2 and rej.rejected_real_days == 1 and rej.rejected_order_ts == 1
    assert rej.rejected_sales == 0  # empty is missing, not rejected


def test_enriched_sink_partitions_by_month(spark, tmp_out, small_enriched):
    path = os.path.join(tmp_out, "enriched")
    write_enriched(small_enriched, path, files_per_month=2)
    months = [d for d in os.listdir(path) if d.startswith("order_month=")]
    assert len(months) == small_enriched.select("order_month").distinct().count()
    back = spark.read.parquet(path)
    assert back.count() == small_enriched.count()
    one = back.where(F.col("order_month") == "1996-01")
    assert "PartitionFilters: [isnotnull(order_month" in one._jdf.queryExecution().executedPlan().toString()


def test_enriched_sink_rebalanced(spark, tmp_out, small_enriched):
    path = os.path.join(tmp_out, "enriched_rb")
    write_enriched(small_enriched, path)
    assert spark.read.parquet(path).count() == small_enriched.count()


def test_kpi_sink_csv_and_summary_lookup(spark, tmp_out, small_enriched):
    from shiplens.plans import kpis

    path = os.path.join(tmp_out, "summary")
    write_kpi(kpis.topline_summary(small_enriched), path, "csv")
    back = read_kpi(spark, path, "csv", schema="metric string, value string")
    n = spark.range(1).select(summary_value(back, "total_orders", "long").alias("n")).first().n
    assert n == small_enriched.count()


def test_unknown_format_rejected(small_enriched, tmp_out):
    with pytest.raises(ValueError):
        write_kpi(small_enriched.limit(1), os.path.join(tmp_out, "x"), "xlsx")


def test_sized_conf_scales_with_input():
    from shiplens.session import TARGET_PARTITION_BYTES, sized_conf

    small = sized_conf(10 * 1024 ** 2)
    huge = sized_conf(100 * 1024 ** 4)  # 100 TiB
    assert int(small["spark.sql.shuffle.partitions"]) == 8
    assert int(huge["spark.sql.shuffle.partitions"]) == 204_800
    assert int(sized_conf(200 * 1024 ** 4)["spark.sql.shuffle.partitions"]) == 409_600
    assert huge["spark.sql.files.maxPartitionBytes"] == str(TARGET_PARTITION_BYTES)


def test_quoted_fields_with_commas(spark, tmp_out):
    path = os.path.join(tmp_out, "quoted.csv")
    row = _row(**{"Category Name": '"Tennis & Racquet, Pro"', "Customer City": '"Saint-Jean, QC"'})
    _csv(path, [row])
    r = typed_order_lines(read_raw_csv(spark, path)).first()
    assert r.category_name == "Tennis & Racquet, Pro" and r.sales == 99.5 and r.qty == 2


def _write(path, header, rows):
    with open(path, "w", encoding="latin-1", newline="") as f:
        f.write(",".join(header) + "\n")
        f.writelines(",".join(r) + "\n" for r in rows)


def test_doubled_quotes_and_quoted_line_breaks(spark, tmp_out):
    path = os.path.join(tmp_out, "quotes.csv")
    _csv(path, [_row(**{"Category Name": '"x ""6, in"" y"'}), _row(**{"Order Item Id": "2", "Category Name": '"two\nlines"'})])
    got = {r.line_key: r for r in typed_order_lines(read_raw_csv(spark, path, multi_line=True)).collect()}
    assert got["1"].category_name == 'x "6, in" y' and got["2"].category_name == "two\nlines"
    assert all(r.sales == 99.5 for r in got.values()) and len(got) == 2


def test_rows_of_another_width_are_counted_not_read(spark, tmp_out):
    path = os.path.join(tmp_out, "wide.csv")
    _csv(path, [_row(), _row(**{"Order Item Id": "2"})[:-3], _row(**{"Order Item Id": "3"}) + ["extra"]])
    raw = read_raw_csv(spark, path)
    assert [r.line_key for r in typed_order_lines(raw).collect()] == ["1"]
    rej = ingest_rejects(raw).first()
    assert (rej.raw_rows, rej.malformed_rows, rej.rejected_order_ts) == (3, 2, 0)


def test_file_with_other_column_order_fails(spark, tmp_out):
    swapped = HEADER.copy()
    i, j = swapped.index("Days for shipping (real)"), swapped.index("Days for shipment (scheduled)")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    _write(os.path.join(tmp_out, "a.csv"), HEADER, [_row()])
    _write(os.path.join(tmp_out, "b.csv"), swapped, [_row()])
    with pytest.raises(Exception, match="(?i)header"):
        typed_order_lines(read_raw_csv(spark, tmp_out)).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_do_not_depend_on_the_session_zone(spark, tmp_out, zone):
    path = os.path.join(tmp_out, "dst.csv")
    _csv(path, [_row(**{"order date (DateOrders)": "3/13/2016 2:30"})])  # skipped by New York's clocks
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    assert str(typed_order_lines(read_raw_csv(other, path)).first().order_ts) == "2016-03-13 02:30:00"


def test_month_files_follow_the_data(spark, tmp_out):
    """Many input tasks and every month in each: files stay near one per month,
    and a hot month is split."""
    from shiplens.plans.registry import enriched

    df = enriched(spark, "/root/testdata/sf0.01").repartition(24)
    path = os.path.join(tmp_out, "many")
    write_enriched(df, path)
    dirs = [d for d in os.listdir(path) if d.startswith("order_month=")]
    files = sum(f.endswith(".parquet") for d in dirs for f in os.listdir(os.path.join(path, d)))
    assert len(dirs) <= files <= 2 * len(dirs)
    small = spark.newSession()
    for k, v in {"advisoryPartitionSizeInBytes": "64k", "skewJoin.skewedPartitionThresholdInBytes": "64k"}.items():
        small.conf.set(f"spark.sql.adaptive.{k}", v)
    hot = enriched(small, "/root/testdata/sf0.01").repartition(24).withColumn("order_month", F.lit("1996-01"))
    path = os.path.join(tmp_out, "hot")
    write_enriched(hot, path)
    assert sum(f.endswith(".parquet") for f in os.listdir(os.path.join(path, "order_month=1996-01"))) > 1


def test_card_with_a_repeated_key_fails(spark, make_lines):
    from shiplens.operators.lookups import with_base_rate

    card = spark.createDataFrame([("Same Day", 1.0), ("Same Day", 2.0)], "shipping_mode string, base_rate double")
    with pytest.raises(Exception, match="more than once"):
        with_base_rate(make_lines([{"shipping_mode": "Same Day"}]), card).collect()
