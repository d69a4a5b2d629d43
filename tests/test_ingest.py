"""One scan of the export, line breaks in quotes, date formats, row order (A1, E1, F4, N13) and the prefix sum."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shiplens.config import CostParams
from shiplens.operators.enrich import enrich
from shiplens.operators.pareto import with_cum_share, with_rank, with_running
from shiplens.plans import batch
from shiplens.sources.publish import published
from shiplens.sources.raw import (ROW_NO, infer_date_format, ingest_rejects, quoted_records, read_raw_csv, rejected_rows,
                                  typed_order_lines)
from tests.conftest import ROOT
from tests.test_sources import HEADER, _csv, _row

DAMAGED = [_row(**{"Order Item Id": str(i), "Sales": "x" if i % 5 == 0 else "9.5",
                   "order date (DateOrders)": "31/31/2016 1:00" if i % 7 == 0 else "1/31/2016 21:56"}) for i in range(60)]


def test_audit_in_the_same_pass(spark, tmp_out):
    src, out = os.path.join(tmp_out, "raw.csv"), os.path.join(tmp_out, "out")
    _csv(src, DAMAGED + [["too", "short"]])
    paths = batch.run_batch(spark, out, raw_csv=src, tables=("kpi_otif_monthly",), reject_rows=True)
    got = spark.read.parquet(paths["ingest_rejects"]).first().asDict()
    assert got == ingest_rejects(read_raw_csv(spark, src)).first().asDict()
    assert (got["raw_rows"], got["malformed_rows"], got["rejected_sales"], got["rejected_order_ts"]) == (61, 1, 12, 9)
    rows = spark.read.parquet(paths["rejected_rows"]).collect()
    assert sorted(r.line_key for r in rows if r.line_key and "sales" in r.reasons) == sorted(str(i) for i in range(0, 60, 5))
    assert [r.reasons for r in rows if r.line_key is None] == [["malformed"]]
    assert [r.reasons for r in rows if r.line_key == "35"] == [["order_ts", "sales"]]
    before = published(spark, out)
    with pytest.raises(ValueError, match="rejected"):
        batch.run_batch(spark, out, raw_csv=src, tables=("kpi_otif_monthly",), max_reject_share=0.1)
    assert published(spark, out) == before and len(os.listdir(os.path.join(out, "runs"))) == 1
    assert rejected_rows(read_raw_csv(spark, src)).count() == len(rows)


def test_batch_parses_the_export_once(tmp_out):
    src = os.path.join(tmp_out, "raw.csv")
    _csv(src, DAMAGED)
    os.makedirs(log := os.path.join(tmp_out, "events"))
    code = f"""
from shiplens.plans import batch
from shiplens.session import local_session
s = local_session("2", shuffle_partitions=2, app="once", extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{log}",
    "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", "spark.checkpoint.dir": {tmp_out!r} + "/shared"}})
batch.run_batch(s, {tmp_out!r} + "/out", raw_csv={src!r})
s.stop()
print("done")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert "done" in done.stdout, done.stderr[-2000:]
    scans = []
    for f in os.listdir(log):
        if os.path.isdir(os.path.join(log, f)):
            continue
        for line in open(os.path.join(log, f)):
            e = json.loads(line)
            if e["Event"].endswith("SparkListenerSQLExecutionStart") and "Scan csv" in e["physicalPlanDescription"]:
                scans.append(e["executionId"])
    assert len(scans) == 1


def _random_rows(seed, n):
    r = random.Random(seed)
    bits = ["a", "b,c", 'say ""x""', "line\nbreak", "\n\n", "cr\r\nlf", "", "  ", "é", '""', ",", "long " * 9]
    out = []
    for i in range(n):
        field = lambda: f'"{"".join(r.choices(bits, k=r.randint(1, 4)))}"'
        out.append(_row(**{"Order Item Id": str(i), "Category Name": field() if r.random() < 0.6 else "plain",
                           "Customer City": field() if r.random() < 0.4 else "city"}))
    return out


def _plain(df):
    return sorted(tuple(r) for r in df.select([F.coalesce(F.col(f"`{c}`"), F.lit("\0")) for c in df.columns]).collect())


@pytest.mark.parametrize("seed, ending", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_quoted_line_breaks_across_splits(spark, tmp_out, seed, ending):
    folder = os.path.join(tmp_out, "raw")
    os.makedirs(folder)
    for part in range(2):
        with open(os.path.join(folder, f"{part}.csv"), "w", encoding="latin-1", newline="") as f:
            f.write(ending.join([",".join(HEADER), *(",".join(r) for r in _random_rows(10 * seed + part, 300))]) + ending)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    assert small.read.text(folder).rdd.getNumPartitions() > 40
    got = read_raw_csv(small, folder, multi_line=True)
    from shiplens.sources.raw import csv_options, raw_schema
    one_task = spark.read.options(**csv_options(multi_line=True)).schema(raw_schema(HEADER)).csv(folder)
    want = _plain(one_task)
    assert got.columns == one_task.columns and len(want) == 600 and _plain(got) == want


def test_quotes_that_do_not_close_and_foreign_headers_fail(spark, tmp_out):
    open_quote = os.path.join(tmp_out, "open")
    os.makedirs(open_quote)
    _csv(os.path.join(open_quote, "a.csv"), [_row(**{"Customer City": '"never closed'})])
    with pytest.raises(Exception, match="quotes are not closed"):
        quoted_records(spark, open_quote).collect()
    other = os.path.join(tmp_out, "other")
    os.makedirs(other)
    _csv(os.path.join(other, "a.csv"), [_row()])
    with open(os.path.join(other, "b.csv"), "w") as f:
        f.write(",".join(HEADER[::-1]) + "\n" + ",".join(_row()) + "\n")
    with pytest.raises(Exception, match="header of"):
        read_raw_csv(spark, other, multi_line=True).collect()


def _dated(spark, texts):
    rows = [(str(i), t, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "`Order Item Id` string, `order date (DateOrders)` string, `shipping date (DateOrders)` string")


@pytest.mark.parametrize("texts, want", [
    (["1/31/2016 21:56", "2/3/2016 1:00", None, ""], "M/d/yyyy H:mm"),
    (["31/1/2016 21:56", "2/3/2016 1:00"], "d/M/yyyy H:mm"),
    (["2016-01-31 21:56:00", "2016-02-03 01:00:07"], "yyyy-MM-dd HH:mm:ss"),
    (["31.1.2016 21:56"], "d.M.yyyy H:mm"),
    (["5/5/2016 1:00"], "M/d/yyyy H:mm"),  # read the same either way
    (["1/31/2016 21:56"] * 200 + ["broken"], "M/d/yyyy H:mm"),
])
def test_date_formats_are_recognised(spark, texts, want):
    assert infer_date_format(_dated(spark, texts)) == want


@pytest.mark.parametrize("texts, says", [(["1/2/2016 1:00", "3/4/2016 1:00"], "several formats"), (["yesterday"], "no date format"),
                                         (["1/31/2016 1:00", "31/1/2016 1:00"], "no date format"), ([None, " "], "no date format")])
def test_unclear_dates_are_refused(spark, texts, says):
    with pytest.raises(ValueError, match=says):
        infer_date_format(_dated(spark, texts))


def test_row_order_noise_for_any_number_of_splits(spark, tmp_out):
    folder = os.path.join(tmp_out, "raw")
    os.makedirs(folder)
    for part in range(2):
        _csv(os.path.join(folder, f"{part}.csv"), [_row(**{"Order Item Id": f"{part}-{i}"}) for i in range(400)])
    params = CostParams(noise_key=ROW_NO)
    seen = []
    for size in ("128m", "3000", "700"):
        s = spark.newSession()
        s.conf.set("spark.sql.files.maxPartitionBytes", size)
        s.conf.set("spark.sql.files.openCostInBytes", "1")
        raw = read_raw_csv(s, folder, row_numbers=True)
        lines = enrich(typed_order_lines(raw), params)
        seen.append(sorted((r[ROW_NO], r.line_key, r.cost_per_order) for r in lines.select(ROW_NO, "line_key", "cost_per_order").collect()))
    assert seen[0] == seen[1] == seen[2]
    assert [x[0] for x in seen[0]] == list(range(800))
    assert [x[1] for x in seen[0]] == [f"{p}-{i}" for p in range(2) for i in range(400)]
    noise = [x[2] for x in seen[0]]
    mean = sum(noise) / len(noise)
    sd = (sum((x - mean) ** 2 for x in noise) / len(noise)) ** 0.5
    assert abs(sd - params.noise_sigma) < 0.06 and len(set(noise)) > 790


def test_prefix_sum_equals_the_window(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(9)).alias("failed_orders"),
                                      F.pmod("id", F.lit(3)).cast("string").alias("g"))
    order = [F.col("failed_orders").desc(), F.col("k").asc()]
    for by in ((), ("g",)):
        w = Window.partitionBy(*by).orderBy(*order)
        want = {r.k: (r.s, r.n) for r in rows.select("k", F.sum("failed_orders").over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("s"), F.row_number().over(w).alias("n")).collect()}
        summed = with_running(rows, order, F.col("failed_orders"), "s", "t", by)
        ranked = with_running(summed, order, F.lit(1), "n", "rows", by)
        got = ranked.collect()
        assert {r.k: (r.s, r.n) for r in got} == want and len(got) == len(want)
    assert [r.t for r in summed.where("g = '1'").limit(1).collect()] == [rows.where("g = '1'").agg(F.sum("failed_orders")).first()[0]]


def test_prefix_sum_spreads_its_keys(spark):
    wide = spark.newSession()
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = wide.range(200_000).select(F.concat(F.lit("category "), "id").alias("k"), F.lit(1).alias("failed_orders"))
    out = with_cum_share(rows, "k")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rangepartition" in plan.lower() or "RepartitionByExpression" in plan
    windows = [line for line in plan.splitlines() if "+- Window [" in line or line.startswith("Window [")]
    assert windows and all("__range" in w or "at#" in w or "_w" in w or "__to" in w for w in windows)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 100_000
    assert out.agg(F.max("cum_pct"), F.min("cum_pct"), F.count("*")).first()[0] == 1.0
    empty = with_rank(with_cum_share(rows.limit(0), "k"), "k")
    assert empty.collect() == []
