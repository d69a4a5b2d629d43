"""What queries move and hold as their tables grow: late months, date formats, quoted line breaks, cards."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from shiplens.operators.lookups import rate_card, zone_card
from shiplens.plans import registry
from shiplens.sources import raw as R
from shiplens.sources import sinks
from tests.conftest import ROOT, SF_SMALL


def test_late_months_move_each_line_few_times(tmp_out):
    """with no table small enough to be broadcast, as at size."""
    os.makedirs(log := os.path.join(tmp_out, "events"))
    code = f"""
from shiplens.plans import registry
from shiplens.session import local_session
s = local_session("2", shuffle_partitions=2, app="late", extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{log}",
    "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", "spark.checkpoint.dir": {tmp_out!r} + "/shared",
    "spark.sql.autoBroadcastJoinThreshold": "-1"}})
assert registry.run("sink_late_month", s, "/root/testdata/sf0.01").count() > 0
s.stop()
print("done")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert "done" in done.stdout, done.stderr[-2000:]
    moved = written = 0
    for name in os.listdir(log):
        for line in open(os.path.join(log, name)):
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                m = e["Task Metrics"]
                moved += m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                written += m["Output Metrics"]["Records Written"]
    lines = 57_012
    assert written <= 2 * lines + 1000 and moved < 250 * lines


def test_a_merge_compacts_many_small_files(spark, tmp_out, small_enriched):
    path = os.path.join(tmp_out, "enriched")
    some = small_enriched.where("order_month = '1996-01'").cache()
    sinks.write_enriched(some.repartition(24), path, clustered=True)
    folder = os.path.join(path, "order_month=1996-01")
    assert sum(f.endswith(".parquet") for f in os.listdir(folder)) > 16
    late = some.limit(3).withColumn("qty", F.lit(77)).cache()
    assert sinks.merge_enriched(late, path) == ["1996-01"]
    assert sum(f.endswith(".parquet") for f in os.listdir(folder)) <= 2
    got = {r.line_key: r.qty for r in sinks.read_enriched(spark, path).collect()}
    assert got == {r.line_key: r.qty for r in some.collect()} | {r.line_key: 77 for r in late.collect()}


def test_date_shapes_rule_out_no_date(spark):
    """a format is tried on texts of its shape alone; no date is lost by that."""
    texts = ["1/2/2016 1:00", "31/12/2016 23:59", "12/31/2016 0:00", "001/02/2016 01:00", "-1/2/2016 1:00", "+1/2/2016 1:00", "1/2/-2016 1:00",
             '"1/2/2016 1:00"', " 1/2/2016 1:00", "1/2/2016 1:00 ", "1/2/2016 1:00\nx", "\n1/2/2016 1:00", "1/2/2016 1:00\u0001x", "1/2/16 1:00",
             "1/2/+12016 1:00", "2016/1/2 1:00", "2016-01-02 01:00:00", "2016-01-02 1:00", "1.2.2016 1:00", "31-1-2016 1:00", "1-31-2016 1:00",
             "2016-1-2 1:00", "30/2/2016 1:00", "1/2/2016 24:00", "1/2/2016", "", "yesterday", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    formats = (*R.DATE_FORMATS, "MM/dd/yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "yyyyMMdd HH:mm")
    for f in formats:
        got = rows.select("text", R.parse_raw_ts(F.col("text"), f).isNotNull().alias("parsed"), F.col("text").rlike(R.date_shape(f)).alias("shaped"))
        assert [r.text for r in got.collect() if r.parsed and not r.shaped] == [], f
    day_first = rows.where("text = '31/12/2016 23:59'")
    assert [f for f in R.DATE_FORMATS if day_first.where(F.col("text").rlike(R.date_shape(f))).count()] == ["d/M/yyyy H:mm"]
    assert [R.date_shape(f) for f in ("d MMM yyyy", "yyyy-MM-dd'T'HH:mm", "M/d/yyyy h:mm a")] == [None] * 3


def test_lines_of_one_split_are_spread(spark, tmp_out, monkeypatch):
    """a task holds units of a split, not whole splits."""
    monkeypatch.setattr(R, "UNIT_LINES", 16)
    fixed = spark.newSession()
    fixed.conf.set("spark.sql.adaptive.enabled", "false")
    rows = [f'{i},"a{"" if i % 7 else chr(10) * (i % 5) + "b"},""{i}"""' for i in range(3000)]
    os.makedirs(tmp_out, exist_ok=True)
    with open(path := os.path.join(tmp_out, "one.csv"), "w", newline="") as f:
        f.write("\n".join(["id,text", *rows]) + "\n")
    got = R.quoted_records(fixed, path)
    assert sorted(r.record for r in got.collect()) == sorted(["id,text", *rows])
    assert [r.record for r in got.where("is_header").collect()] == ["id,text"]
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1500


def test_cards_never_deal_the_lines_by_their_keys(spark):
    """a card's size is known before anything has run, so it is broadcast from the start."""
    for name, key in (("lookup_base_rate", "shipping_mode"), ("lookup_zone_factor", "order_region")):
        plan = registry.run(name, spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [" + key in plan and "hashpartitioning(" + key not in plan
    assert [tuple(r) for r in rate_card(spark, {"a": 1, "b": None}).collect()] == [("a", 1.0), ("b", None)]
    assert rate_card(spark, {}).collect() == [] and zone_card(spark, {}).dtypes == [("order_region", "string"), ("zone_factor", "double")]
