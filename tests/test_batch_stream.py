"""Batch job (cube path) and the streaming incremental job."""

from __future__ import annotations

import os

from shiplens.plans import batch, registry
from shiplens.plans.registry import present
from shiplens.sources.raw import RAW_COLUMNS
from tests.conftest import SF_SMALL


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_batch_writes_all_kpis_equal_to_direct_queries(spark, tmp_out):
    paths = batch.run_batch(spark, tmp_out, sf_dir=SF_SMALL)
    assert set(batch.KPI_TABLES) <= set(paths)
    for name in batch.KPI_TABLES:
        got = spark.read.parquet(paths[name])
        want = registry.run(name, spark, SF_SMALL)
        assert _sorted(got) == _sorted(want), name


def test_batch_writes_marts(spark, tmp_out):
    paths = batch.run_batch(spark, tmp_out, sf_dir=SF_SMALL, tables=(), write_lines=False, marts=True)
    assert set(batch.mart_tables()) <= set(paths)
    for name in ("dashboard_cards", "chart_cost_by_region", "routing_guide"):
        assert _sorted(spark.read.parquet(paths[name])) == _sorted(registry.run(name, spark, SF_SMALL)), name


def test_workbook_export_uses_display_labels(spark, tmp_out):
    paths = batch.run_batch(spark, tmp_out, sf_dir=SF_SMALL, tables=("kpi_otif_by_carrier",),
                            write_lines=False, workbook=True)
    carrier = spark.read.option("header", True).csv(paths["workbook:OTIF by Carrier"])
    assert carrier.columns[0] == "Carrier / Service Tier" and "is_total" not in carrier.columns
    assert carrier.count() == 5  # four tiers and the total row


def test_streaming_deltas_match_batch(spark, tmp_out):
    # Land the sf0.001 order lines as two raw-format CSV files.
    src = os.path.join(tmp_out, "landing")
    lines = registry.lines(spark, SF_SMALL)
    from pyspark.sql import functions as F
    raw = lines.select([
        (F.date_format(F.col(name), "M/d/yyyy H:mm") if kind == "ts" else F.col(name).cast("string"))
        .alias(header) for header, (name, kind) in RAW_COLUMNS.items()])
    raw.repartition(2).write.option("header", True).csv(src)

    from shiplens.operators.measures import CUBE
    from shiplens.streaming import compact_cube, kpi_from_deltas, order_line_stream, start_incremental
    stream = order_line_stream(spark, src, list(RAW_COLUMNS), max_files_per_trigger=1)
    q = start_incremental(stream, os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ckpt"))
    q.awaitTermination(300)
    assert q.exception() is None
    for name in ("kpi_otif_by_carrier", "kpi_cpo_region_carrier", "kpi_monthly_by_segment"):
        got = kpi_from_deltas(spark, os.path.join(tmp_out, "out"), name)
        want = registry.run(name, spark, SF_SMALL)
        assert _sorted(got) == _sorted(want), name
    assert len(os.listdir(os.path.join(tmp_out, "out", "cube"))) >= 2  # one delta per batch
    compacted = compact_cube(spark, os.path.join(tmp_out, "out"))
    assert kpi_from_deltas(spark, os.path.join(tmp_out, "out"), "kpi_otif_by_carrier").count() == 4  # not counted twice
    again = kpi_from_deltas(spark, os.path.join(tmp_out, "out"), "kpi_cpo_region_carrier")
    assert _sorted(again) == _sorted(registry.run("kpi_cpo_region_carrier", spark, SF_SMALL))
    q = registry.QUERIES["kpi_topline_summary"]
    got = present(q.fn(compacted, CUBE), q)
    assert _sorted(got) == _sorted(registry.run("kpi_topline_summary", spark, SF_SMALL))


def test_command_line_on_raw_csv(spark, tmp_out):
    """Raw export -> CLI -> KPI CSVs equal to the direct query on the same lines."""
    from pyspark.sql import functions as F

    from shiplens.__main__ import main

    src = os.path.join(tmp_out, "raw")
    lines = registry.lines(spark, SF_SMALL)
    lines.select([
        (F.date_format(F.col(name), "M/d/yyyy H:mm") if kind == "ts" else F.col(name).cast("string"))
        .alias(header) for header, (name, kind) in RAW_COLUMNS.items()
    ]).write.option("header", True).option("encoding", "ISO-8859-1").csv(src)
    paths = main(["--raw-csv", src, "--out", os.path.join(tmp_out, "out"), "--csv", "--no-lines",
                  "--source-headers"])
    got = spark.read.option("header", True).option("inferSchema", True).csv(paths["kpi_otif_by_carrier"])
    assert got.columns[0] == "Shipping Mode"
    want = registry.run("kpi_otif_by_carrier", spark, SF_SMALL)
    assert sorted(r.orders for r in got.collect()) == sorted(r.orders for r in want.collect())


def test_batch_runs_without_checkpoint_dir_and_leaves_nothing(tmp_out):
    """A session of its own, without spark.checkpoint.dir: two runs, both whole,
    and no cube left in the output or the work folder."""
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
from shiplens.session import local_session
from shiplens.plans import batch
s = local_session(2, 4)
assert s.conf.get("spark.checkpoint.dir", None) is None
for i, work in enumerate((None, {tmp_out!r} + "/work")):
    out = {tmp_out!r} + f"/out{{i}}"
    paths = batch.run_batch(s, out, sf_dir={SF_SMALL!r}, tables=("kpi_otif_by_carrier",), work_dir=work)
    assert s.read.parquet(paths["kpi_otif_by_carrier"]).count() == 4
    assert s.read.parquet(paths["line_quality"]).first().lines_without_month == 0
    left = work or out + "/_work"
    assert not os.path.isdir(left) or os.listdir(left) == [], os.listdir(left)
print("whole")
"""
    os.makedirs(tmp_out + "/conf")
    env = os.environ | {"SPARK_CONF_DIR": tmp_out + "/conf"}  # no site defaults
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, env=env)
    assert "whole" in done.stdout, done.stderr[-2000:]


def test_bad_dates_are_reported(spark, tmp_out):
    """Three lines, two with a date in another format: the monthly table holds
    one, and the reports say where the others went."""
    import pytest

    from tests.test_sources import _csv, _row

    src = os.path.join(tmp_out, "raw.csv")
    bad = {"order date (DateOrders)": "2016-03-13 10:00"}
    _csv(src, [_row(), _row(**{"Order Item Id": "2", **bad}), _row(**{"Order Item Id": "3", **bad, "Order Region": "Atlantis"})])
    paths = batch.run_batch(spark, os.path.join(tmp_out, "out"), raw_csv=src, tables=("kpi_otif_monthly",))
    assert spark.read.parquet(paths["kpi_otif_monthly"]).first().orders == 1
    rejects = spark.read.parquet(paths["ingest_rejects"]).first()
    assert (rejects.raw_rows, rejects.rejected_order_ts, rejects.malformed_rows) == (3, 2, 0)
    quality = spark.read.parquet(paths["line_quality"]).first()
    assert (quality.kept_lines, quality.lines_without_month, quality.default_zone_lines) == (3, 2, 1)
    with pytest.raises(ValueError, match="rejected"):
        batch.run_batch(spark, os.path.join(tmp_out, "strict"), raw_csv=src, tables=(), max_reject_share=0.5)
