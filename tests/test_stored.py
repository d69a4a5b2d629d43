"""Publication, declared tables, views from stored tables, late months."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from shiplens.plans import batch, registry, stored
from shiplens.sources import publish
from shiplens.sources.contracts import CONTRACTS, ContractError, columns
from shiplens.sources.sinks import merge_enriched, read_enriched, read_kpi, write_enriched, write_kpi
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("published"))
    batch.run_batch(spark, out, sf_dir=SF_SMALL, write_lines=False)
    return out


def test_declarations_are_those_of_the_batch(spark, run):
    tables = publish.published(spark, run)
    assert set(CONTRACTS) == set(batch.KPI_TABLES) <= set(tables)
    for name in CONTRACTS:
        df = read_kpi(spark, tables[name], name=name)
        assert df.dtypes == columns(name)


@pytest.mark.parametrize("name", sorted(stored.VIEWS))
def test_views_from_stored_tables_equal_direct_queries(spark, run, name):
    got = stored.view(name, stored.reader(spark, run))
    want = registry.run(name, spark, SF_SMALL)
    assert got.columns == want.columns
    a, b = ([tuple(r) for r in df.collect()] for df in (got, want))
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-4)), (name, x, y)


def test_all_sheets_build_from_stored_tables(spark, run):
    from shiplens.plans.marts import WORKBOOK_SHEETS

    read = stored.reader(spark, run)
    for title, (_, labels) in WORKBOOK_SHEETS.items():
        df = stored.sheet(title, read)
        assert set(df.columns) <= set(labels.values()) and df.count() > 0, title


def test_csv_tables_are_held_to_their_declaration(spark, tmp_out):
    df = registry.run("kpi_otif_by_carrier", spark, SF_SMALL)
    path = os.path.join(tmp_out, "k1")
    write_kpi(df, path, "csv")
    assert sorted(map(tuple, read_kpi(spark, path, "csv", name="kpi_otif_by_carrier").collect())) == sorted(map(tuple, df.collect()))
    write_kpi(df.withColumn("orders", F.lit("many")), path, "csv")
    with pytest.raises(Exception, match="MALFORMED|malformed|orders"):
        read_kpi(spark, path, "csv", name="kpi_otif_by_carrier").collect()


@pytest.mark.parametrize("damage, says", [
    (lambda df: df.withColumnRenamed("otif_rate", "otif"), "otif_rate"),
    (lambda df: df.drop("orders"), "orders"),
    (lambda df: df.withColumn("extra", F.lit(1)), "extra"),
    (lambda df: df.withColumn("orders", F.col("orders").cast("double")), "double"),
    (lambda df: df.unionByName(df), "repeated"),
    (lambda df: df.withColumn("order_month", F.lit(None).cast("string")).limit(1), "null"),
])
def test_damaged_tables_fail_by_name(spark, tmp_out, damage, says):
    path = os.path.join(tmp_out, "k3")
    write_kpi(damage(registry.run("kpi_otif_monthly", spark, SF_SMALL)), path)
    with pytest.raises(ContractError, match="kpi_otif_monthly.*" + says):
        read_kpi(spark, path, name="kpi_otif_monthly")


def test_failed_run_leaves_the_old_set(spark, tmp_out, monkeypatch):
    names = ("kpi_otif_by_carrier", "kpi_otif_monthly", "kpi_edd_by_carrier")
    go = lambda: batch.run_batch(spark, tmp_out, sf_dir=SF_SMALL, tables=names, write_lines=False, parallel_jobs=1)
    assert publish.published(spark, tmp_out) == {}
    go()
    first = publish.published(spark, tmp_out)
    write, done = batch.write_kpi, []

    def breaks(df, path, fmt="parquet"):
        if path.endswith("kpi_edd_by_carrier"):
            raise RuntimeError("killed between tables")
        done.append(path)
        write(df, path, fmt)

    monkeypatch.setattr(batch, "write_kpi", breaks)
    with pytest.raises(RuntimeError, match="killed"):
        go()
    assert len(done) >= 2 and not any(os.path.exists(p) for p in done)  # written, and removed with the run
    assert publish.published(spark, tmp_out) == first
    for n in names:
        assert publish.read_published(spark, tmp_out, n).count() > 0
    monkeypatch.setattr(batch, "write_kpi", write)
    go()
    second = publish.published(spark, tmp_out)
    assert second != first and set(second) == set(first)
    go()
    assert not os.path.exists(first["kpi_otif_monthly"]) and os.path.exists(second["kpi_otif_monthly"])  # two runs are kept
    with pytest.raises(KeyError, match="kpi_cost_monthly"):
        publish.read_published(spark, tmp_out, "kpi_cost_monthly")


def test_unfinished_manifest_is_not_read(spark, tmp_out):
    publish.publish(spark, tmp_out, "1", {"a": "x"})
    with open(os.path.join(tmp_out, "manifests", "_2.tmp"), "w") as f:
        f.write('{"run": "2", "tab')
    assert publish.published(spark, tmp_out) == {"a": "x"}


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs
            if f.startswith("part-")}


def _state(spark, path):
    df = read_enriched(spark, path).withColumn("order_month", F.col("order_month").cast("string"))
    return sorted((r.line_key, r.order_month, r.qty) for r in df.select("line_key", "order_month", "qty").collect())


def test_late_lines_rewrite_their_months_alone(spark, tmp_out, small_enriched):
    path = os.path.join(tmp_out, "enriched")
    months = [r[0] for r in small_enriched.select("order_month").distinct().orderBy("order_month").collect()]
    one, two = months[3], months[10]
    late_key = F.pmod(F.xxhash64("line_key"), F.lit(7)) == 0
    late = small_enriched.where(late_key & (F.col("order_month") == one))
    write_enriched(small_enriched.join(late.select("line_key"), "line_key", "left_anti"), path)
    before = _files(path)
    assert late.count() > 0
    assert merge_enriched(late, path) == [one]
    after = _files(path)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all(f"order_month={one}" in f for f in changed)
    assert _state(spark, path) == sorted((r.line_key, r.order_month, r.qty) for r in small_enriched.collect())
    assert merge_enriched(late, path) == [] and _files(path) == after  # a repeated run changes nothing

    moved = late.limit(1).withColumns({"order_month": F.lit(two), "qty": F.lit(99)}).cache()
    assert merge_enriched(moved, path) == [one, two]
    key = moved.first().line_key
    assert [(m, q) for k, m, q in _state(spark, path) if k == key] == [(two, 99)]
    assert len(_state(spark, path)) == small_enriched.count()


def test_all_lines_of_a_month_can_move(spark, tmp_out, small_enriched):
    path = os.path.join(tmp_out, "enriched")
    some = small_enriched.where("order_month in ('1996-01', '1996-02')")
    write_enriched(some, path)
    merge_enriched(some.where("order_month = '1996-01'").withColumn("order_month", F.lit("1996-02")), path)
    assert {m for _, m, _ in _state(spark, path)} == {"1996-02"} and len(_state(spark, path)) == some.count()


def test_round_trips_of_two_calls_do_not_meet(spark):
    a = registry.run("stored_kpi_chart", spark, "/root/testdata/sf0.01")
    b = registry.run("stored_kpi_chart", spark, SF_SMALL)
    rows = [tuple(map(tuple, df.collect())) for df in (a, b)]
    assert rows[0] != rows[1] and all(rows)
