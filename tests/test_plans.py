"""Physical-plan assertions: JVM-side execution, pushdown, join strategies."""

from __future__ import annotations

import pytest

from shiplens.plans import registry
from tests.conftest import SF_SMALL


@pytest.fixture(autouse=True)
def _no_cached_plans(spark):
    """Other modules cache the enriched lines; Spark would substitute that
    cache into these plans. Plan assertions are about the uncached plan."""
    spark.catalog.clearCache()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().treeString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_in_plans(spark, name):
    plan = _plan(registry.run(name, spark, SF_SMALL))
    for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert marker not in plan


def test_card_lookup_is_a_broadcast_join(spark):
    df = registry.run("lookup_base_rate", spark, SF_SMALL)
    df.collect()  # Spark decides by the card's bytes
    join = [l for l in _plan(df).split("Initial Plan")[0].splitlines() if "LeftOuter" in l]
    assert join and "BroadcastHashJoin" in join[0]


def test_default_cards_need_no_join(spark):
    plan = _plan(registry.run("cost_model", spark, SF_SMALL))
    assert not [l for l in plan.splitlines() if "Join" in l and "shipping_mode" in l]


def test_top_k_uses_take_ordered(spark):
    df = registry.run("chart_cost_by_region", spark, SF_SMALL)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()


def test_fact_table_never_broadcast(spark):
    df = registry.run("kpi_otif_by_carrier", spark, SF_SMALL)
    df.collect()
    lines = _plan(df).splitlines()
    smj = [l for l in lines if "SortMergeJoin" in l]
    assert smj and "l_orderkey" in smj[0]
    for i, l in enumerate(lines):
        if "FileScan parquet" in l and "l_orderkey" in l:
            parent = next(p for p in reversed(lines[:i]) if "Exchange" in p)
            assert "Exchange hashpartitioning(l_orderkey" in parent


def test_pruning_and_pushdown(spark):
    plan = _plan(registry.run("kpi_otif_by_carrier", spark, SF_SMALL))
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l and "orders.parquet" in l][0]
    pushed = scan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "o_totalprice" not in scan and "IsNotNull(o_orderpriority)" in pushed
    assert "part.parquet" not in plan  # category unused -> the part lookup is removed


def test_unused_dimension_lookups_are_removed(spark):
    monthly = _plan(registry.run("kpi_otif_monthly", spark, SF_SMALL))
    assert "customer.parquet" not in monthly and "part.parquet" not in monthly
    category = _plan(registry.run("kpi_failed_delivery_category", spark, SF_SMALL))
    assert "part.parquet" in category


def test_hot_dimension_keys_are_split(spark, tmp_out):
    """Most lines on one part and most orders on one customer: past the
    broadcast threshold AQE splits both joins, and nothing aggregates a
    dimension before its join."""
    from pyspark.sql import functions as F

    path = tmp_out + "/skew"
    for t in ("lineitem", "orders", "customer", "nation", "part"):
        df = spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
        if t == "lineitem":
            df = df.withColumn("l_partkey", F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10)) < 6, 1)
                               .otherwise(F.col("l_partkey")).cast("bigint"))
        if t == "orders":
            df = df.withColumn("o_custkey", F.when(F.pmod(F.xxhash64("o_orderkey"), F.lit(10)) < 6, 1)
                               .otherwise(F.col("o_custkey")).cast("bigint"))
        df.repartition(8).write.parquet(f"{path}/{t}.parquet")  # a split needs several map tasks
    hot = spark.newSession()
    for k, v in {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1",
                 "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "adaptive.skewJoin.skewedPartitionFactor": "1.5",
                 "adaptive.advisoryPartitionSizeInBytes": "2k", "adaptive.coalescePartitions.enabled": "false",
                 "shuffle.partitions": "16", "files.maxPartitionBytes": "64k", "files.openCostInBytes": "1k"}.items():
        hot.conf.set(f"spark.sql.{k}", v)
    df = registry.run("kpi_failed_delivery_category", hot, path)
    df.collect()
    final = _plan(df).split("Initial Plan")[0]
    skewed = [l for l in final.splitlines() if "SortMergeJoin(skew=true)" in l]
    assert any("l_partkey" in l for l in skewed) and any("o_custkey" in l for l in skewed), final
    assert "SortAggregate" not in final


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_fact_table_scanned_once(spark, name):
    """No query re-reads the lines in a second branch (total rows, stacked
    blocks and shares all come from one lineage); a query that passes through
    a sink answers from what it stored."""
    plan = _plan(registry.run(name, spark, SF_SMALL))
    scans = [l for l in plan.splitlines() if "FileScan parquet" in l and "lineitem.parquet" in l]
    build = registry.QUERIES[name].build
    assert len(scans) == (0 if build and build.__module__.endswith("roundtrips") else 1), name


def test_plan_shape_once_tables_are_large(spark):
    """With the broadcast threshold below every table but nation (what a
    cluster sees at scale): nation is the only broadcast, lineitem is shuffled
    by order key and then part key, dimension lookups are sort-merge joins."""
    big = spark.newSession()
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        big.conf.set(k, str(4 * 1024))
    plan = _plan(registry.run("kpi_failed_delivery_category", big, SF_SMALL))
    lines = plan.splitlines()
    broadcast_scans = []
    for i, l in enumerate(lines):
        if "BroadcastExchange" in l:
            broadcast_scans += [x for x in lines[i + 1:i + 4] if "FileScan parquet" in x]
    assert broadcast_scans and all("nation.parquet" in x for x in broadcast_scans)
    assert plan.count("SortMergeJoin") == 3
    assert "Exchange hashpartitioning(l_orderkey" in plan and "Exchange hashpartitioning(l_partkey" in plan
