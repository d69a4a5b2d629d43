from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"

# Column order / types of typed order lines (what the raw reader produces).
LINE_SCHEMA = (
    "order_id bigint, line_key string, order_ts timestamp_ntz, ship_ts timestamp_ntz, "
    "order_status string, delivery_status string, real_days int, sched_days int, late_risk int, "
    "shipping_mode string, order_region string, market string, customer_segment string, "
    "category_name string, qty int, sales double"
)
LINE_DEFAULTS = dict(
    order_id=1, line_key=None, order_ts="2016-01-15 10:00:00", ship_ts="2016-01-17 10:00:00",
    order_status="COMPLETE", delivery_status="Shipping on time", real_days=2, sched_days=2,
    late_risk=0, shipping_mode="Standard Class", order_region="US Center", market="USCA",
    customer_segment="Consumer", category_name="Cleats", qty=1, sales=100.0,
)


@pytest.fixture(scope="session")
def spark():
    from shiplens.session import local_session

    shared = {"spark.checkpoint.dir": os.environ.get("SHIPLENS_TEST_SHARED") or tempfile.mkdtemp(prefix="shiplens-shared-")}
    s = local_session("*", shuffle_partitions=8, app="shiplens-tests", extra=shared)
    yield s
    s.stop()


@pytest.fixture
def make_lines(spark):
    """Hand-made typed order lines: ``make_lines([{field: value}, ...])``."""
    from datetime import datetime

    from pyspark.sql import functions as F

    def _make(rows):
        full = []
        for i, r in enumerate(rows):
            d = {**LINE_DEFAULTS, **r}
            if d["line_key"] is None:
                d["line_key"] = f"L{i}"
            for k in ("order_ts", "ship_ts"):
                if isinstance(d[k], str):
                    d[k] = datetime.fromisoformat(d[k])
            full.append(d)
        names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
        df = spark.createDataFrame([tuple(d[n] for n in names) for d in full], LINE_SCHEMA)
        return df.select([F.col(n) for n in names])

    return _make


@pytest.fixture(scope="session")
def small_enriched(spark):
    from shiplens.plans.registry import enriched

    return enriched(spark, SF_SMALL).cache()


@pytest.fixture
def tmp_out():
    return tempfile.mkdtemp(prefix="shiplens-test-")
