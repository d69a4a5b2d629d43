"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``queries`` holds the wall time of each headline query (collect of the
result, tables read from parquet every time) plus ``batch_all_kpis``: the
full batch job (enrich once -> enriched parquet -> cube -> all 17 KPI tables
written). ``value`` is the sum over all timed entries. One warm-up query
runs first so JVM start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shiplens.plans import batch, registry  # noqa: E402
from shiplens.session import local_session  # noqa: E402

HEADLINE = (
    "kpi_otif_by_carrier", "kpi_otif_by_region", "kpi_otif_monthly", "kpi_cpo_region_carrier",
    "kpi_cost_monthly", "kpi_edd_by_carrier", "kpi_failed_delivery_region",
    "kpi_failed_delivery_category", "kpi_cross_border_summary", "kpi_corporate_monthly",
    "kpi_savings_simulation", "kpi_savings_by_lever", "kpi_topline_summary",
    "chart_cost_by_region", "surge_months", "wb_otif_by_carrier", "dashboard_cards",
    "routing_guide",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="shiplens-bench")
    registry.run("kpi_otif_by_carrier", spark, sf_dir).collect()  # warm-up

    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        registry.run(name, spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t, 3)

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:  # the cluster's shared folder
        out_dir = os.path.join(shared, f"shiplens-bench-{int(time.time())}")
    else:       # local run: a fresh scratch folder
        out_dir = tempfile.mkdtemp(prefix="shiplens-bench-", dir=os.environ.get("BENCH_TMP", "/tmp"))
    t = time.perf_counter()
    # One enriched file per month suits sf0.1 (about 7k lines a month); at
    # scale pass files_per_month sized to ~256 MB files, or None when the
    # input already arrives clustered by date.
    batch.run_batch(spark, out_dir, sf_dir=sf_dir, files_per_month=1)
    times["batch_all_kpis"] = round(time.perf_counter() - t, 3)

    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
