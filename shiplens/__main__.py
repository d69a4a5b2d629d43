"""Command line: run the batch job.

    python -m shiplens --raw-csv /shared/landing/orders.csv --out /shared/kpi [--workbook] [--csv]
    python -m shiplens --sf-dir /root/testdata/sf0.1 --out /shared/kpi

Uses the active (or a new) SparkSession; ``--input-bytes`` sizes the
shuffle for the expected input volume.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from shiplens.config import CostParams
from shiplens.plans.batch import run_batch
from shiplens.session import configure


def main(argv=None) -> dict:
    ap = argparse.ArgumentParser(prog="shiplens", description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--raw-csv", help="raw order-line export (CSV with header)")
    src.add_argument("--sf-dir", help="folder of the TPC-H-style test tables")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--encoding", default="ISO-8859-1")
    ap.add_argument("--csv", action="store_true", help="write KPI tables as header CSV, not parquet")
    ap.add_argument("--workbook", action="store_true", help="also export the workbook sheets as CSV")
    ap.add_argument("--marts", action="store_true",
                    help="also write the chart / dashboard / workbook / finding datasets")
    ap.add_argument("--no-lines", action="store_true", help="do not write the enriched order lines")
    ap.add_argument("--source-headers", action="store_true",
                    help="name key columns as in the raw export (e.g. 'Shipping Mode'); with --csv")
    ap.add_argument("--files-per-month", type=int, default=None)
    ap.add_argument("--clustered", action="store_true",
                    help="the input arrives clustered by month: write it without a shuffle")
    ap.add_argument("--work-dir", help="shared folder for the cube (default: spark.checkpoint.dir, else --out)")
    ap.add_argument("--multi-line", action="store_true", help="line breaks inside quoted CSV fields")
    ap.add_argument("--max-reject-share", type=float, default=None)
    ap.add_argument("--noise-sigma", type=float, default=CostParams().noise_sigma)
    ap.add_argument("--input-bytes", type=int, default=None)
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName("shiplens").getOrCreate()
    configure(spark, a.input_bytes)
    paths = run_batch(spark, a.out, sf_dir=a.sf_dir, raw_csv=a.raw_csv,
                      params=CostParams(noise_sigma=a.noise_sigma),
                      kpi_format="csv" if a.csv else "parquet", write_lines=not a.no_lines,
                      files_per_month=a.files_per_month, workbook=a.workbook, encoding=a.encoding,
                      clustered=a.clustered, marts=a.marts, work_dir=a.work_dir, multi_line=a.multi_line,
                      max_reject_share=a.max_reject_share,
                      source_headers=a.source_headers and a.csv)
    print(json.dumps(paths, indent=1))
    return paths


if __name__ == "__main__":
    main()
