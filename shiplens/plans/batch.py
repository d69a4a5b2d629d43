"""The batch job: order lines -> enriched lines -> cube -> every KPI table.

1. Read order lines (raw CSV export, or the test tables via the adapter).
2. Enrich them (filter + narrow projections; no shuffle).
3. Write the enriched lines as parquet partitioned by ``order_month``. This
   is the job's lineage cut: later stages re-read shared storage, so a lost
   executor costs a re-read, not a re-run of ingest and enrichment.
4. Build the cube (one hash aggregate with partial aggregation before the
   shuffle; its size is bounded by the key domains) and write it to the work
   folder: ``work_dir``, or the shared folder the session names in
   ``spark.checkpoint.dir``, or one inside the output folder. It is removed
   when the job ends, also when it fails.
5. Derive all KPI tables (and, optionally, the chart / dashboard /
   workbook / finding datasets under ``marts/`` and display-labelled
   workbook CSVs) from the cube and write each one.

6. Publish all tables at once: a manifest written last names them, and readers
   (``sources.publish.read_published``) see one run's tables or the one's before.

Nothing is lost silently: ``ingest_rejects`` (raw export: malformed rows,
values that did not parse; counted while the lines are written, not in a pass
of its own) and ``line_quality`` (lines without a month, lines on the default
zone factor; from the cube) are written next to the KPI tables.

Only step 2-4 touch line-level data; every KPI table costs a scan of the
small cube instead of a scan of the lines.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shiplens.config import DEFAULT_COST, CostParams
from shiplens.operators.enrich import enrich
from shiplens.operators.measures import CUBE, build_cube
from shiplens.operators.reshape import relabel
from shiplens.plans import registry
from shiplens.plans.marts import WORKBOOK_SHEETS
from shiplens.plans.quality import check_rejects, line_quality
from shiplens.sources.publish import drop_old_runs, new_run, publish, run_folder
from shiplens.sources.raw import (RAW_COLUMNS, ingest_rejects, read_raw_csv, reject_counts, rejected_rows,
                                  typed_order_lines)
from shiplens.sources.sinks import read_enriched, remove_path, work_folder, write_enriched, write_kpi
from shiplens.sources.testdata import order_lines_from_tables

# The 17 tables of the source pipeline, in its order.
KPI_TABLES = (
    "kpi_otif_by_carrier", "kpi_otif_by_region", "kpi_otif_monthly", "kpi_cpo_region_carrier",
    "kpi_cost_monthly", "kpi_edd_by_carrier", "kpi_failed_delivery_region",
    "kpi_failed_delivery_category", "kpi_failed_delivery_carrier", "kpi_cross_border_summary",
    "kpi_cross_border_monthly", "kpi_corporate_monthly", "kpi_corporate_category",
    "kpi_monthly_by_segment", "kpi_savings_simulation", "kpi_savings_by_lever",
    "kpi_topline_summary",
)


def mart_tables() -> list[str]:
    """Chart, dashboard, workbook and finding datasets (all cube-derivable)."""
    return [n for n in registry.aggregate_queries() if n not in KPI_TABLES]


def load_order_lines(spark: SparkSession, sf_dir: str | None = None, raw_csv: str | None = None,
                     encoding: str = "ISO-8859-1") -> DataFrame:
    if raw_csv is not None:
        return typed_order_lines(read_raw_csv(spark, raw_csv, encoding))
    if sf_dir is None:
        raise ValueError("give sf_dir (test tables) or raw_csv (raw export)")
    return order_lines_from_tables(spark, sf_dir)


# Our column name -> the raw export's header (for CSVs read by tools that
# expect the export's key names, e.g. "Shipping Mode").
SOURCE_HEADERS = {ours: header for header, (ours, _) in RAW_COLUMNS.items()}


def with_source_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: SOURCE_HEADERS[c] for c in df.columns if c in SOURCE_HEADERS})


def kpi_from_cube(name: str, cube: DataFrame) -> DataFrame:
    q = registry.QUERIES[name]
    return registry.present(q.fn(cube, CUBE), q)


def export_workbook(cube: DataFrame, out_dir: str, parallel_jobs: int = 8) -> dict[str, str]:
    """Each workbook sheet as a header CSV with its display labels."""
    def one(item):
        sheet, (name, labels) = item
        path = os.path.join(out_dir, "workbook", sheet.lower().replace(" ", "_").replace("-", "_"))
        write_kpi(relabel(kpi_from_cube(name, cube), labels), path, "csv")
        return sheet, path

    with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
        return dict(pool.map(one, WORKBOOK_SHEETS.items()))


def run_batch(spark: SparkSession, out_dir: str, sf_dir: str | None = None,
              raw_csv: str | None = None, params: CostParams = DEFAULT_COST,
              tables=KPI_TABLES, kpi_format: str = "parquet", write_lines: bool = True,
              files_per_month: int | None = None, parallel_jobs: int = 8,
              workbook: bool = False, encoding: str = "ISO-8859-1",
              clustered: bool = False, marts: bool = False,
              source_headers: bool = False, work_dir: str | None = None,
              multi_line: bool = False, max_reject_share: float | None = None,
              keep_runs: int = 2, reject_rows: bool = False) -> dict[str, str]:
    """Run the whole pipeline; returns {table name: path}.

    The tables go to a folder of this run and are published together at the end
    (``sources/publish.py``); ``keep_runs`` published runs are kept (0: all).

    ``max_reject_share``: fail before the KPI tables if more than this share of
    the raw rows is malformed or has a value that does not parse.
    ``reject_rows``: also write those rows with the columns at fault (a scan of
    the raw export of its own).
    """
    run_id = new_run()
    with _removed_on_failure(spark, run_folder(out_dir, run_id)) as run_dir:
        paths = _run(spark, run_dir, sf_dir, raw_csv, params, tables, kpi_format, write_lines, files_per_month,
                     parallel_jobs, workbook, encoding, clustered, marts, source_headers,
                     work_dir or work_folder(spark, fallback=os.path.join(out_dir, "_work")), multi_line,
                     max_reject_share, reject_rows)
        publish(spark, out_dir, run_id, paths)
    drop_old_runs(spark, out_dir, keep_runs)
    return paths


@contextmanager
def _removed_on_failure(spark: SparkSession, folder: str):
    try:
        yield folder
    except BaseException:
        remove_path(spark, folder)
        raise


def _run(spark: SparkSession, out_dir: str, sf_dir, raw_csv, params: CostParams, tables, kpi_format: str,
         write_lines: bool, files_per_month, parallel_jobs: int, workbook: bool, encoding: str, clustered: bool,
         marts: bool, source_headers: bool, work: str, multi_line: bool, max_reject_share,
         reject_rows: bool) -> dict[str, str]:
    paths, raw = {}, None
    if raw_csv is not None:
        raw = read_raw_csv(spark, raw_csv, encoding, multi_line)
        # Counted on the rows' way to the enriched lines: the export is parsed once.
        seen, kept = Observation("raw rows"), Observation("kept lines")
        lines = typed_order_lines(raw.observe(seen, *reject_counts(raw)))
        enriched = enrich(lines, params).observe(kept, F.count(F.lit(1)).alias("n"))
    else:
        enriched = enrich(load_order_lines(spark, sf_dir), params)
    if write_lines:
        paths["order_enriched"] = os.path.join(out_dir, "order_enriched")
        write_enriched(enriched, paths["order_enriched"], files_per_month, clustered)
        enriched = read_enriched(spark, paths["order_enriched"])
    cube_path = os.path.join(work, f"shiplens_cube_{uuid.uuid4().hex}")
    with _removed_on_failure(spark, cube_path):
        build_cube(enriched).write.mode("overwrite").parquet(cube_path)
        cube = spark.read.parquet(cube_path).cache()
        paths["line_quality"] = os.path.join(out_dir, "line_quality")
        quality = line_quality(cube, params, CUBE)
        write_kpi(quality, paths["line_quality"], kpi_format)
        if raw is not None:
            rejects = dict(seen.get)
            if kept.get["n"] != quality.first().kept_lines:
                # Tasks that a lost executor made run again were counted again.
                rejects = ingest_rejects(raw).first().asDict()
            paths["ingest_rejects"] = os.path.join(out_dir, "ingest_rejects")
            write_kpi(spark.createDataFrame([rejects], ", ".join(f"{c} bigint" for c in rejects)),
                      paths["ingest_rejects"], kpi_format)
            if reject_rows:
                paths["rejected_rows"] = os.path.join(out_dir, "rejected_rows")
                rejected_rows(raw).write.mode("overwrite").parquet(paths["rejected_rows"])
            if max_reject_share is not None:
                check_rejects(rejects, max_reject_share)
        _write_tables(spark, cube, out_dir, paths, tables, kpi_format, parallel_jobs, marts, workbook, source_headers)
    cube.unpersist()
    remove_path(spark, cube_path)
    return paths


def _write_tables(spark: SparkSession, cube: DataFrame, out_dir: str, paths: dict[str, str], tables, kpi_format: str,
                  parallel_jobs: int, marts: bool, workbook: bool, source_headers: bool) -> None:
    """Every KPI table (and mart, and sheet) from the cube; adds to ``paths``."""

    def one(name: str) -> tuple[str, str]:
        folder = out_dir if name in KPI_TABLES else os.path.join(out_dir, "marts")
        path = os.path.join(folder, name)
        table = kpi_from_cube(name, cube)
        write_kpi(with_source_headers(table) if source_headers else table, path, kpi_format)
        return name, path

    # The table jobs are small and independent: submit a few at once so the
    # scheduler overlaps them.
    names = list(tables) + (mart_tables() if marts else [])
    with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
        paths.update(dict(pool.map(one, names)))
    if workbook:
        paths.update({f"workbook:{k}": v for k, v in export_workbook(cube, out_dir, parallel_jobs).items()})
