"""Queries whose answer passes through a source or sink: raw CSV text, the
enriched sink, stored KPI tables. Every call writes to a folder of its own under
the session's work folder, deleted when the application ends, and answers from
what it reads back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiplens.config import RAW_DATE_FORMAT
from shiplens.operators.enrich import enrich
from shiplens.operators.filters import shipped_status
from shiplens.operators.reshape import relabel
from shiplens.plans import kpis, marts
from shiplens.sources.raw import (RAW_COLUMNS, infer_date_format, ingest_rejects, read_raw_csv,
                                  rejected_rows, typed_order_lines)
from shiplens.sources.sinks import (merge_enriched, read_enriched, read_kpi, remove_at_end, shared_folder, write_enriched,
                                    write_kpi)
from shiplens.sources.testdata import order_lines_from_tables

# Kept lines the damaged export spoils (line numbers of the test tables).
BAD_DATE_LINE, BAD_QTY_LINE = 3, 5


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/shiplens_{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    return f"{path}/{name}"


def raw_export(lines: DataFrame) -> DataFrame:
    """Order lines as the raw export's text columns, under its headers."""
    return lines.select([
        (F.date_format(F.col(name), RAW_DATE_FORMAT) if kind == "ts" else F.col(name).cast("string")).alias(header)
        for header, (name, kind) in RAW_COLUMNS.items()])


def _written_export(spark: SparkSession, raw: DataFrame, name: str, **options) -> DataFrame:
    path = _folder(spark, name)
    (raw.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1")
     .option("quote", '"').option("escape", '"').csv(path))
    return read_raw_csv(spark, path, **options)


def csv_roundtrip_otif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: lines -> raw CSV -> ingest -> OTIF by carrier."""
    raw = _written_export(spark, raw_export(order_lines_from_tables(spark, sf_dir)), "raw_export")
    return kpis.otif_by_carrier(enrich(typed_order_lines(raw)))


def csv_ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the reject counts of an export with damaged dates and quantities."""
    raw = raw_export(order_lines_from_tables(spark, sf_dir, ()))
    line_no = F.split(F.col("`Order Item Id`"), "[|]")[1].cast("int")
    raw = raw.withColumns({
        "order date (DateOrders)": F.when(line_no == BAD_DATE_LINE, F.lit("2016-03-13")).otherwise(F.col("`order date (DateOrders)`")),
        "Order Item Quantity": F.when(line_no == BAD_QTY_LINE, F.lit("two")).otherwise(F.col("`Order Item Quantity`"))})
    return ingest_rejects(_written_export(spark, raw, "damaged_export"))


def csv_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged rows of an export themselves, with the columns at fault."""
    raw = raw_export(order_lines_from_tables(spark, sf_dir, ()))
    line_no = F.split(F.col("`Order Item Id`"), "[|]")[1].cast("int")
    raw = raw.withColumn("Sales", F.when(line_no == BAD_QTY_LINE, F.lit("n/a")).otherwise(F.col("Sales")))
    rejected = rejected_rows(_written_export(spark, raw, "damaged_rows"))
    return rejected.select("line_key", F.concat_ws(",", "reasons").alias("reasons"))


def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: categories with quoted line breaks through a splittable read."""
    lines = order_lines_from_tables(spark, sf_dir, ("part",))
    raw = raw_export(lines.withColumn("category_name", F.regexp_replace("category_name", " ", "\n")))
    raw = typed_order_lines(_written_export(spark, raw, "line_breaks", multi_line=True))
    return raw.groupBy("category_name").agg(F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("units"))


def csv_inferred_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of days before months, its format voted for by all its dates."""
    lines = order_lines_from_tables(spark, sf_dir, ())
    day_first = "d/M/yyyy H:mm"
    raw = lines.select([
        (F.date_format(F.col(name), day_first) if kind == "ts" else F.col(name).cast("string")).alias(header)
        for header, (name, kind) in RAW_COLUMNS.items()])
    raw = _written_export(spark, raw, "day_first")
    found = infer_date_format(raw)
    typed = typed_order_lines(raw, found)
    return (typed.groupBy(F.date_format("order_ts", "yyyy-MM").alias("order_month"))
            .agg(F.count(F.lit(1)).alias("lines")).withColumn("date_format", F.lit(found)))


def _by_month(lines: DataFrame) -> DataFrame:
    """Enriched lines, dealt by month before the derived columns are added: the
    narrow rows are shuffled."""
    month = shipped_status(lines).withColumn("order_month", F.date_format("order_ts", "yyyy-MM"))
    return enrich(month.hint("rebalance", "order_month"))


def sink_late_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched sink without its lines of number 1, which come late."""
    path = _folder(spark, "order_enriched_late")
    lines = order_lines_from_tables(spark, sf_dir, ())
    late = F.split(F.col("line_key"), "[|]")[1] == "1"
    write_enriched(_by_month(lines.where(~late)), path, clustered=True)
    merge_enriched(enrich(lines.where(late)), path)
    return kpis.otif_monthly(read_enriched(spark, path).withColumn("order_month", F.col("order_month").cast("string")))


def sink_enriched_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched sink, partitioned by month -> OTIF by month."""
    path = _folder(spark, "order_enriched")
    write_enriched(_by_month(order_lines_from_tables(spark, sf_dir, ())), path, clustered=True)
    return kpis.otif_monthly(read_enriched(spark, path).withColumn("order_month", F.col("order_month").cast("string")))


def _stored(spark: SparkSession, sf_dir: str, table, name: str, fmt: str = "parquet", schema=None) -> DataFrame:
    path = _folder(spark, name)
    write_kpi(table(enrich(order_lines_from_tables(spark, sf_dir, ("customer",)))), path, fmt)
    return read_kpi(spark, path, fmt, schema)


def stored_kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as header CSV, read back as (metric, value)."""
    return _stored(spark, sf_dir, kpis.topline_summary, "kpi_summary", "csv", "metric string, value string")


def stored_kpi_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a chart built from a stored KPI table."""
    return marts.cost_by_region(_stored(spark, sf_dir, kpis.cpo_region_carrier, "kpi_cells"))


def stored_kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the dashboard cards built from the stored summary."""
    stored = _stored(spark, sf_dir, kpis.topline_summary, "kpi_cards", "csv", "metric string, value string")
    return marts.cards(marts.summary_from_stored(stored))


def stored_kpi_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook sheet, under its display labels, from a stored KPI table."""
    stored = _stored(spark, sf_dir, kpis.otif_by_region, "kpi_regions")
    return relabel(stored, {"order_region": "Order Region", "orders": "Orders", "otif_rate": "OTIF Rate",
                            "avg_cost_per_order": "Avg Cost/Order ($)"})
