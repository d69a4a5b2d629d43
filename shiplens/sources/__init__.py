"""Readers and writers.

- ``raw``: the raw order-line CSV (header, latin-1) -> typed ``order_lines``
- ``testdata``: the TPC-H-style test tables -> ``order_lines``
- ``sinks``: enriched-line and KPI sinks / readers (parquet, CSV export)
"""

from shiplens.sources.raw import RAW_COLUMNS, read_raw_csv, typed_order_lines, ingest_rejects
from shiplens.sources.testdata import order_lines_from_tables
from shiplens.sources.sinks import (
    write_enriched, read_enriched, write_kpi, read_kpi, summary_value, work_folder,
)

__all__ = [
    "RAW_COLUMNS", "read_raw_csv", "typed_order_lines", "ingest_rejects",
    "order_lines_from_tables", "write_enriched", "read_enriched", "write_kpi",
    "read_kpi", "summary_value", "work_folder",
]
