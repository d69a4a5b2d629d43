"""Incremental (Structured Streaming) form of the batch job.

The analysis itself is run-once batch; this package runs the same
enrichment and cube on order-line files as they arrive, so KPI tables can
be refreshed without re-reading history.
"""

from shiplens.streaming.incremental import (
    order_line_stream, start_incremental, cube_rows, compact_cube, kpi_from_deltas,
)

__all__ = ["order_line_stream", "start_incremental", "cube_rows", "compact_cube", "kpi_from_deltas"]
