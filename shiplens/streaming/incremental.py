"""Order-line files -> enriched lines + cube deltas, one micro-batch at a time.

Each micro-batch is enriched (stateless, narrow) and written under
``order_enriched/batch_id=<id>`` (partitioned by month); its cube, built
from that written delta, goes under ``cube/batch_id=<id>``. Both writes
overwrite the batch's own folder, so a replayed batch (after a failure
between the two writes, say) replaces its output instead of adding it
twice. Every cube measure is additive (counts, sums, min, max), so a KPI
over all deltas equals the KPI over all lines. ``compact_cube`` folds the
deltas written so far into one cube, kept under the last batch id it covers;
readers take the newest such cube and the deltas after it, so reads do not grow
with the number of batches. A batch that is being replayed is not folded yet:
compact between runs.
Progress lives in the query's checkpoint location (a shared folder on a
cluster).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shiplens.config import DEFAULT_COST, CostParams
from shiplens.operators.enrich import enrich
from shiplens.operators.measures import CUBE, CUBE_KEYS, build_cube
from shiplens.plans import registry
from shiplens.sources.raw import csv_options, raw_schema, typed_order_lines


def order_line_stream(spark: SparkSession, source_dir: str, header: list[str],
                      encoding: str = "ISO-8859-1", max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of typed order lines from raw CSV files landing in ``source_dir``.

    ``header`` lists the CSV's columns in file order (streams need the
    schema up front); all are read as strings and typed like the batch path.
    """
    r = spark.readStream.schema(raw_schema(header)).options(**csv_options(encoding))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed_order_lines(r.csv(source_dir))


def _write_batch(out_dir: str, params: CostParams):
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines_path = os.path.join(out_dir, "order_enriched", f"batch_id={batch_id}")
        enrich(batch, params).write.mode("overwrite").partitionBy("order_month").parquet(lines_path)
        delta = spark.read.parquet(lines_path)
        (build_cube(delta).write.mode("overwrite")
         .parquet(os.path.join(out_dir, "cube", f"batch_id={batch_id}")))
    return handle


def start_incremental(stream: DataFrame, out_dir: str, checkpoint: str,
                      params: CostParams = DEFAULT_COST, available_now: bool = True,
                      processing_time: str | None = None) -> StreamingQuery:
    """Start the incremental job (``availableNow`` drains what is there)."""
    w = stream.writeStream.foreachBatch(_write_batch(out_dir, params)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def _folded(spark: SparkSession, out_dir: str) -> tuple[DataFrame | None, int]:
    """The newest compacted cube and the last batch id it covers."""
    try:
        done = spark.read.parquet(os.path.join(out_dir, "cube_compact"))
    except AnalysisException:  # nothing compacted yet
        return None, -1
    last = done.agg(F.max("through")).first()[0]
    return (None, -1) if last is None else (done.where(F.col("through") == last).drop("through"), last)


def cube_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest compacted cube and the deltas after it."""
    done, last = _folded(spark, out_dir)
    deltas = spark.read.parquet(os.path.join(out_dir, "cube")).where(F.col("batch_id") > last).drop("batch_id")
    return deltas if done is None else done.unionByName(deltas)


def compact_cube(spark: SparkSession, out_dir: str) -> DataFrame:
    """Fold all cube rows so far into one cube (sums of sums, min of mins);
    KPIs over it equal KPIs over the deltas."""
    through = spark.read.parquet(os.path.join(out_dir, "cube")).agg(F.max("batch_id")).first()[0]
    rows = cube_rows(spark, out_dir)
    how = {"n__": F.sum, "s__": F.sum, "lo__": F.min, "hi__": F.max}
    aggs = [f(c).alias(c) for c in rows.columns for p, f in how.items() if c.startswith(p)]
    path = os.path.join(out_dir, "cube_compact", f"through={through}")
    if _folded(spark, out_dir)[1] < through:
        rows.groupBy(*CUBE_KEYS).agg(*aggs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kpi_from_deltas(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """Any aggregate query of the registry, over the incremental cube."""
    q = registry.QUERIES[name]
    return registry.present(q.fn(cube_rows(spark, out_dir), CUBE), q)
