"""Pareto running share over an aggregated table of any size.

Rows are ordered by the measure descending with the key ascending as
tie-break; every row counts once (a ROWS frame), so tied counts still get
distinct, deterministic cumulative values.

The running sum is a distributed prefix sum: rows are range-partitioned in
that order, each range runs its own sum, and the ranges' totals are added
back to the ranges after them. A range's last row carries its total to the
other ranges (ranges squared rows in all), so the input's plan runs once and
no window spans more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiplens.functions.nullsafe import safe_div

#: Most ranges; their totals are exchanged pairwise.
MAX_RANGES = 64


def pareto_order(key: str, measure: str):
    return [F.col(measure).desc(), F.col(key).asc()]


def with_running(df: DataFrame, order: list[Column], value: Column, running: str, total: str,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """+ ``running``: the sum of ``value`` over a row and all before it in
    ``order`` (which must tell rows apart), and ``total``, over all rows; both
    within equal values of the ``by`` columns."""
    ranges = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES))
    placed = df.repartitionByRange(ranges, *[F.col(c).asc() for c in by], *order).withColumn("__range", F.spark_partition_id())
    own = Window.partitionBy("__range", *by).orderBy(*order)
    summed = placed.withColumns({
        "__sum": F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)),
        "__last": F.lead(F.lit(False), 1, True).over(own)})
    zero = F.col("__sum") - F.col("__sum")
    itself = F.struct(F.col("__range").alias("at"), F.lit(True).alias("row"), zero.alias("before"), zero.alias("whole"))
    told = F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda t: F.struct(
        t.alias("at"), F.lit(False).alias("row"),
        F.when(t > F.col("__range"), F.col("__sum")).otherwise(zero).alias("before"), F.col("__sum").alias("whole")))
    sent = F.when(F.col("__last"), F.concat(F.array(itself), told)).otherwise(F.array(itself))
    there = Window.partitionBy("__to.at", *by)
    return (summed.withColumn("__to", F.explode(sent))
            .withColumns({running: F.col("__sum") + F.sum("__to.before").over(there), total: F.sum("__to.whole").over(there)})
            .where("__to.row").drop("__range", "__sum", "__last", "__to"))


def with_cum_share(agg: DataFrame, key: str, measure: str = "failed_orders",
                   out: str = "cum_pct", by: tuple[str, ...] = ()) -> DataFrame:
    rows = with_running(agg, pareto_order(key, measure), F.col(measure), "__running", "__total", by)
    return rows.withColumn(out, safe_div(F.col("__running"), F.col("__total"))).drop("__running", "__total")


def with_vital_few(pareto: DataFrame, cut: float = 0.8, share: str = "cum_pct") -> DataFrame:
    """Flag the keys inside the cut-off share (the 80 % line)."""
    return pareto.withColumn("vital_few", F.col(share) <= F.lit(cut))


def with_rank(pareto: DataFrame, key: str, measure: str = "failed_orders",
              out: str = "pareto_rank") -> DataFrame:
    return with_running(pareto, pareto_order(key, measure), F.lit(1), out, "__rows").drop("__rows")
