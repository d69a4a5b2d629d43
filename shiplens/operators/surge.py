"""Surge detection: months whose volume exceeds mean + k sample std devs.

Runs over a monthly aggregate (one row per month), so the global window
holds at most a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiplens.functions.nullsafe import flag


def with_surge(monthly: DataFrame, measure: str = "orders", k: float = 1.0) -> DataFrame:
    whole = Window.partitionBy()
    out = monthly.withColumns({
        "mean_orders": F.avg(measure).over(whole),
        "std_orders": F.stddev_samp(measure).over(whole),
    })
    out = out.withColumn("surge_threshold", F.col("mean_orders") + F.lit(k) * F.col("std_orders"))
    return out.withColumn("is_surge", flag(F.col(measure) > F.col("surge_threshold")))
