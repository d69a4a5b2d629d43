"""Spark session settings for these jobs.

On a cluster the session comes from the platform; ``configure`` only sets
what the jobs rely on (AQE with partition coalescing and skew-join
splitting) and, given the expected input size, sizes the shuffle so each
reducer handles about ``TARGET_PARTITION_BYTES`` (partitions that fit in
executor memory instead of spilling). It leaves everything else alone.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def sized_conf(input_bytes: int, shuffled_fraction: float = 0.5) -> dict[str, str]:
    """Settings for an input of ``input_bytes`` (compressed parquet).

    The widest shuffles here are the adapter joins (the lines' projected
    columns, roughly half the input); aggregates shuffle only partial
    results. The number of partitions grows with the input without a cap, so
    a reducer's share does not. Scan splits and reducer partitions both target
    ``TARGET_PARTITION_BYTES``; AQE then coalesces small reducers and splits
    skewed ones (a key holding a third of the rows becomes many tasks).
    """
    shuffled = max(1, int(input_bytes * shuffled_fraction))
    partitions = max(8, math.ceil(shuffled / TARGET_PARTITION_BYTES))
    target = str(TARGET_PARTITION_BYTES)
    return {
        "spark.sql.files.maxPartitionBytes": target,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": target,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * TARGET_PARTITION_BYTES),
    }


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Set the job settings (and, with ``input_bytes``, the shuffle sizing)."""
    conf = dict(JOB_CONF)
    if input_bytes:
        conf.update(sized_conf(input_bytes))
    for k, v in conf.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shiplens",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI and progress bars off)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**JOB_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
