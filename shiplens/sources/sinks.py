"""Sinks and readers for enriched lines and KPI tables.

Enriched lines are written once, partitioned by ``order_month`` (monthly
KPIs and date slices then prune partitions). KPI tables are small
aggregates; they are written as parquet, with an optional header CSV
export for spreadsheet users.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiplens.sources import contracts


def work_folder(spark: SparkSession, fallback: str) -> str:
    """Where intermediate tables go: the shared folder the cluster names in
    ``spark.checkpoint.dir``, or ``fallback`` where that is unset. Only read,
    never set: a session does not accept it at run time."""
    return spark.conf.get("spark.checkpoint.dir", None) or fallback


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without it a temporary one, but only
    where driver and executors are one machine."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.gettempdir()
    return folder


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_enriched(df: DataFrame, path: str, files_per_month: int | None = None,
                   clustered: bool = False) -> None:
    """Enriched order lines -> parquet partitioned by month (overwrite).

    - default: a REBALANCE hint on the month. AQE splits a hot month (say a
      third of all lines) into advisory-size files and coalesces small months,
      so the number of files follows the data, not tasks times months;
    - ``clustered``: the caller states that the input arrives clustered by
      month; no shuffle, each task writes the months it holds;
    - ``files_per_month``: explicit hash-spreading over (month, bucket), so
      each month gets at most that many files and never a single task.
    """
    if files_per_month:
        bucket = F.pmod(F.xxhash64("line_key"), F.lit(int(files_per_month)))
        df = df.repartition("order_month", bucket)
    elif not clustered:
        df = df.hint("rebalance", "order_month")
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("order_month").parquet(path)


#: Files per month, of less than so many bytes on average, from which a merge deals
#: its months anew.
MANY_FILES, SMALL_FILE = 16, 16 * 1024 * 1024


def _scattered(spark: SparkSession, path: str) -> bool:
    """Whether the month-partitioned table consists of many small files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p)
    files, months = held.getFileCount(), max(1, held.getDirectoryCount() - 1)
    return files > MANY_FILES * months and held.getLength() < SMALL_FILE * files


def merge_enriched(late: DataFrame, path: str, key: str = "line_key") -> list[str]:
    """Late or corrected enriched lines into the month-partitioned table at
    ``path``; returns the months rewritten.

    A line of ``late`` replaces the stored one of its key, also where the month
    has changed. Only months whose rows change are rewritten (dynamic partition
    overwrite, which drops old files once all new ones are written): the others'
    files stay, and a repeated run rewrites none. Stored lines are found by key
    and month alone and are not shuffled: those that stay go from a month's old
    files to its new ones, and late lines are dealt by month. Only a table of
    many small files is dealt anew whole. Of late lines with one key the one of the
    largest row hash counts; lines without a key are added once (equal ones are
    not repeated).
    """
    spark = late.sparkSession
    stored = read_enriched(spark, path).withColumn("order_month", F.col("order_month").cast("string"))
    late = late.select(stored.columns)
    # A month's own null partition reads back as null.
    digest = F.xxhash64(*stored.columns)
    newest = late.groupBy(F.coalesce(key, digest.cast("string")).alias("__key")).agg(F.max_by(F.struct(*stored.columns), digest).alias("r"))
    temp = f"{work_folder(spark, fallback=path + '_merge').rstrip('/')}/shiplens_merge_{uuid.uuid4().hex}"
    newest.select("r.*").write.option("compression", "zstd").parquet(f"{temp}/late")
    fresh = spark.read.schema(stored.schema).parquet(f"{temp}/late")
    same = fresh.where(F.col(key).isNull()).select(digest.alias("__digest")).distinct()
    keyless = stored.where(F.col(key).isNull()).join(same, F.xxhash64(*stored.columns) == F.col("__digest"), "left_anti")
    # Keys that a late line replaces, with the months that hold an older version.
    held = fresh.where(F.col(key).isNotNull()).select(key)
    stored.select(key, "order_month").join(held, key, "left_semi").distinct().write.option("compression", "zstd").parquet(f"{temp}/replaced")
    replaced = spark.read.schema(stored.select(key, "order_month").schema).parquet(f"{temp}/replaced")
    holders = [r[0] for r in replaced.select("order_month").distinct().collect()]  # a row per calendar month at most
    gaining = [r[0] for r in fresh.select("order_month").distinct().collect()]
    touched = list(dict.fromkeys(gaining + holders))

    def among(months: list) -> Column:
        return F.coalesce(F.col("order_month").isin([m for m in months if m is not None]), F.lit(None in months))

    kept = stored.where(F.col(key).isNotNull() & among(touched))
    if holders:
        kept = kept.join(replaced.select(key).distinct(), key, "left_anti")
    kept = kept.unionByName(keyless.where(among(touched)))

    def state(df: DataFrame) -> dict:
        rows = df.groupBy("order_month").agg(F.count("*"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)"))).collect()
        return {r[0]: tuple(r)[1:] for r in rows}

    before, after = state(stored.where(among(touched))), state(kept.unionByName(fresh))
    changed = sorted((m for m in touched if before.get(m) != after.get(m) and m in after), key=str)
    emptied = [m for m in touched if m in before and m not in after]
    if changed:
        if _scattered(spark, path):
            merged = kept.unionByName(fresh).where(among(changed)).hint("rebalance", "order_month")
        else:
            merged = kept.where(among(changed)).unionByName(fresh.where(among(changed)).hint("rebalance", "order_month"))
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy("order_month").parquet(path))
    for m in emptied:  # all its lines moved to another month
        remove_path(spark, f"{path.rstrip('/')}/order_month={m if m is not None else '__HIVE_DEFAULT_PARTITION__'}")
    remove_path(spark, temp)
    return changed + sorted(emptied, key=str)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_kpi(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One KPI table -> parquet (default) or header CSV."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_kpi(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, name: str | None = None) -> DataFrame:
    """A stored KPI table. ``name``: the table it must be; its declared columns,
    types and key are checked (a CSV value that does not fit its type fails the
    read), and columns come in the declared order. ``schema``: for other CSVs."""
    if name is not None:
        return _declared(spark, path, fmt, name)
    if fmt == "csv":
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def _declared(spark: SparkSession, path: str, fmt: str, name: str) -> DataFrame:
    types = dict(contracts.columns(name))
    if fmt == "csv":
        found = spark.read.option("header", True).csv(path).columns
        contracts.check_columns(name, found)
        in_file = ", ".join(f"{c} {types[c]}" for c in found)
        df = spark.read.option("header", True).option("mode", "FAILFAST").schema(in_file).csv(path)
    else:
        df = spark.read.parquet(path)
        contracts.check_columns(name, df.columns, dict(df.dtypes))
    contracts.check_key(name, df)
    return df.select(*types)


def summary_value(summary: DataFrame, metric: str, cast: str = "double") -> Column:
    """Scalar subquery for one metric of a (metric, value) summary table."""
    one = summary.where(F.col("metric") == metric).select(F.col("value").try_cast(cast))
    return one.scalar()
