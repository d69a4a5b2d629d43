"""Publication of a run's tables as one.

A run writes into a folder of its own, ``<out>/runs/<run id>``. When every
table is there, its manifest (table name -> path) is written to a temporary
name and renamed into ``<out>/manifests``: one step, on any store with atomic
renames or puts. Readers take the newest manifest, so they see all tables of
one run or all tables of the run before, never a mix; a run that fails leaves
only an unreferenced folder, which it removes if it still can.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from shiplens.sources.sinks import remove_path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_run() -> str:
    """A run id; later runs sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def run_folder(out_dir: str, run_id: str) -> str:
    return f"{out_dir.rstrip('/')}/runs/{run_id}"


def publish(spark: SparkSession, out_dir: str, run_id: str, tables: dict[str, str]) -> str:
    """Make ``tables`` the ones readers get; returns the manifest's path."""
    folder = f"{out_dir.rstrip('/')}/manifests"
    text = json.dumps({"run": run_id, "tables": tables}, indent=1)
    fs, final = _fs(spark, f"{folder}/{run_id}.json")
    _, draft = _fs(spark, f"{folder}/_{run_id}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(draft, final):
        raise OSError(f"manifest {final} could not be written")
    return final.toString()


def _manifests(spark: SparkSession, out_dir: str) -> list[str]:
    fs, folder = _fs(spark, f"{out_dir.rstrip('/')}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n for n in names if n.endswith(".json"))


def published(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """Table name -> path of the newest published run; empty before the first."""
    names = _manifests(spark, out_dir)
    if not names:
        return {}
    text = spark.read.text(f"{out_dir.rstrip('/')}/manifests/{names[-1]}", wholetext=True).first()[0]
    return json.loads(text)["tables"]


def read_published(spark: SparkSession, out_dir: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table of the newest published run, held to its declared schema and
    key if it is a KPI table."""
    from shiplens.sources.contracts import CONTRACTS
    from shiplens.sources.sinks import read_kpi

    tables = published(spark, out_dir)
    if name not in tables:
        raise KeyError(f"{name} is not among the published tables of {out_dir}")
    return read_kpi(spark, tables[name], fmt, name=name if name in CONTRACTS else None)


def drop_old_runs(spark: SparkSession, out_dir: str, keep: int) -> list[str]:
    """Remove all published runs but the newest ``keep``, manifest first."""
    gone = [n[:-len(".json")] for n in _manifests(spark, out_dir)[:-keep]] if keep > 0 else []
    for run_id in gone:
        remove_path(spark, f"{out_dir.rstrip('/')}/manifests/{run_id}.json")
        remove_path(spark, run_folder(out_dir, run_id))
    return gone
