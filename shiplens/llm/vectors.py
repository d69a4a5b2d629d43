"""Helpers of the two vector searches: valid vectors, pivots, packed blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, zeros: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, a vector,
    every component finite; all-zero vectors only with ``zeros``."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & (F.size("v") > 0))
    return rows if zeros else rows.where(F.exists("v", lambda x: x != 0))


def matrix(rows, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all the squared norm ``top``:
    then a larger inner product with a query is a smaller distance from it."""
    rest = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))
    return np.column_stack((x, rest))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


def shape(rows: DataFrame) -> tuple[int, int, float]:
    """(number of vectors, longest, largest squared norm)."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    return n, dim or 0, top or 0.0


def sample_pivots(rows: DataFrame, count: int, dim: int) -> np.ndarray:
    """``count`` vectors at most, of the smallest hashes; copies of one vector
    count once, however many there are."""
    hashed = rows.select("v", F.xxhash64("v").alias("h"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(count).collect()]
    got = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").collect()
    return matrix([r["v"] for r in got], dim)


def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches with a number per row, different in all tasks."""
    at = TaskContext.get().partitionId() << 33
    for b in batches:
        yield b, np.arange(at, at + len(b))
        at += len(b)


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))
