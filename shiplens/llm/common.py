"""Helpers shared by the operators: tables in the shared work folder, connected
components, and vectorised hashing of words in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


# ---------------------------------------------------------------- work tables

@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="llm-work-")


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a
    folder of our own only where that is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder()


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/llm_{name}_{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of every query run inside go when it ends, and not only when
    the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back: cuts
    the lineage, so a lost executor costs a re-read, and lets its shuffle files go."""
    path = new_table_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete a table made by ``saved`` that no pending plan reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm_" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    with shuffles_dropped(df.sparkSession):
        return not df.take(1)


# ------------------------------------------------------- connected components

def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` of an undirected graph; ``component`` is the
    smallest node reachable.

    ``edges`` has two bigint columns ``u``, ``v``. Large-star / small-star
    rounds: every round rewires each node's neighbours to the smallest one
    known, with min-aggregates and joins only (no neighbour list is ever
    collected), and writes the edge table to the shared folder. Self loops and
    repeated edges are harmless; an empty input gives an empty result.
    """
    first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current, state = saved(first.distinct(), "edges"), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                 F.struct(F.col("u"), F.col("m").alias("v"))))
        small = (large.join(low2, "u").select(pair.alias("p")).select("p.u", "p.v")
                 .where("u <> v").distinct())
        after = saved(small, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_saved(current)
        current = after
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# ---------------------------------------------------------------- word hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 16


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & MASK64, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: ASCII white space: tab to carriage return, and space.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(buf: np.ndarray, separators: np.ndarray = IS_SPACE):
    """(start, end, hash) arrays of the maximal runs of non-separator bytes.

    The hash is a polynomial over the run's bytes modulo 2**64, read off one
    prefix sum for the whole buffer, then mixed; it does not depend on where
    the run stands.
    """
    if not len(buf):
        z = np.empty(0, dtype=np.int64)
        return z, z, np.empty(0, dtype=np.uint64)
    inside = np.concatenate(([False], ~separators[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    n = len(buf)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[buf] * _powers(n, _BASE), dtype=np.uint64, out=prefix[1:])
    inverse = _powers(n, pow(_BASE, -1, 1 << 64))
    h = (prefix[end] - prefix[start]) * inverse[start]
    return start, end, mix64(h ^ (end - start).astype(np.uint64))


def lower_ascii(texts) -> list[bytes]:
    """UTF-8 bytes with A-Z lower-cased; None gives empty bytes."""
    return [b"" if t is None else (t if isinstance(t, bytes) else bytes(t)).lower() for t in texts]


def chunks_by_bytes(texts: list[bytes], limit: int = 1 << 22):
    """Index ranges whose texts sum to about ``limit`` bytes (one long text
    makes a range of its own)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def shingle_batch(texts: list[bytes], width: int = 5):
    """Shingle hashes of several lower-cased texts at once.

    Returns ``(hashes, counts)``: one uint64 per window of ``width`` words (the
    whole word sequence as one where there are fewer; none without words), in
    text order, and the number per text. Repeats are not removed.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, _, h = word_hashes(buf)
    doc = np.searchsorted(ends, start, side="right")
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    n = len(h)
    pos = np.arange(n) - first[doc]
    size = np.minimum(words[doc], width)
    usable = pos + size <= words[doc]
    usable &= (words[doc] >= width) | (pos == 0)
    at = np.flatnonzero(usable)
    out = np.zeros(len(at), dtype=np.uint64)
    k = size[at]
    for i in range(width):
        live = k > i
        src = at + i
        src[~live] = 0
        out[live] = mix64(out[live] * np.uint64(0x9FB21C651E98DF25) + h[src[live]] + np.uint64(i + 1))
    out = mix64(out ^ k.astype(np.uint64))
    return out, np.bincount(doc[at], minlength=len(texts))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per lower-cased text."""
    out = []
    for i, j in chunks_by_bytes(texts):
        h, n = shingle_batch(texts[i:j], width)
        out += [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
    return out
