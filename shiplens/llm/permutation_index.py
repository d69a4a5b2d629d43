"""Operator 8: approximate nearest neighbours by a permutation index.

A vector is represented by its permutation: the pivots from nearest to furthest.
Vectors are dealt into segments; a segment posts each vector in every pivot's
inverted file, with the pivot's place in the vector's permutation. A query adds
up, file by file, the differences of places (Spearman's footrule); the smallest
sums of every segment are reranked by the exact inner product. As nearness is
the inner product, permutations are taken after one more component has given
all vectors the same norm.

Pivots are a sample of fixed size; every vector is indexed. Recall of the 20
nearest is measured against brute force in ``tests/llm``, on directions without
any clusters, the hardest case.

A task holds one segment and one block of queries at a time.

Edge cases: rows whose id or vector is null, whose vector is empty, all zero or
holds a null or non-finite component take no part; a shorter vector counts as
filled up with zeros; rows with a query's id are not its candidates, and a
repeated query is answered once; fewer than k candidates are all returned; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiplens.llm.common import saved
from shiplens.llm.vectors import (distances, lifted, matrix, numbered, parts_for, sample_pivots, shape, unpacked,
                                  valid_vectors)

SEGMENT, QUERY_BLOCK, SALTS = 8192, 256, 2
#: Vectors whose places are added up at a time.
FILE_BLOCK = 2048
_RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each pivot's place in each vector's permutation."""
    order = np.argsort(distances(x, pivots), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.uint8 if len(pivots) <= 256 else np.uint16)
    np.put_along_axis(out, order, np.arange(len(pivots), dtype=out.dtype)[None, :], axis=1)
    return out


def inverted(perms: np.ndarray) -> list[np.ndarray]:
    """A segment's files (a row per pivot) cut into blocks that stay in a core's cache."""
    wide = np.uint16 if len(perms) <= 256 else np.uint32  # holds any sum of places
    return [np.ascontiguousarray(perms[:, i:i + FILE_BLOCK], dtype=wide) for i in range(0, perms.shape[1], FILE_BLOCK)]


def footrule(files: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Footrule distance of a query from all vectors of a segment; ``files`` from
    ``inverted``. As the places of any permutation have the same sum, the differences
    add up to twice the larger places less that sum, twice."""
    own = own.astype(files[0].dtype)[:, None]
    larger = [np.maximum(f, own).sum(axis=0, dtype=f.dtype) for f in files]
    return 2 * np.concatenate(larger).astype(np.int64) - len(own) * (len(own) - 1)


def nearest(table: DataFrame, is_query, k: int = 20, pivots: int = 256, rerank: float = 0.06) -> DataFrame:
    """Per query the ``k`` rows of largest inner product found. ``table``:
    (vec_id, embedding); ``is_query``: a condition on vec_id; ``rerank``: the
    share of each segment whose exact inner product is taken (at least 20 k)."""
    rows = valid_vectors(table, zeros=False)
    count, dim, top = shape(rows)
    if not count:
        return rows.sparkSession.createDataFrame([], _RESULT)
    centres = lifted(sample_pivots(rows, pivots, dim), top)
    segments = parts_for(count, SEGMENT)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, no in numbered(batches):
            x = matrix(b["v"], dim)
            yield pd.DataFrame({"vec_id": b["vec_id"], "is_query": b["is_query"], "no": no % (1 << 33) + (no >> 33),
                                "v": [r.tobytes() for r in x]})

    dealt = rows.withColumn("is_query", is_query).mapInPandas(
        deal, "vec_id bigint, is_query boolean, no bigint, v binary")
    dealt = saved(dealt, "permutation_rows").withColumn("segment", F.pmod("no", F.lit(segments)).cast("int"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        x = unpacked(b"".join(g["v"]), dim)
        files = np.ascontiguousarray(places(lifted(x, top), centres).T)
        return pd.DataFrame({"segment": [int(g["segment"].iloc[0])], "ids": [g["vec_id"].astype("<i8").to_numpy().tobytes()],
                             "vecs": [x.tobytes()], "perms": [files.tobytes()]})

    heads = (dealt.groupBy("segment").applyInPandas(pack, "segment int, ids binary, vecs binary, perms binary")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("side", F.lit(0)))

    queries = dealt.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = parts_for(count, QUERY_BLOCK * 20)

    def pack_queries(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in range(0, len(g), QUERY_BLOCK):
            e = g.iloc[s:s + QUERY_BLOCK]
            x = unpacked(b"".join(e["v"]), dim)
            perms = places(np.column_stack((x, np.zeros(len(x)))), centres)
            out.append((e["vec_id"].astype("<i8").to_numpy().tobytes(), x.tobytes(), perms.tobytes()))
        return pd.DataFrame(out, columns=["ids", "vecs", "perms"])

    asks = saved(queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
                 .applyInPandas(pack_queries, "ids binary, vecs binary, perms binary"), "permutation_queries")
    asks = asks.withColumns({
        "segment": F.explode(F.sequence(F.lit(0), F.lit(segments - 1))),
        "salt": F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"), "side": F.lit(1)})

    place = np.uint8 if len(centres) <= 256 else np.uint16

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = vecs = files = None
        for b in batches:
            for side, i, v, p in zip(b["side"], b["ids"], b["vecs"], b["perms"]):
                if side == 0:
                    ids, vecs = np.frombuffer(i, "<i8"), unpacked(v, dim)
                    files = inverted(np.frombuffer(p, place).reshape(len(centres), -1))
                    continue
                qids, q = np.frombuffer(i, "<i8"), unpacked(v, dim)
                perms = np.frombuffer(p, place).reshape(len(qids), -1)
                out = []
                for qid, x, own in zip(qids, q, perms):
                    apart = footrule(files, own)
                    take = min(len(ids), max(20 * k, int(len(ids) * rerank) + 1))
                    at = np.argpartition(apart, take - 1)[:take]
                    at = at[ids[at] != qid]
                    score = vecs[at] @ x
                    best = np.lexsort((ids[at], -score))[:k]
                    out.append((np.full(len(best), qid), ids[at][best], score[best]))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    cols = ["segment", "salt", "side", "ids", "vecs", "perms"]
    found = (heads.select(cols).unionByName(asks.select(cols)).repartition("segment", "salt")
             .sortWithinPartitions("segment", "salt", "side")
             .mapInPandas(search, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
