"""Operator 2: exact top-k inner products by a pivot-distance index.

Vectors get one more component so that all have the same norm; a larger inner
product with a query then means a smaller distance, and the triangle inequality
holds. Each vector is keyed by its nearest pivot and its distance from it; a
block of the index holds one ring (a range of distances) of one pivot, sorted by
distance, large rings dealt into several blocks. A query first searches the block
it lies in, which bounds its k-th score from below. Query blocks then meet only
those blocks whose ring may hold something better, and inside a block expand its
annuli from the nearest, stopping at those whose triangle-inequality bound is
below the k-th score so far. The bounds never drop a tie, so results are exact.

A task holds one index block and one query block at a time. Pivots are a sample
of fixed size; every vector is indexed.

Edge cases: rows whose id or vector is null, whose vector is empty or holds a
null or non-finite component take no part; a shorter vector counts as filled up
with zeros; rows with a query's id are not its candidates, and a repeated query
is answered once, of different vectors for that with the smallest bytes; fewer than k candidates are all returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiplens.llm.common import saved
from shiplens.llm.vectors import distances, lifted, matrix, numbered, sample_pivots, shape, unpacked, valid_vectors

BLOCK, QUERY_BLOCK, SLAB = 4096, 256, 256
_RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where all partial sums are exact."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if big < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


class _Search:
    """One index block against one query block."""

    def __init__(self, ids, dist, vecs, top: float):
        self.ids, self.dist, self.vecs, self.top = ids, dist, vecs, top

    def run(self, qid, q, to_pivot, floor, k):
        n = len(self.ids)
        cuts = list(range(0, n, SLAB)) + [n]
        near, far = self.dist[cuts[:-1]], self.dist[[c - 1 for c in cuts[1:]]]
        # The least possible distance of each query from each annulus, by the triangle inequality.
        gap = np.maximum(0, np.maximum(near[None, :] - to_pivot[:, None], to_pivot[:, None] - far[None, :]))
        norms = (q * q).sum(axis=1)
        bound = (norms[:, None] + self.top - gap * gap) / 2
        bound += 1e-6 * (1 + np.abs(bound))
        floor = floor.astype(float).copy()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(qid)
        for s in np.argsort(gap.min(axis=0), kind="stable"):
            live = np.flatnonzero(bound[:, s] >= floor)
            if not len(live):
                continue
            a, b = cuts[s], cuts[s + 1]
            scores = _scores(q[live], self.vecs[a:b])
            for row, i in zip(scores, live):
                at = np.flatnonzero((row >= floor[i]) & (self.ids[a:b] != qid[i]))
                if not len(at):
                    continue
                ids = np.concatenate((best[i][0], self.ids[a:b][at]))
                both = np.concatenate((best[i][1], row[at]))
                keep = _best(both, ids, k)
                best[i] = ids[keep], both[keep]
                if len(keep) == k:
                    floor[i] = max(floor[i], both[keep[-1]])
        return best


def top_k(rows: DataFrame, is_query, k: int = 5, pivots: int = 16, rings: int = 16) -> DataFrame:
    """Per query the ``k`` rows of highest integer inner product. ``rows``:
    (vec_id, v array<double> of whole numbers); ``is_query``: a condition on vec_id."""
    count, dim, top = shape(rows)
    spark = rows.sparkSession
    if not count:
        return spark.createDataFrame([], _RESULT)
    centres = lifted(sample_pivots(rows, pivots, dim), top)
    width = max(2 * top**0.5 / rings, 1e-9)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, no in numbered(batches):
            x = matrix(b["v"], dim)
            d = distances(lifted(x, top), centres)
            home = d.argmin(axis=1)
            near = d[np.arange(len(d)), home]
            yield pd.DataFrame({"vec_id": b["vec_id"], "is_query": b["is_query"], "no": no, "pivot": home,
                                "ring": (near / width).astype(int), "dist": near, "v": [r.tobytes() for r in x]})

    keyed = saved(rows.withColumn("is_query", is_query).mapInPandas(
        key, "vec_id bigint, is_query boolean, no bigint, pivot int, ring int, dist double, v binary"), "pivot_index")
    # One row per query id asks, whatever blocks its rows come to lie in.
    asking = keyed.where("is_query")
    one = asking.groupBy("vec_id").agg(F.min(F.struct("v", "no")).alias("one")).select("one.no", F.lit(True).alias("one"))
    asking = asking.join(one, "no", "left").withColumn("is_query", F.col("one").isNotNull()).select(*keyed.columns)
    keyed = keyed.where("not coalesce(is_query, false)").unionByName(asking)
    sizes = keyed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = keyed.join(sizes, ["pivot", "ring"]).withColumn("part", F.pmod("no", F.col("parts")))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dist")
        ids, dist, vecs = g["vec_id"].to_numpy(), g["dist"].to_numpy(), unpacked(b"".join(g["v"]), dim)
        at = np.flatnonzero(g["is_query"].fillna(False))
        q, floors = vecs[at], np.full(len(at), -np.inf)
        for i, row in enumerate(_scores(q, vecs)):
            own = np.sort(row[ids != ids[at[i]]])
            if len(own) >= k:
                floors[i] = own[-k]  # the k-th score of the query's own block
        return pd.DataFrame({"pivot": [int(g["pivot"].iloc[0])], "near": [dist[0]], "far": [dist[-1]],
                             "no": [int(g["no"].min())], "ids": [ids.astype("<i8").tobytes()],
                             "dist": [dist.astype("<f8").tobytes()], "vecs": [vecs.astype("<f8").tobytes()],
                             "qids": [ids[at].astype("<i8").tobytes()], "floors": [floors.astype("<f8").tobytes()],
                             "qvecs": [q.astype("<f8").tobytes()]})

    # The join has dealt whole rings; their parts go to tasks of their own.
    blocks = saved(dealt.repartition("pivot", "ring", "part").groupBy("pivot", "ring", "part").applyInPandas(
        pack, "pivot int, near double, far double, no bigint, ids binary, dist binary, vecs binary, "
              "qids binary, floors binary, qvecs binary"), "pivot_blocks")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Query blocks, once per pivot with the distances that may matter there."""
        for b in batches:
            for no, i, f, v in zip(b["no"], b["qids"], b["floors"], b["qvecs"]):
                ids, floor, q = np.frombuffer(i, "<i8"), np.frombuffer(f, "<f8"), unpacked(v, dim)
                for s in range(0, len(ids), QUERY_BLOCK):
                    e = slice(s, s + QUERY_BLOCK)
                    d = distances(np.column_stack((q[e], np.zeros(len(q[e])))), centres)
                    reach = np.sqrt(np.maximum((q[e] * q[e]).sum(axis=1) + top - 2 * floor[e], 0.0)) + 1e-6 * (1 + top**0.5)
                    yield pd.DataFrame({
                        "pivot": np.arange(len(centres)), "lo": (d - reach[:, None]).min(axis=0),
                        "hi": (d + reach[:, None]).max(axis=0), "to_pivot": [c.tobytes() for c in d.T.copy()],
                        "qids": ids[e].tobytes(), "floors": floor[e].tobytes(), "qvecs": q[e].tobytes()})

    asked = saved(blocks.where(F.length("qids") > 0).select("no", "qids", "floors", "qvecs").mapInPandas(
        deal, "pivot int, lo double, hi double, to_pivot binary, qids binary, floors binary, qvecs binary"), "pivot_queries")
    rings_of = blocks.select(F.col("pivot"), "near", "far", F.col("no").alias("block"))
    ask = asked.join(rings_of, "pivot").where("near <= hi and far >= lo").select(
        "block", F.lit(1).alias("side"), F.col("qids").alias("ids"), F.col("to_pivot").alias("dist"),
        F.col("qvecs").alias("vecs"), "floors")
    heads = blocks.select(F.col("no").alias("block"), F.lit(0).alias("side"), "ids", "dist", "vecs",
                          F.lit(None).cast("binary").alias("floors"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for b in batches:
            for side, i, d, v, f in zip(b["side"], b["ids"], b["dist"], b["vecs"], b["floors"]):
                ids, dist, vecs = np.frombuffer(i, "<i8"), np.frombuffer(d, "<f8"), unpacked(v, dim)
                if side == 0:
                    block = _Search(ids, dist, vecs, top)
                    continue
                best = block.run(ids, vecs, dist, np.frombuffer(f, "<f8"), k)
                yield pd.DataFrame({"query_id": np.repeat(ids, [len(x) for x, _ in best]),
                                    "vec_id": np.concatenate([x for x, _ in best]),
                                    "score": np.concatenate([s for _, s in best])})

    found = (heads.unionByName(ask).repartition("block").sortWithinPartitions("block", "side")
             .mapInPandas(search, "query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def whole_numbers(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """The valid vectors with each component x turned into floor(scale * x)."""
    # From 2**53 on every double is whole, and the floor of a large one does not fit a bigint.
    return valid_vectors(table, zeros=True).withColumn("v", F.transform(
        "v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)))
