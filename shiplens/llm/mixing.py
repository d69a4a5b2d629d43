"""Operator 9: mix overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to). A flow network routes each pattern's words to the sources' quotas:
an arc per pattern and copy whose cost rises with the copy (convex repetition
cost), an arc from a pattern to each of its sources, and an arc per source with
its quota. As a unit's cost depends on the copy's arc alone, augmenting copy by
copy gives the minimum cost. A seeded hash then orders each pattern's documents
and the routed words are cut off that order, so at most one document per
pattern is taken in part.

Only pattern totals meet in one task. The cut is found from the totals of hash
ranges; only documents of the range that holds it are ordered.

Edge cases: null ``size`` counts as 0; a null source is a source of its own,
last in order; repeated rows are mixed like others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiplens.llm.common import saved

#: White space here is tab to carriage return, and space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
_PLAN = ("pattern array<string>, copies bigint, rest bigint, cut_range int, before bigint, "
         "shares array<struct<source:string,words:bigint>>, source_size bigint, target double")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: dict, weights: Sequence[float], share: float, most: float) -> dict:
    """Targets by weight that add up to ``share`` of all sizes; a target stops at
    ``most`` times its source's size, the excess is shared anew by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, live, out = share * sum(sizes.values()), list(names), {}
    while live:
        unit = left / sum(weight[s] for s in live)
        over = [s for s in live if unit * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in live}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        live = [s for s in live if s not in out]
    return out


def route(patterns: list[tuple], words: list[int], quotas: dict, most: int) -> list[dict]:
    """Min-cost flow: per pattern, the words it sends to each source.

    Copy ``c`` of a pattern costs more than copy ``c - 1``; the augmenting paths
    of one copy may reroute what earlier ones sent.
    """
    flow = [dict.fromkeys(p, 0) for p in patterns]
    members: dict = {}
    for i, p in enumerate(patterns):
        for s in p:
            members.setdefault(s, []).append(i)
    left = dict(quotas)
    for _ in range(most):
        supply = list(words)
        for i in range(len(patterns)):
            while supply[i] > 0:
                # Breadth first: pattern -> its sources -> patterns that send to them -> ...
                back: dict = {("p", i): None}
                queue, end = deque([("p", i)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    if kind == "p":
                        steps = [("s", s) for s in patterns[x]]
                    else:
                        if left[x] > 0:
                            end = node
                            break
                        steps = [("p", j) for j in members[x] if flow[j][x] > 0]
                    for y in steps:
                        if y not in back:
                            back[y] = node
                            queue.append(y)
                if end is None:
                    break
                path, node = [], end
                while node is not None:
                    path.append(node)
                    node = back[node]
                path.reverse()
                amount = min(supply[i], left[end[1]])
                for a, b in zip(path[1:], path[2:]):
                    if a[0] == "s":
                        amount = min(amount, flow[b[1]][a[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                supply[i] -= amount
                left[end[1]] -= amount
    return flow


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                most: int = 2, seed: int = 7, ranges: int = 4096) -> DataFrame:
    """``docs`` (doc_id, sources array<string>, size) with what the mix takes.

    Adds ``taken`` (words, repeats counted), ``shares`` (per source, the words
    routed from the document's pattern), and the ``source_size`` and ``target``
    of its first source. ``ranges`` is the number of hash ranges the totals of a
    pattern are kept for.
    """
    docs = saved(docs.select(
        F.col("doc_id"), F.array_sort(F.array_distinct("sources")).alias("pattern"),
        F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("draw")), "mix")
    docs = docs.withColumn("range", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(ranges)).cast("int"))

    def plan(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = pd.concat(groups, ignore_index=True)
        if not len(totals):
            return
        patterns = [tuple(p) for p in totals["pattern"]]
        words = [int(sum(r["words"] for r in x)) for x in totals["totals"]]
        sizes: dict = {}
        for p, n in zip(patterns, words):
            for s in p:
                sizes[s] = sizes.get(s, 0) + n
        goal = source_targets(sizes, weights, share * sum(words) / max(1, sum(sizes.values())), most)
        flow = route(patterns, words, {s: round(t) for s, t in goal.items()}, most)
        rows = []
        for p, n, x, f in zip(patterns, words, totals["totals"], flow):
            copies, rest = divmod(sum(f.values()), n) if n else (0, 0)
            before, cut = 0, ranges
            for r in sorted(x, key=lambda r: r["range"]):
                if before + r["words"] > rest:
                    cut = r["range"]
                    break
                before += int(r["words"])
            first = p[0] if p else None
            rows.append((list(p), copies, rest, cut, before, [{"source": s, "words": w} for s, w in f.items()],
                         sizes.get(first, 0), float(goal.get(first, 0.0))))
        yield pd.DataFrame(rows, columns=["pattern", "copies", "rest", "cut_range", "before", "shares",
                                          "source_size", "target"])

    totals = (docs.groupBy("pattern", "range").agg(F.sum("size").alias("words"))
              .groupBy("pattern").agg(F.collect_list(F.struct("range", "words")).alias("totals")))
    plans = saved(totals.repartition(1).mapInPandas(plan, _PLAN), "mix_plan")  # a row per pattern

    held = docs.join(plans, docs["pattern"].eqNullSafe(plans["pattern"])).drop(plans["pattern"])
    held = held.withColumn("base", F.col("copies") * F.col("size"))
    clear = held.where("range <> cut_range").withColumn(
        "taken", F.col("base") + F.when(F.col("range") < F.col("cut_range"), F.col("size")).otherwise(0))
    order = (Window.partitionBy("pattern").orderBy("draw", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    cut = held.where("range = cut_range").withColumn(
        "taken", F.col("base") + F.greatest(F.lit(0), F.least(F.col("size"), room)))
    return clear.unionByName(cut).select("doc_id", "size", F.col("pattern").alias("sources"), "source_size",
                                         "target", "taken", "shares")


def mixed_documents(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """``docs``, all columns, as often as the mix takes them: a row per copy, and
    for a document taken in part one more if at least half of it is taken.
    Documents without words are not taken. Rows that repeat a doc_id are each
    taken as the first of them."""
    rows = docs.select("doc_id", F.array(source).alias("sources"), word_count(F.col("text")).alias("size"))
    taken = mix_sources(rows, **options).where("size > 0 and 2 * taken >= size").groupBy("doc_id").agg(
        F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("__copies"))
    taken = taken.withColumnRenamed("doc_id", "__doc")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("__copies")))
    return (docs.join(taken, docs["doc_id"].eqNullSafe(taken["__doc"]))
            .withColumn("__copy", copies).select(*docs.columns))
