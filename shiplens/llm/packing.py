"""Operator 1: sum-of-squares online packing of documents into token windows.

Each document becomes token ids plus an end id. Whole windows are cut off its
front; what remains (shorter than a window) is placed online: among the fill
levels of the partially filled windows, and an empty window, the level is taken
that leaves the smallest sum of squared counts of partially filled windows per
level. The counts are one level array; a task holds the ids of its partially
filled windows only. When a task's input ends, windows that are still partial
are drained: their pieces are re-cut into whole windows, and the last remainder
into powers of two, so no padding is needed at all.

Packing runs inside the scan's tasks: no shuffle, no group, no driver state.

Edge cases: null text counts as empty; an empty document is the end id alone;
null and repeated ``doc_id`` rows are packed like any other; a text of any
length is cut into as many windows as it needs; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.llm.common import chunks_by_bytes
from shiplens.llm.tokens import shared_encoder

PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, ids binary")


class SumOfSquares:
    """The level array and the partially filled windows of one task."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # partially filled windows per level
        self.open: list[list] = [[] for _ in range(window)]  # per level: windows, each a list of pieces

    def level_for(self, size: int) -> int:
        """The fill level that minimises the sum of squares after placing
        ``size`` ids; ties go to the fullest. 0 opens a window."""
        n, top = self.count, self.window - size
        best, change = 0, 2 * n[size] + 1 if size < self.window else 0
        if top > 0:
            if n[top] and 1 - 2 * n[top] <= change:  # fills a window up
                best, change = top, 1 - 2 * n[top]
            if top > 1:
                there = n[1:top]
                grow = np.where(there > 0, 2 * (n[1 + size:self.window] - there) + 2, np.iinfo(np.int64).max)
                at = top - 2 - int(grow[::-1].argmin())
                if grow[at] < change or (grow[at] == change and best != top):
                    best = at + 1
        return best

    def place(self, piece) -> list | None:
        """Put a piece (its ids last) into a window; the window if it is full now."""
        size = len(piece[-1]) // 4
        level = self.level_for(size)
        pieces = [piece]
        if level:
            self.count[level] -= 1
            pieces = self.open[level].pop()
            pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.count[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def drain(self) -> Iterator[list]:
        """Windows for all pieces still open: whole ones, then powers of two."""
        rest = [p for level in self.open for pieces in level for p in pieces]
        left = sum(len(p[-1]) // 4 for p in rest)
        window: list = []
        size = lambda: self.window if left >= self.window else 1 << (left.bit_length() - 1)
        room = goal = size() if left else 0
        for doc, start, total, ids in rest:
            while ids:
                take = min(room, len(ids) // 4)
                window.append((doc, start, total, ids[:4 * take]))
                ids, start, room = ids[4 * take:], start + take, room - take
                if not room:
                    yield window
                    left -= goal
                    window = []
                    room = goal = size() if left else 0


def pack_documents(docs: DataFrame, window: int = 2048, end_id: int = 1,
                   tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their place: ``PIECES``.

    ``start`` counts the document's ids before the piece, ``offset`` the
    sequence's; ``ids`` holds the piece's ids as little-endian unsigned 32-bit.
    ``sequence_id`` is the task's number times 2**33 plus a running number.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, bins = shared_encoder(tokenizer), SumOfSquares(window)
        next_id = TaskContext.get().partitionId() << 33
        rows: list = []

        def seal(pieces):
            nonlocal next_id
            at = 0
            for doc, start, total, ids in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, total, next_id, at, ids))
                at += n
            next_id += 1

        def flush():
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id",
                                              "offset", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        for batch in batches:
            doc_ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            texts = batch["text"].tolist()
            for i, j in chunks_by_bytes(texts):
                for doc, ids in zip(doc_ids[i:j], encoder.encode(texts[i:j])):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % window
                    for s in range(0, whole, window):
                        seal([(doc, s, total, ids[4 * s:4 * (s + window)])])
                    if whole < total and (full := bins.place((doc, whole, total, ids[4 * whole:]))):
                        seal(full)
                if rows:
                    yield flush()
        for pieces in bins.drain():
            seal(pieces)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
