"""Operator 5: token ids as one wavelet-matrix file per shard.

Documents are range-partitioned and sorted by ``doc_id``; each task encodes its
range and cuts it into shards of whole documents. A shard's file holds the
document ids and lengths and a wavelet matrix of the token ids: one bit plane
per bit of an id, most significant first, each plane in the order left by
moving the zeros of the plane before it to the front. With a rank directory per
plane this gives access, rank (counting) and select (occurrence look-up) on the
compressed form. Spark writes and reads the files, so any store it reaches will
do, and a lost task writes its files again.

Edge cases: null text counts as empty (the end id alone); null ``doc_id`` sorts
first; repeated rows are all kept; a document longer than a shard gets a shard
of its own; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiplens.llm.common import chunks_by_bytes
from shiplens.llm.tokens import shared_encoder

MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sIQQ")  # magic, planes, tokens, documents
_PLANE = struct.Struct("<QQB")  # zeros, stored bytes, compressed or not
_BLOCK = 2048  # bits per entry of the rank directory
NULL_ID = -(1 << 63)
FILES = "shard bigint, n_docs bigint, n_tokens bigint, file binary"


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard's file."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    parts = [_HEAD.pack(MAGIC, planes, len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(),
             lengths.astype("<u4").tobytes()]
    seq = ids.astype(np.uint16) if planes <= 16 else ids.astype(np.uint32)
    pack = zstandard.ZstdCompressor(level=1)
    for p in reversed(range(planes)):
        bit = (seq >> seq.dtype.type(p)) & seq.dtype.type(1) == 1
        zeros = seq[~bit]
        raw = np.packbits(bit, bitorder="little").tobytes()
        small = pack.compress(raw)
        smaller = len(small) < 0.97 * len(raw)
        body = small if smaller else raw
        parts += [_PLANE.pack(len(zeros), len(body), smaller), body]
        seq = np.concatenate((zeros, seq[bit]))
    return b"".join(parts)


class WaveletFile:
    """A shard's file, opened from its bytes."""

    def __init__(self, data: bytes):
        magic, planes, self.n, docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.lengths = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.zeros, self.planes, self.ranks = [], [], None
        unpack = zstandard.ZstdDecompressor()
        for _ in range(planes):
            zeros, size, small = _PLANE.unpack_from(data, at)
            at += _PLANE.size
            body = data[at:at + size]
            at += size
            self.zeros.append(zeros)
            self.planes.append(np.frombuffer(unpack.decompress(body) if small else body, np.uint8))

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if self.ranks is None:
            step = _BLOCK // 8
            self.ranks = [np.concatenate(([0], np.cumsum(
                np.add.reduceat(np.bitwise_count(b), np.arange(0, len(b), step), dtype=np.int64))))
                if len(b) else np.zeros(1, np.int64) for b in self.planes]
        b, block = self.planes[plane], i // _BLOCK
        whole = i // 8
        ones = int(self.ranks[plane][block]) + int(np.bitwise_count(b[block * _BLOCK // 8:whole]).sum(dtype=np.int64))
        return ones + (int(b[whole] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        out = 0
        for p, b in enumerate(self.planes):
            bit = (int(b[i // 8]) >> (i % 8)) & 1
            ones = self._rank1(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for p in range(len(self.planes)):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            if (token >> (len(self.planes) - 1 - p)) & 1:
                lo, hi = self.zeros[p] + a, self.zeros[p] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands among the first ``i`` ids."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``; -1 if there is none."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for p in reversed(range(len(self.planes))):
            bit = (token >> (len(self.planes) - 1 - p)) & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last one."""
        seq = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(seq)
            z = self.zeros[p]
            out[~bit] = seq[:z]
            out[bit] = seq[z:] | seq.dtype.type(1 << (len(self.planes) - 1 - p))
            seq = out
        return seq.astype("<u4")


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, shard_tokens: int = 4_000_000,
                      tokenizer: str | None = None) -> None:
    """Write ``docs`` (doc_id, text) as wavelet files in ascending doc_id order.

    ``shard`` numbers ascend with doc_id. ``shard_tokens`` bounds a task's
    memory (and a file's size, but for one longer document).
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(tokenizer)
        shard = TaskContext.get().partitionId() << 32
        docs_in, parts, held = [], [], 0

        def seal():
            nonlocal shard, held
            lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            file = encode_shard(np.frombuffer(b"".join(parts), "<u4"), np.array(docs_in, np.int64), lengths)
            row = pd.DataFrame({"shard": [shard], "n_docs": [len(parts)], "n_tokens": [held], "file": [file]})
            docs_in.clear()
            parts.clear()
            shard, held = shard + 1, 0
            return row

        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for i, j in chunks_by_bytes(texts):
                for doc, b in zip(ids[i:j], encoder.encode(texts[i:j])):
                    b += end
                    if held and held + len(b) // 4 > shard_tokens:
                        yield seal()
                    docs_in.append(doc)
                    parts.append(b)
                    held += len(b) // 4
        if held:
            yield seal()

    (docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"),
                 F.coalesce("text", F.lit("")).alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInPandas(run, FILES).write.option("compression", "none").parquet(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, ``start`` (ids of all documents before
    it), n_tokens, the crc32 of its ids as little-endian unsigned 32-bit
    integers, and those bytes (``ids``; left out without ``with_ids``, so they
    are not shuffled to meet their shard's start)."""
    files = spark.read.schema(FILES).parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, data in zip(batch["shard"], batch["file"]):
                f = WaveletFile(data)
                ids = f.tokens().tobytes()
                ends = np.cumsum(f.lengths)
                for i in range(0, len(ends), 2000):
                    e = ends[i:i + 2000]
                    s = e - f.lengths[i:i + 2000]
                    own = [ids[4 * a:4 * b] for a, b in zip(s, e)]
                    out = pd.DataFrame({"shard": shard, "doc_id": f.doc_ids[i:i + 2000], "inside": s,
                                        "n_tokens": e - s, "ids_crc32": [zlib.crc32(x) for x in own]})
                    yield out.assign(ids=own) if with_ids else out

    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")
    starts = files.select("shard", "n_tokens").select("shard", before.alias("before"))  # a row per file
    rows = files.select("shard", "file").mapInPandas(
        run, "shard bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    return rows.join(starts, "shard").select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

