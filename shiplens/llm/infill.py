"""Operator 11: fill-in-the-middle by secondary sort.

A text is cut into units (a word with the white space before it, or white space
at the end). Two places derived from the sha256 of seed and ``doc_id`` part the
units into prefix, middle and suffix; the same hash says whether a document is
transformed at all and in which order its parts come (``psm`` or ``spm``).

Parts are emitted as pieces of at most ``chunk`` units, keyed by document and
output position. The pieces are dealt by document and sorted inside the
partitions (repartition, then sort within partitions); a task streams over them
and feeds each document's pieces to an incremental digest. For restoration a
streaming task reads the output pieces in order, tells the parts apart by the
markers alone, and the pieces are sorted within the partitions once more, now by
place in the text. No task holds more than one piece of a document at a time
after the texts are cut.

Edge cases: a null text counts as empty; a null ``doc_id`` is written as nothing
in the hash; texts that are empty or hold a marker stay plain; rows that repeat
a ``doc_id`` are told apart by a hash of the text, and of identical rows all are
returned; a text of any length is cut whole, but must fit a row before that;
there are no ties, as pieces have distinct positions; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.llm.common import IS_SPACE

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Sections in the order of the text, and their markers.
_MARKERS = (PREFIX, MIDDLE, SUFFIX)
_ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1), "plain": (3,)}
CHUNK = 1024


def unit_ends(text: bytes) -> np.ndarray:
    """Where the units of a UTF-8 text end."""
    space = IS_SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1 if len(space) else np.empty(0, np.int64)
    return np.append(ends, len(text)) if len(space) and space[-1] else ends


def decision(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned numbers from the hash of seed and document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in range(0, 32, 8))


def sections(text: bytes, doc_id, seed: int, rate: int, spm_rate: int):
    """(form, unit ends, unit numbers that end prefix and middle)."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = decision(doc_id, seed)
    n = len(ends)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in _MARKERS) or h3 % 100 >= rate:
        return "plain", ends, 0, 0
    return "spm" if h4 % 100 < spm_rate else "psm", ends, low, high


#: The key of a row: ``known`` is false where doc_id is null (id is then 0), ``hash`` is the text's.
_KEY = ["known", "id", "hash"]
_PIECES = "known boolean, id bigint, hash bigint, position int, form string, units bigint, section int, chars int, piece binary"


def pieces(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Output pieces of every document: ``position`` counts them in output order,
    ``units`` is the document's, ``chars`` the piece's code points without its
    section's marker, which stands in front of a section's first piece."""
    def cut(text: bytes, doc_id):
        form, ends, low, high = sections(text, doc_id, seed, rate, spm_rate)
        n = len(ends)
        bounds = {0: (0, low), 1: (low, high), 2: (high, n), 3: (0, n)}
        at = 0
        for section in _ORDER[form]:
            a, b = bounds[section]
            for i in range(a, max(b, a + 1), chunk):  # a section without units has one empty piece
                j = min(i + chunk, b)
                part = text[0 if i == 0 else ends[i - 1]:ends[j - 1] if j > i else 0]
                marker = _MARKERS[section] if section < 3 and i == a else b""
                yield at, form, n, section, len(part.decode("utf-8")), marker + part
                at += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for known, i, h, text in zip(batch["known"], batch["id"], batch["hash"], batch["text"]):
                for row in cut(bytes(text), i if known else None):
                    out.append((known, i, h, *row))
                    size += len(row[-1])
                    if size > 1 << 22:
                        yield _frame(out)
                        out, size = [], 0
            yield _frame(out)

    def _frame(out):
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])

    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).cast("bigint").alias("id"),
                       F.xxhash64(text).alias("hash"), text.cast("binary").alias("text"))
    return rows.mapInPandas(run, _PIECES)


def sorted_pieces(parts: DataFrame) -> DataFrame:
    """Dealt by document, and in output order inside the partitions."""
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "position")


_READ = ("known boolean, id bigint, hash bigint, copies int, form string, units bigint, prefix_chars bigint, middle_chars bigint, "
         "output_sha256 string, section int, place int, piece binary")


class _Document:
    """What is known of the document whose pieces are being read."""

    def __init__(self, key, form: str, units: int):
        self.key, self.form, self.units = key, form, units
        self.copies, self.position, self.section = 0, -1, 3
        self.chars = [0, 0, 0, 0]
        self.digest = hashlib.sha256()


def _read_back(ordered: DataFrame) -> DataFrame:
    """Streams output pieces: per piece its section, by the markers, and its place
    in it; per document, after its pieces, a row with what was counted."""
    names = [c.split()[0] for c in _READ.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc = None

        def summary():
            return (*doc.key, doc.copies, doc.form, doc.units, doc.chars[0], doc.chars[1], doc.digest.hexdigest(), 9, 0, b"")

        for batch in batches:
            out = []
            for known, i, h, position, form, units, chars, piece in zip(
                    *(batch[c] for c in (*_KEY, "position", "form", "units", "chars", "piece"))):
                key = (known, i, h)
                if doc is None or key != doc.key:
                    if doc is not None:
                        out.append(summary())
                    doc = _Document(key, form, units)
                if position == 0:
                    doc.copies += 1
                if position == doc.position:  # an identical row's piece
                    continue
                doc.position, piece = position, bytes(piece)
                doc.digest.update(piece)
                if form != "plain":
                    mark = piece[:3]
                    if mark in _MARKERS:
                        doc.section, piece = _MARKERS.index(mark), piece[3:]
                doc.chars[doc.section] += chars
                out.append((*key, 0, form, 0, 0, 0, "", doc.section, position, piece))
            yield _frame(out)
        if doc is not None:
            yield _frame([summary()])

    def _frame(out):
        return pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, _READ)


_DIGEST = ("known boolean, id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
           "output_sha256 string, restored_sha256 string")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per row the form, sizes and hashes of its output and of the text restored
    from it, each streamed piece by piece."""
    names = [c.split()[0] for c in _DIGEST.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restored = hashlib.sha256()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.section < 9:
                    restored.update(bytes(row.piece))
                    continue
                out += [(row.known, row.id, row.units, row.form, row.prefix_chars, row.middle_chars, row.output_sha256,
                         restored.hexdigest())] * row.copies
                restored = hashlib.sha256()
            yield pd.DataFrame(out, columns=names)

    # The partitions already hold whole documents: only the order inside them changes.
    by_place = _read_back(sorted_pieces(pieces(docs, **options))).sortWithinPartitions(*_KEY, "section", "place")
    cut = F.col("form") != "plain"
    return by_place.mapInPandas(run, _DIGEST).select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"), "n", "form", F.when(cut, F.col("prefix_chars")).alias("prefix_chars"),
        F.when(cut, F.col("middle_chars")).alias("middle_chars"), "output_sha256", "restored_sha256")


def transformed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, form, text): whole outputs, for documents that fit a row."""
    parts = pieces(docs, **options).dropDuplicates([*_KEY, "position"])
    whole = parts.groupBy(*_KEY).agg(F.first("form").alias("form"), F.array_sort(F.collect_list(
        F.struct("position", F.col("piece").cast("string").alias("piece")))).alias("p"))
    return whole.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "form", F.concat_ws("", "p.piece").alias("text"))
