"""Operator 13: long repeated passages from an enhanced suffix array.

A passage is repeated if its ``least`` bytes start at another place too, in the
same text or in another. Suffixes are sampled by content: of the byte runs of
``gram`` bytes inside every window of ``least`` bytes the one of smallest hash
is the window's anchor (the first of equal ones), so equal windows have their
anchor at the same offset. An anchor serves a run of consecutive windows; these
windows' bytes are its context, cut at the anchor into a left and a right part.
Anchors that stand alone under their hash are dropped, equal contexts are
counted, and only one context of each kind goes on.

The contexts under one hash are then sorted by their right part: a suffix array,
with the common prefixes of neighbours. A stack scan gives its tree of
common-prefix intervals. Inside an interval the left parts are sorted likewise,
and wherever they cease to agree (the left extensions are diverse) a maximal
repeat ends: a group of all the places that hold it. ``repeat_groups`` returns
the groups, ``repeated_spans`` the bytes they cover per text.

Skew: equal contexts become one row by a partial aggregate, so copies cost a
count. A hash with more than ``BUCKET`` kinds of contexts is dealt anew by the
bytes that all windows of a narrower range of offsets have in common, at last by
whole windows, where one kind is left; no group is ever larger than ``BUCKET``.

Edge cases: a null text counts as empty; a text shorter than ``least`` bytes has
no repeats; rows that repeat a text, also under one ``doc_id``, are places like
any other, so both go; a null ``doc_id`` is one like any other; ties are of no
consequence, as all places of a repeat are covered; a text of any length is read
in pieces of a megabyte, but must fit a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.llm.common import drop_saved, is_empty, mix64, saved

#: Most kinds of contexts that one task compares with each other.
BUCKET = 1024
#: Ranges of offsets by which larger groups are dealt anew, one after the other.
NARROWER = (32, 4, 1)
PIECE = 1 << 20
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
_NONE = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)


# ------------------------------------------------------------------- anchors

def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Runs:
    """Hashes of byte runs, each from two prefix sums modulo 2**64; they do not
    depend on where a run stands."""

    def __init__(self, buf: np.ndarray, base: int):
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(values[buf] * _powers(len(buf), base), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = _powers(len(buf) + 1, pow(base, -1, 1 << 64))

    def of(self, start, stop) -> np.ndarray:
        return mix64((self.prefix[stop] - self.prefix[start]) * self.inverse[start])


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values, from running minima
    towards both ends of blocks of that width."""
    blocks = np.concatenate((v, np.full(-len(v) % width, _NONE))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(texts: list[bytes], least: int, gram: int):
    """(text number, key, context hash, place, first and last window) of the
    anchors of all windows of ``least`` bytes; places count from the text's start."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    windows = np.maximum(size - least + 1, 0)
    if not windows.sum():
        none = np.empty(0, np.int64)
        return (none,) * 6
    hashes = _Runs(buf, _BASES[0])
    at = np.arange(len(buf) - gram + 1)
    key = hashes.of(at, at + gram)
    # Ordered by half a hash, then by place: the minimum names the first of equal ones.
    order = key & ~_LOW | at.astype(np.uint64)
    chosen = (_window_minima(order, least - gram + 1) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(windows.sum()) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
    chosen = chosen[start]
    new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = start[np.concatenate((new[1:], [len(start)])) - 1]
    first, place, text = start[new], chosen[new], text[new]
    context = _Runs(buf, _BASES[1]).of(first, last + least)
    context = mix64(context ^ ((place - first) * (1 << 32) + (last - first)).astype(np.uint64))
    own = begin[text]
    return text, key[place].view(np.int64), context.view(np.int64), place - own, first - own, last - own


def _pieces(texts: list[bytes], least: int):
    """(text numbers, offsets, bytes) in lots of about a megabyte; a longer text
    is cut into pieces that overlap so that every window lies in exactly one."""
    lot, size = [], 0
    for n, t in enumerate(texts):
        for offset in range(0, max(len(t) - least + 1, 0), PIECE):
            part = t[offset:offset + PIECE + least - 1]
            lot.append((n, offset, part))
            size += len(part)
            if size >= PIECE:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


_ANCHORS = "id bigint, hash bigint, key bigint, kind bigint, place int, first int, last int"


def _identified(docs: DataFrame) -> DataFrame:
    """(known, id, hash, text as bytes); id and hash name a row's text, known is
    false where doc_id is null."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(-2**63)).alias("id"),
                       F.xxhash64(text).alias("hash"), text.cast("binary").alias("text"))


def _anchor_rows(rows: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes = batch["id"].to_numpy(), batch["hash"].to_numpy()
            for lot in _pieces([bytes(t) for t in batch["text"]], least):
                number, offset = np.array([x[0] for x in lot]), np.array([x[1] for x in lot])
                text, key, kind, place, first, last = anchors([x[2] for x in lot], least, gram)
                row, off = number[text], offset[text]
                yield pd.DataFrame({"id": ids[row], "hash": hashes[row], "key": key, "kind": kind,
                                    "place": place + off, "first": first + off, "last": last + off})

    return (rows.where(F.octet_length("text") >= least).select("id", "hash", "text")
            .mapInPandas(run, _ANCHORS))


# ------------------------------------------------- common-prefix interval tree

def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def intervals(common: list[int]) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a suffix array;
    ``common[i]`` is what entry i has in common with entry i - 1 (0 is not read).
    Every interval is met once, by a stack of the open ones."""
    out, stack = [], []
    for i in range(1, len(common) + 1):
        depth = common[i] if i < len(common) else -1
        left = i - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            out.append((d, left, i - 1))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int):
    """(left length, right length, members) of every maximal repeat of at least
    ``least`` bytes around an anchor. ``lefts`` are the bytes before it, read
    backwards. A group holds all contexts with the repeat; neither side can be
    extended for all of them."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    common = [0] + [common_prefix(rights[order[i - 1]], rights[order[i]]) for i in range(1, n)]
    by_left = sorted(range(n), key=lefts.__getitem__)
    left_common = np.array([0] + [common_prefix(lefts[by_left[i - 1]], lefts[by_left[i]]) for i in range(1, n)])
    rank, place = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[by_left], place[order] = np.arange(n), np.arange(n)
    most = max(map(len, lefts))
    across = np.array(common)
    for depth, first, last in intervals(common):
        if depth + most < least:
            continue
        ranks = np.sort(rank[order[first:last + 1]])
        # What neighbours by left part have in common: the least between their ranks.
        inner = [0, *np.minimum.reduceat(left_common[:ranks[-1] + 1], ranks[:-1] + 1).tolist()]
        for extent, a, b in intervals(inner):
            if extent + depth < least:
                continue
            members = [by_left[r] for r in ranks[a:b + 1]]
            places = np.sort(place[members])
            # If all agree beyond ``depth``, a deeper interval has the group.
            if across[places[0] + 1:places[-1] + 1].min() == depth:
                yield extent, depth, members


def covered(lefts: list[bytes], rights: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """Per context the ranges (low, high) of offsets before the anchor at which a
    repeated window starts."""
    out: list[list[tuple[int, int]]] = [[] for _ in rights]
    for left, right, members in maximal_repeats(lefts, rights, least):
        for m in members:
            out[m].append((least - right, left))
    return [merged(x) for x in out]


def merged(ranges) -> list[tuple[int, int]]:
    """Ranges of whole numbers, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


# -------------------------------------------------------------- Spark stages

def _grouped(kinds: DataFrame, work, schema: str) -> DataFrame:
    """``work(key, rows)`` on the kinds of each key, streamed from sorted partitions."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cut = int(np.searchsorted(held["key"].to_numpy(), held["key"].iloc[-1])) if len(held) else 0
            if cut:
                yield work(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield work(held)

    return kinds.repartition("key").sortWithinPartitions("key").mapInPandas(run, schema)


def _buckets(rows: pd.DataFrame):
    """(kinds, lefts read backwards, rights) of every key of sorted rows."""
    key = rows["key"].to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    kind, left, right = (rows[c].tolist() for c in ("kind", "left", "right"))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield key[a], kind[a:b], [bytes(x)[::-1] for x in left[a:b]], [bytes(x) for x in right[a:b]]


def _scanned(kinds: DataFrame, least: int) -> DataFrame:
    """(key, kind, low, high) of the offsets that other kinds of the key repeat."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, kind, lefts, rights in _buckets(rows):
            for k, ranges in zip(kind, covered(lefts, rights, least)):
                out += [(key, k, a, b) for a, b in ranges]
        return pd.DataFrame(out, columns=["key", "kind", "low", "high"])

    return _grouped(kinds.select("key", "kind", "left", "right"), work, "key bigint, kind bigint, low int, high int")


def _number(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(len(p).to_bytes(4, "little") + p)
    return int.from_bytes(h.digest(), "little", signed=True)


def _narrowed(kinds: DataFrame, least: int, width: int) -> DataFrame:
    """Each context once per range of ``width`` offsets, under a key made of the
    bytes that all windows of that range hold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, kind, left, right in zip(batch["key"], batch["kind"], batch["left"], batch["right"]):
                left, right = bytes(left), bytes(right)
                low, high = least - len(right), len(left)
                for a in range(max(low, 0) // width * width, high + 1, width):
                    b = a + width - 1
                    core = left[len(left) - a:] + right[:max(least - b, 0)] if a <= len(left) else b""
                    near, far = left[len(left) - min(b, high):], right[:least - max(a, low)]
                    out.append((_number(key.to_bytes(8, "little", signed=True), a.to_bytes(4, "little"), core),
                                _number(near, far), near, far, key, kind))
            yield pd.DataFrame(out, columns=["key", "kind", "left", "right", "of_key", "of_kind"])

    return kinds.select("key", "kind", "left", "right").mapInPandas(
        run, "key bigint, kind bigint, left binary, right binary, of_key bigint, of_kind bigint")


def _sized(kinds: DataFrame) -> DataFrame:
    """With ``kinds``, the number of kinds under the key; keys with one are left out."""
    sizes = saved(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "repeat_sizes")
    return kinds.join(sizes, "key")


def _offsets(kinds: DataFrame, least: int, bucket: int, widths: tuple[int, ...] = NARROWER) -> DataFrame:
    """(key, kind, low, high) of all repeated offsets of contexts under keys with
    several kinds. ``kinds``: key, kind, left, right, and kinds, their number."""
    found = _scanned(kinds.where(F.col("kinds") <= bucket), least)
    large = kinds.where(F.col("kinds") > bucket)
    if not widths or is_empty(large):
        return found
    parts = saved(_narrowed(large, least, widths[0]), "repeat_parts")
    own = parts.groupBy("key", "kind").agg(F.count("*").alias("n"), F.first("left").alias("left"),
                                           F.first("right").alias("right"))
    own = saved(own, "repeat_part_kinds")
    below = _offsets(_sized(own), least, bucket, widths[1:])
    alike = own.where("n > 1").select("key", "kind", (least - F.octet_length("right")).alias("low"),
                                      F.octet_length("left").alias("high"))
    back = parts.select("key", "kind", "of_key", "of_kind").join(below.unionByName(alike), ["key", "kind"])
    return found.unionByName(back.select(F.col("of_key").alias("key"), F.col("of_kind").alias("kind"), "low", "high"))


def _repeated_anchors(rows: DataFrame, least: int, gram: int) -> DataFrame:
    every = saved(_anchor_rows(rows, least, gram), "anchors")
    # Written first: between the exchange and the join nothing may stand, or a hot key is not split.
    several = saved(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated_keys")
    some = saved(every.join(several, "key", "left_semi"), "repeated_anchors")
    drop_saved(every)
    drop_saved(several)
    return some


def _kinds(some: DataFrame) -> DataFrame:
    """(key, kind, n, at): the number of anchors of each kind, and one of them."""
    return saved(some.groupBy("key", "kind").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "hash", "place", "first", "last")).alias("at")), "repeat_kinds")


def _contexts(rows: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """One context (left, right) of each kind under keys with several kinds."""
    wanted = _sized(kinds).select("at.id", "at.hash", F.struct(
        "key", "kind", "kinds", "at.place", "at.first", "at.last").alias("w"))
    lists = wanted.groupBy("id", "hash").agg(F.collect_list("w").alias("wanted"))  # at most a text's anchors
    texts = rows.select("id", "hash", "text").join(lists, ["id", "hash"])
    each = texts.select("id", "hash", "text", F.explode("wanted").alias("w"))
    part = each.select("w.key", "w.kind", "w.kinds",
                       F.substring(F.col("text"), F.col("w.first") + 1, F.col("w.place") - F.col("w.first")).alias("left"),
                       F.substring(F.col("text"), F.col("w.place") + 1, F.col("w.last") + least - F.col("w.place")).alias("right"))
    # Rows that repeat a text under one id give the same context again.
    return part.groupBy("key", "kind").agg(*[F.first(c).alias(c) for c in ("kinds", "left", "right")])


def _default_gram(least: int) -> int:
    return max(1, least * 8 // 25)


def repeated_spans(docs: DataFrame, least: int = 400, gram: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(id, hash, start, stop): bytes of texts that some repeat covers, stop
    exclusive; spans of a text may overlap. ``id`` and ``hash`` are those of
    ``_identified``."""
    gram = gram or _default_gram(least)
    rows = _identified(docs)
    some = _repeated_anchors(rows, least, gram)
    kinds = _kinds(some)
    ranges = saved(_offsets(saved(_contexts(rows, kinds, least), "contexts"), least, bucket), "repeat_ranges")
    partial = some.join(ranges, ["key", "kind"]).select(
        "id", "hash", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + least).alias("stop"))
    whole = some.join(kinds.where("n > 1").select("key", "kind"), ["key", "kind"], "left_semi").select(
        "id", "hash", F.col("first").alias("start"), (F.col("last") + least).alias("stop"))
    return partial.unionByName(whole)


def repeat_groups(docs: DataFrame, least: int = 400, gram: int | None = None) -> DataFrame:
    """(repeat, n_bytes, doc_id, start): every place of every maximal repeat
    group around an anchor whose hash has at most ``BUCKET`` kinds of contexts;
    beyond that, and for the bytes covered, see ``repeated_spans``."""
    gram = gram or _default_gram(least)
    rows = _identified(docs)
    some = _repeated_anchors(rows, least, gram)
    every = _kinds(some)
    kinds = saved(_contexts(rows, every, least), "contexts").where(F.col("kinds") <= BUCKET)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, kind, lefts, rights in _buckets(part):
            for left, right, members in maximal_repeats(lefts, rights, least):
                m = members[0]
                name = hashlib.blake2b(lefts[m][:left][::-1] + rights[m][:right], digest_size=16).hexdigest()
                out += [(key, kind[i], name, left, left + right) for i in members]
        return pd.DataFrame(out, columns=["key", "kind", "repeat", "before", "n_bytes"])

    groups = _grouped(kinds.select("key", "kind", "left", "right"), work,
                      "key bigint, kind bigint, repeat string, before int, n_bytes int")
    alike = some.join(every.where("n > 1").select("key", "kind"), ["key", "kind"], "left_semi").select(
        F.concat_ws(":", "key", "kind").alias("repeat"), (F.col("last") + least - F.col("first")).alias("n_bytes"),
        F.when(F.col("id") != -2**63, F.col("id")).alias("doc_id"), F.col("first").alias("start"))
    return some.join(groups, ["key", "kind"]).select(
        "repeat", "n_bytes", F.when(F.col("id") != -2**63, F.col("id")).alias("doc_id"),
        (F.col("place") - F.col("before")).alias("start")).unionByName(alike).distinct()


_KEPT = "known boolean, id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
_DIGEST = "known boolean, id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _without(docs: DataFrame, least: int, schema: str, value, **options) -> DataFrame:
    rows = _identified(docs)
    spans = repeated_spans(docs, least, **options).groupBy("id", "hash").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))  # at most one per anchor and range of a text
    joined = rows.join(spans, ["id", "hash"], "left").select("known", "id", "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for known, i, text, spans in zip(batch["known"], batch["id"], batch["text"], batch["spans"]):
                text = bytes(text)
                gone = merged((s["start"], s["stop"] - 1) for s in spans) if spans is not None else []
                parts, at = [], 0
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b + 1
                kept = b"".join(parts) + text[at:]
                out.append((known, i, len(text), len(text) - len(kept), len(gone), value(kept)))
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return joined.mapInPandas(run, schema).select(F.when(F.col("known"), F.col("id")).alias("doc_id"), *names[2:])


def without_repeats(docs: DataFrame, least: int = 400, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that stay. A cut can
    fall inside a character, so they are not always UTF-8."""
    return _without(docs, least, _KEPT, lambda kept: kept, **options)


def digest(docs: DataFrame, least: int = 400, **options) -> DataFrame:
    """Per row: bytes removed, maximal removed runs, and the hash of what stays."""
    return _without(docs, least, _DIGEST, lambda kept: hashlib.sha256(kept).hexdigest(), **options)
