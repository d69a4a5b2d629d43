"""Operator 12: groups of spelling variants by dense prefix-suffix tiling.

Words are counted over the whole corpus; those of at least ``min_length`` code
points and ``min_count`` occurrences are the vocabulary. Two words are near if
one inserted, deleted or replaced code point turns one into the other: common
prefix and common suffix together then reach the longer length minus one.

Words are laid out as rows of padded code-point matrices, one aligned at the
first and one at the last code point, and blocks of rows are compared as a
whole: the first column where two rows differ is their common prefix, or suffix.
Only blocks that can hold near words meet. Of two near words, the longer of
length M, either the first (M - 1) // 2 or the last M - 1 - (M - 1) // 2 code
points agree, so words are dealt by these halves, for M their own length and one
more; a pair that agrees in both is taken from the first. A half that many words
share is cut into blocks of ``block`` words by the words' hashes, and its pairs
of blocks are dealt out as tiles of their own, so no task holds more than two
blocks of a tile at once.

A word's form is its near word of most occurrences (ties: the smallest in
code-point order) if that has at least ``ratio`` times as many as the word. A
form occurs more often than its word, so following forms ends; ``root`` is where.

Edge cases: null and empty texts hold no words; a null ``doc_id`` is written as
nothing where it is hashed; repeated rows count again; texts and words of any
length are taken whole; an empty table, or one without vocabulary, gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.llm.common import saved

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: Distinct words a task counts before it hands them on.
HELD = 200_000
BLOCK = 512


def altered(word: bytes, crc: int, every: int) -> bytes:
    """``word`` without one code point if ``every`` divides the hash."""
    if crc % every:
        return word
    text = word.decode("utf-8")
    at = crc % len(text)
    return (text[:at] + text[at + 1:]).encode("utf-8")


def word_counts(docs: DataFrame, every: int = 199) -> DataFrame:
    """(word, n) of the words of all texts, one in ``every`` (document, word)
    misspelt by rule; counted in the tasks before anything is shuffled."""
    def rows(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode("utf-8") for w in counts], "n": list(counts.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                start = zlib.crc32(name.encode() + b":")
                for word, n in Counter(_RUN.findall(bytes(text).lower())).items():
                    crc = zlib.crc32(word, start)
                    held[word if crc % every else altered(word, crc, every)] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    texts = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows from the first code point on, rows from the last one backwards,
    lengths); padded with 0, which no word holds."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    front = np.zeros((len(words), int(size.max(initial=0))), dtype=np.uint32)
    inside = np.arange(front.shape[1]) < size[:, None]
    front[inside] = flat
    column = size[:, None] - 1 - np.arange(front.shape[1])
    back = np.where(inside, np.take_along_axis(front, np.maximum(column, 0), axis=1), 0) if front.size else front
    return front, back, size


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of leading columns in which rows agree, over the last axis."""
    differ = x != y
    return np.where(differ.any(axis=-1), differ.argmax(axis=-1), differ.shape[-1])


def near_in_tile(first: tuple, second: tuple, longer: int, by_prefix: bool):
    """Row numbers (i, j) of near words of two blocks of code-point rows, the
    longer of length ``longer``. ``by_prefix`` false: without the pairs that their
    first half finds as well."""
    (fa, ba, na), (fb, bb, nb) = first, second
    length = np.minimum(na[:, None], nb[None, :])
    prefix = np.minimum(_agree(fa[:, None, :], fb[None, :, :]), length)
    suffix = np.minimum(_agree(ba[:, None, :], bb[None, :, :]), length)
    near = (prefix + suffix >= longer - 1) & (np.maximum(na[:, None], nb[None, :]) == longer)
    near &= ~((prefix == na[:, None]) & (na[:, None] == nb[None, :]))  # a word is not near itself
    if not by_prefix:
        near &= prefix < (longer - 1) // 2
    return np.nonzero(near)


def _halves(words: DataFrame) -> DataFrame:
    """(key, word, n): a word under both halves of either longer length."""
    size = F.length("word")
    keys = []
    for more in (0, 1):
        head = F.floor((size + more - 1) / 2).cast("int")
        tail = (size + more - 1 - head).cast("int")
        keys += [F.concat_ws(":", (size + more).cast("string"), F.lit("p"), F.substring(F.col("word"), F.lit(1), head)),
                 F.concat_ws(":", (size + more).cast("string"), F.lit("s"), F.right("word", tail))]
    return words.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def _tiles(words: DataFrame, block: int) -> DataFrame:
    """(key, i, j, side, word, n): tile (i, j) of a half holds its blocks i and j."""
    halves = _halves(words)
    sizes = halves.groupBy("key").agg(F.count("*").alias("words")).where("words > 1")
    blocks = F.ceil(F.col("words") / block).cast("int")
    own = halves.join(sizes, "key").select("key", "word", "n", blocks.alias("blocks"),
                                           F.pmod(F.xxhash64("word"), blocks).cast("int").alias("own"))
    return own.select("key", "word", "n", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("side"), "word", "n")


_NEAR = "word string, n bigint, near string, near_n bigint"


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): every near pair of ``words`` (word, n), both ways."""
    def pairs(rows: pd.DataFrame):
        keys, word, n = rows["key"].to_numpy(), rows["word"].to_numpy(), rows["n"].to_numpy()
        i, j, side = (rows[c].to_numpy() for c in ("i", "j", "side"))
        front, back, size = code_points(word.tolist())
        new = (keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = np.flatnonzero(np.concatenate(([True], new, [True])))
        alone = i == j
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            longer, kind, _ = keys[a].split(":", 2)
            m = a if alone[a] else a + int(np.searchsorted(side[a:b], True))
            if alone[a]:
                x = y = np.arange(a, b)
            else:
                x, y = np.arange(a, m), np.arange(m, b)
            if not len(x) or not len(y):
                continue
            wide = int(size[a:b].max())
            step = max(1, (1 << 22) // (len(y) * wide))  # rows of x whose comparison takes a few megabytes
            for at in range(0, len(x), step):
                p = x[at:at + step]
                u, v = near_in_tile((front[p, :wide], back[p, :wide], size[p]), (front[y, :wide], back[y, :wide], size[y]),
                                    int(longer), kind == "p")
                yield word[p[u]], n[p[u]], word[y[v]], n[y[v]]
                if not alone[a]:
                    yield word[y[v]], n[y[v]], word[p[u]], n[p[u]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            same = (held["key"] == last["key"]) & (held["i"] == last["i"]) & (held["j"] == last["j"])
            cut = len(held) - int(same.sum())
            if cut:
                yield from found(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield from found(held)

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        parts = [p for p in pairs(rows) if len(p[0])]
        if parts:
            yield pd.DataFrame({c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(("word", "n", "near", "near_n"))})

    order = ["key", "i", "j", "side", "word"]
    return _tiles(words, block).repartition("key", "i", "j").sortWithinPartitions(*order).mapInPandas(run, _NEAR)


#: Doublings that follow any chain of forms: each step multiplies n by ``ratio`` > 1, at 5 at most 27 steps to 2**63.
DOUBLINGS = 5


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, every: int = 199,
             block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary."""
    if ratio < 5:
        raise ValueError("ratio: 5 at least, so that DOUBLINGS reach the end of a chain")
    counts = word_counts(docs, every)
    words = saved(counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count)), "vocabulary")
    near = near_words(words, block)
    # Most occurrences, then the smallest word: strings are ordered by code point.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    per_word = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(per_word, "word", "left")
    has = -F.col("best.less") >= F.col("n") * ratio
    rows = saved(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                              F.when(has, F.col("best.near")).alias("form"),
                              F.when(has, -F.col("best.less")).alias("form_n")), "word_forms")
    ahead = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = saved(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(ahead, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
