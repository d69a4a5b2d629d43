"""Operator 6: near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles. Register i of its sketch is
``floor(1 - log_b(x))`` of the smallest of exponential values x that hash i gives
the shingles, cut to 0..q+1: sketches of parts merge by the larger register, and
registers agree the likelier the more similar two sets are. Equal sets meet in
one representative. Bands of registers are the join keys for candidates; for a
pair the similarity is estimated by maximum likelihood from the numbers of
larger, equal and smaller registers and both set sizes; pairs not clearly below
the threshold are confirmed on the full sets.

No bucket emits its pairs. Links only have to connect components, so a bucket
first compares each member with one other: with its smallest member, then, where
members are not yet connected, with one drawn by hash. What is still apart in a
bucket after that is compared in full: the bucket is dealt into blocks, a task
compares the registers of two blocks, each pair at the first band it shares, and
passes on the members that have a partner; the sets of those are then compared
block by block, and one link between any two components comes out.

Chance of missing a link at the threshold: (1 - 0.75**4)**32 or 5e-6 per pair.

Edge cases: null or empty text, or text without words, has an empty set and is
linked with nothing; fewer words than a shingle make one shingle of all of them;
sets, not ids, are compared, so rows with one ``doc_id`` and different texts are
one document with the union of their links, each returned with its own set size;
texts of any length are taken whole, ties do not arise, as links are unordered; a null ``doc_id`` is linked with nothing
(``component_id`` null, kept); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiplens.llm.common import (chunks_by_bytes, connected_components, drop_saved, is_empty, lower_ascii, mix64,
                                 saved, shingle_batch, shingle_sets)

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.05, 20.0, 65534  # b, a and q of the sketch
SALTS = 16
BLOCK = 256


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def registers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sketches (documents x REGISTERS, uint16) of consecutive runs of
    shingle hashes; repeats do not matter. Runs must not be empty."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), REGISTERS), dtype=np.uint16)
    low = hashes ^ (hashes >> np.uint64(32))
    for i, f in enumerate(_factors()):
        h = low * f
        least = np.minimum.reduceat(h ^ (h >> np.uint64(29)), starts)
        # The smallest of n exponential variables of rate a, from the smallest of n uniform hashes.
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, i] = np.clip(np.floor(1.0 - np.log(x) / math.log(BASE)), 0, TOP + 1)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _p(x):
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def estimate(larger, smaller, n_a, n_b) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from how many registers
    of a are larger and smaller than b's, and the set sizes."""
    larger, smaller, n_a, n_b = (np.asarray(x, dtype=float) for x in (larger, smaller, n_a, n_b))
    equal = REGISTERS - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)

    def likelihood(j):
        up, down = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    for _ in range(40):  # the likelihood is concave in j
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = likelihood(a) > likelihood(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


def may_link(regs_a, regs_b, n_a, n_b, threshold: float) -> np.ndarray:
    """Whether pairs are not clearly (five standard errors) below the threshold."""
    j = estimate((regs_a > regs_b).sum(axis=1), (regs_a < regs_b).sum(axis=1), n_a, n_b)
    error = math.sqrt(threshold * (1 - threshold) / REGISTERS)
    fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    return fits & (j >= threshold - 5 * error)


_SKETCH = "doc_id bigint, row bigint, n_shingles bigint, set_a bigint, set_b bigint, regs binary, bands array<bigint>"


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): set size, a 128-bit digest of the set,
    registers, and a hash per band."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            texts = lower_ascii(batch["text"])
            ids = batch["doc_id"].astype("Int64")
            for i, j in chunks_by_bytes(texts, 1 << 20):
                sets = shingle_sets(texts[i:j], width)
                sizes = np.array([len(s) for s in sets])
                out = pd.DataFrame({"doc_id": ids[i:j], "row": batch["row"][i:j], "n_shingles": sizes, "set_a": 0, "set_b": 0})
                regs, bands = [None] * (j - i), [None] * (j - i)
                some = np.flatnonzero(sizes)
                if len(some):
                    flat = np.concatenate([sets[k] for k in some])
                    at = np.cumsum(sizes[some]) - sizes[some]
                    digest = [np.add.reduceat(mix64(flat ^ np.uint64(x)), at).view(np.int64) for x in (0x5BF0, 0xC2B2)]
                    out.loc[out.index[some], "set_a"], out.loc[out.index[some], "set_b"] = digest
                    r = registers(flat, sizes[some])
                    key = np.repeat(seeds[None, :], len(some), axis=0)
                    for c in range(ROWS):
                        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + r[:, c::ROWS].astype(np.uint64))
                    for k, row, keys in zip(some, r, key.view(np.int64)):
                        regs[k], bands[k] = row.tobytes(), keys
                out["regs"], out["bands"] = regs, bands
                yield out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                       F.xxhash64("text").alias("row")).mapInPandas(run, _SKETCH)


def _passing(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers pass the estimate."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("regs").alias(f"r{x}"),
                                 F.col("n_shingles").alias(f"n{x}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ra, rb = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            yield b.loc[may_link(ra, rb, b["na"].to_numpy(), b["nb"].to_numpy(), threshold), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) similar enough on their full sets.

    b's set goes ahead of all its partners' to each salt they are dealt to, so a
    task streams: it holds one set of b and a batch of texts.
    """
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    pairs = pairs.select("a", "b", salt.alias("salt"))
    members = pairs.join(texts, pairs["a"] == texts["rep"]).select("b", "salt", F.lit(1).alias("part"), "a", "text")
    heads = (pairs.select("b", "salt").distinct().join(texts, F.col("b") == texts["rep"])
             .select("b", "salt", F.lit(0).alias("part"), F.col("b").alias("a"), "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, None
        for batch in batches:
            found = []
            data = lower_ascii(batch["text"])
            for i, j in chunks_by_bytes(data):
                sets = shingle_sets(data[i:j], width)
                for a, b, part, s in zip(batch["a"][i:j], batch["b"][i:j], batch["part"][i:j], sets):
                    if part == 0:
                        held, own = b, s
                        continue
                    if held != b:
                        raise RuntimeError("a pair's set is missing")
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if 100 * both >= round(100 * threshold) * (len(s) + len(own) - both):
                        found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"])

    return (members.unionByName(heads).repartition("b", "salt").sortWithinPartitions("b", "salt", "part")
            .mapInPandas(run, "a bigint, b bigint"))


_GROUP = ["key", "i", "j"]
_BLOCKED = "key bigint, i int, j int, band int, rep bigint, comp bigint, own int"


def _whole_groups(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``_GROUP`` as frames of whole groups, of about ``rows`` rows."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) < rows:
            continue
        all_rows = pd.concat(held, ignore_index=True)
        last = (all_rows[_GROUP] == all_rows[_GROUP].iloc[-1]).all(axis=1).to_numpy()
        cut = int(last.argmax())
        if cut:
            yield all_rows.iloc[:cut]
        held = [all_rows.iloc[cut:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _groups_of(rows: pd.DataFrame) -> np.ndarray:
    """A number per row that grows with each group of sorted rows."""
    g = rows[_GROUP].to_numpy()
    return np.concatenate(([0], np.cumsum((g[1:] != g[:-1]).any(axis=1))))


def _across(rows: pd.DataFrame, limit: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of each group that lie in different components (and,
    between two blocks, in different blocks), some at a time."""
    group, comp = _groups_of(rows), rows["comp"].to_numpy()
    own, two = rows["own"].to_numpy(), (rows["i"] != rows["j"]).to_numpy()
    at, step, x, y, size = np.arange(len(rows)), 0, [], [], 0
    while len(at):
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        to = at + step
        take = (comp[at] != comp[to]) & (~two[at] | (own[at] != own[to]))
        x.append(at[take])
        y.append(to[take])
        size += int(take.sum())
        if size >= limit or not len(at):
            a, b = np.concatenate(x), np.concatenate(y)
            for k in range(0, len(a), limit):
                yield a[k:k + limit], b[k:k + limit]
            x, y, size = [], [], 0


def _with_partners(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows of blocked buckets that have a partner of another component in
    their group which passes the estimate, at the first band the two share. No
    pair leaves the task: a group gives at most its rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_groups(batches, 20_000):
            regs = np.frombuffer(b"".join(part["regs"]), np.uint16).reshape(-1, REGISTERS)
            band, n = part["band"].to_numpy(), part["n_shingles"].to_numpy()
            found = np.zeros(len(part), dtype=bool)
            for x, y in _across(part):
                same = (regs[x] == regs[y]).reshape(-1, BANDS, ROWS).all(axis=2)
                keep = same.argmax(axis=1) == band[x]
                x, y = x[keep], y[keep]
                if len(x):
                    pass_ = may_link(regs[x], regs[y], n[x], n[y], threshold)
                    found[x[pass_]] = True
                    found[y[pass_]] = True
            yield part.loc[found, ["key", "i", "j", "band", "rep", "comp", "own"]]

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInPandas(run, _BLOCKED)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by a product of 0/1 matrices over the
    shingles that more than one set holds."""
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    ids, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    live = times[at] > 1
    who, col = who[live], shared[at[live]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, (lo, lo + 4096))
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[who[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _confirmed_blocks(rows: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (a, b) across components of each group, confirmed on the full sets.
    Of links between the same two components one is enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_groups(batches, 1):
            found = []
            for _, g in part.groupby(_groups_of(part)):
                sets = shingle_sets(lower_ascii(g["text"]), width)
                size = np.array([len(x) for x in sets])
                both = _common(sets)
                linked = 100 * both >= round(100 * threshold) * (size[:, None] + size[None, :] - both)
                comp, rep = g["comp"].to_numpy(), g["rep"].to_numpy()
                x, y = np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1))
                pairs = {(min(comp[i], comp[j]), max(comp[i], comp[j])): (rep[i], rep[j]) for i, j in zip(x, y)}
                found += pairs.values()
            yield pd.DataFrame(found, columns=["a", "b"])

    return (rows.join(texts, "rep").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
            .select("key", "i", "j", "rep", "comp", "text").mapInPandas(run, "a bigint, b bigint"))


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, comp, ...) of buckets dealt into blocks, once for each pair
    of blocks (i, j) that their own block is part of. The component with most rows
    of a bucket has nothing to find in itself: its blocks meet only the others'."""
    per_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = per_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"))
    few = F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int")
    many = F.ceil(F.col("most.n") / BLOCK).cast("int")
    sizes = sizes.select("key", F.col("most.comp").alias("main"), few.alias("few"), many.alias("many"))
    rows, drawn = rows.join(sizes, "key"), F.xxhash64("rep", "key")
    main = F.col("comp") == F.col("main")
    rows = rows.withColumn("own", F.when(main, F.col("few") + F.pmod(drawn, F.col("many"))).otherwise(F.pmod(drawn, F.col("few"))).cast("int"))
    last = F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("few", "many", "main", "other")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_shingles``, ``component_id`` and
    ``kept``. Two documents are linked where their sets' Jaccard similarity is
    ``threshold`` (in whole percents) or more."""
    sk = saved(sketches(docs, width), "sketch")
    # Equal sets are one node, named by the set's digest.
    rep = F.xxhash64("set_a", "set_b", "n_shingles").alias("rep")
    some = sk.where("n_shingles > 0 and doc_id is not null")
    groups = saved(some.groupBy(rep).agg(
        F.min(F.struct("doc_id", "row")).alias("at"), F.first("n_shingles").alias("n_shingles"),
        F.first("regs").alias("regs"), F.first("bands").alias("bands")), "sets")

    # Buckets of two or more representatives.
    members = groups.select("rep", F.posexplode("bands").alias("band", "key"))
    full = members.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("least"),
                                      F.min_by("rep", F.xxhash64("rep", "key")).alias("drawn")).where("members > 1")
    buckets = saved(members.join(full, "key"), "buckets")
    links = None
    if not is_empty(buckets):
        ids = buckets.select("rep").distinct()
        some_groups = groups.join(ids, "rep")
        reps = saved(some_groups.select("rep", "regs", "n_shingles"), "regs")
        wanted = some_groups.select("rep", "at.doc_id", "at.row")
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"),
                            F.col("text").cast("binary").alias("text"))
        # Rows that repeat an id and a text are one row of it.
        texts = saved(texts.join(wanted, ["doc_id", "row"]).select("rep", "text").dropDuplicates(["rep"]), "texts")

        def compare(pairs: DataFrame, so_far: DataFrame | None) -> DataFrame:
            found = _confirmed(saved(pairs, "pairs"), texts, threshold, width).select(F.col("a").alias("u"), F.col("b").alias("v"))
            return saved(found if so_far is None else found.unionByName(so_far), "links")

        def apart(components: DataFrame) -> DataFrame:
            """Bucket rows with their components, of buckets that span several."""
            comp = components.select(F.col("node").alias("rep"), F.col("component"))
            rows = (buckets.join(comp, "rep", "left")
                    .withColumn("comp", F.coalesce("component", "rep")).drop("component"))
            spans = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            return rows.join(spans.select("key"), "key")

        star = buckets.where(f"band < {ROWS} and rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
        links = compare(_passing(star, reps, threshold), None)
        rows = saved(apart(connected_components(links)), "apart")
        comp_of_drawn = rows.select("key", F.col("rep").alias("drawn"), F.col("comp").alias("drawn_comp"))
        star = (rows.join(comp_of_drawn, ["key", "drawn"]).where("comp <> drawn_comp")
                .select(F.greatest("rep", "drawn").alias("a"), F.least("rep", "drawn").alias("b")).distinct())
        links = compare(_passing(star, reps, threshold), links)
        rows = apart(connected_components(links)).select("key", "band", "rep", "comp")
        rows = saved(_with_partners(_blocked(rows.join(reps, "rep")), threshold), "partners")
        found = _confirmed_blocks(rows, texts, threshold, width).select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = saved(found.unionByName(links), "links")
    out = sk.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), rep).alias("rep"))
    if links is not None:
        comp = connected_components(links)
        out = out.join(comp, out["rep"] == comp["node"], "left").withColumn("rep", F.coalesce("component", "rep"))
    out = saved(out.select("doc_id", "n_shingles", "rep"), "set_components")
    # A document with rows in several components joins these.
    linked = out.where("doc_id is not null and rep is not null")
    spread = linked.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    across = saved(linked.join(spread, "doc_id").where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")), "across")
    if not is_empty(across):
        comp = connected_components(across)
        linked = linked.join(comp, linked["rep"] == comp["node"], "left").withColumn("rep", F.coalesce("component", "rep"))
        out = out.join(comp, out["rep"] == comp["node"], "left").withColumn("rep", F.coalesce("component", "rep"))
    first = linked.groupBy("rep").agg(F.min("doc_id").alias("first"))
    out = out.select("doc_id", "n_shingles", "rep").join(first, "rep", "left")
    component = F.coalesce("first", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """``docs``, all columns, with one document of each group, and one row of
    those that repeat a doc_id with its text."""
    found = saved(near_duplicates(docs, threshold, width), "near")
    dropped = found.where("not kept").select("doc_id").distinct()
    out = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    if not is_empty(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")):
        out = out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id is null"))
    return out
