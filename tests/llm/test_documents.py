"""Operators 6 and 7 and the pipeline: near duplicates and lines against brute force."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from shiplens.llm import fuzzy_lines, setsketch
from shiplens.llm.common import connected_components, lower_ascii, shingle_sets
from shiplens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, n_shingles string, line string, a int"  # the last three clash


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 0) for d, t in rows], SCHEMA)


class Groups:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def _words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def _set(text):
    w = _words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    sets, groups = {d: _set(t) for d, t in rows}, Groups()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                groups.link(a, b)
    return {d: (len(s), groups.root(d), groups.root(d) == d) for d, s in sets.items()}


def _found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_near_duplicates_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert _found(QUERIES["op6_setsketch"](spark, SF)) == _brute([(d.doc_id, d.text) for d in docs])


def test_near_duplicate_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(9, None), (8, ""), (7, " \n"), (6, "One two"), (5, "one\ttwo"), (4, "one two three four five"),
            (3, "ONE two three four five"), (2, long), (1, long + " tail"), (11, "É accent"), (12, "é accent")]
    assert _found(setsketch.near_duplicates(_docs(spark, rows))) == _brute(rows)
    odd = _found(setsketch.near_duplicates(_docs(spark, [(None, "same text here"), (1, "same text here"), (1, "same text here")])))
    assert odd[None] == (1, None, True) and odd[1] == (1, 1, True)
    assert setsketch.near_duplicates(_docs(spark, [])).collect() == []
    kept = setsketch.deduplicated(_docs(spark, [(None, "same"), (2, "same"), (1, "same"), (1, "same")]))
    assert sorted((r.doc_id or 0, r.line) for r in kept.collect()) == [(0, "y"), (1, "y")] and kept.columns[3] == "line"


def test_large_group_of_copies_at_every_distance(spark, monkeypatch):
    """One group whose members differ from each other by up to twice the
    threshold's share: chains of links, many pairs that are no links, several
    blocks per bucket."""
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    rnd = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(160):
        w = list(base)
        for i in rnd.sample(range(120), rnd.randint(0, 7)):
            w[i] = f"x{d}_{i}"
        rows.append((d, " ".join(w)))
    assert _found(setsketch.near_duplicates(_docs(spark, rows))) == _brute(rows)


def test_sketch_estimates_and_merges():
    def registers(s):
        return setsketch.registers(s, np.array([len(s)]))[0]
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 6000).astype(np.uint64)
    for share in (0.2, 0.5, 0.75, 0.9):
        n = 3000
        both = int(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate((pool[:both], pool[n:2 * n - both]))
        ra, rb = registers(a), registers(b)
        j = setsketch.estimate([(ra > rb).sum()], [(ra < rb).sum()], [n], [n])[0]
        assert abs(j - both / (2 * n - both)) < 0.16
        assert (setsketch.merged(ra, rb) == registers(np.union1d(a, b))).all()
        assert setsketch.may_link(ra[None], rb[None], np.array([n]), np.array([n]), 0.75)[0] or share < 0.75


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert connected_components(df.where("false")).collect() == []


def test_shingles_do_not_depend_on_the_batch():
    texts = lower_ascii([b"A b c d e f", b"", b"a  B\nc d e", b"x", b"a b c d e f"])
    together, alone = shingle_sets(texts), [shingle_sets([t])[0] for t in texts]
    assert all((x == y).all() for x, y in zip(together, alone)) and [len(s) for s in together] == [2, 0, 1, 1, 2]


# ------------------------------------------------------------------ lines

def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _brute_lines(rows, min_words=5, similarity=0.9):
    """Removed lines per (doc_id, text): exact copies of all lines with words, and
    near ones, by edit similarity alone, of lines of enough words."""
    return _linked_by_edits([(d, t) for d, t in rows if d is not None], min_words)


def test_fuzzy_lines_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    allowed = _linked_by_edits([(d.doc_id, d.text) for d in docs])
    for r in QUERIES["op7_fuzzy_lines"](spark, SF).collect():
        text = docs[r.doc_id].text if docs[r.doc_id].doc_id == r.doc_id else next(d.text for d in docs if d.doc_id == r.doc_id)
        lines, gone = text.split("\n"), set(r.removed_lines)
        worded = {n for n in gone if re.search(rb"[a-z0-9\x80-\xff]", lines[n].encode().lower())}
        assert worded <= set(allowed.get(r.doc_id, []))
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        assert r.text_chars == len(kept) and r.n_removed == len(gone)


def test_fuzzy_line_edges(spark):
    one = "the quick brown fox jumps over the lazy dog beside the extraordinarily picturesque riverbank"
    near = one.replace("lazy", "lazi")
    rows = [(1, f"{one}\n\nshort line\n{one.upper()}!"), (2, f"short line\n{near}\nanother line that stays right here"),
            (3, None), (4, ""), (5, one), (None, one), (6, "\n\n"), (7, "mot " * 20_000)]
    out = fuzzy_lines.without_repeated_lines(_docs(spark, rows))
    assert out.columns == ["doc_id", "text", "n_shingles", "line", "a"]
    got = {r.doc_id: r.text for r in out.collect()}
    want = _brute_lines(rows)
    assert want[1] == [3] and want[5] == [0]
    for d, text in rows:
        if text is None or d is None:
            assert got[d] == text
        else:
            assert got[d] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want.get(d, []))
    assert fuzzy_lines.without_repeated_lines(_docs(spark, [])).collect() == []


def test_simhash_is_the_majority_of_every_bit():
    rng = np.random.default_rng(3)
    counts = np.array([1, 2, 5, 64, 63, 700, 3, 511, 512])
    h = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    got = fuzzy_lines.simhashes(h, counts)
    seeds = fuzzy_lines.mix64(np.arange(1, fuzzy_lines.WORDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    for row, part in zip(got, np.split(h, np.cumsum(counts)[:-1])):
        bits = np.unpackbits(fuzzy_lines.mix64(part[:, None] ^ seeds).view(np.uint8), axis=1, bitorder="little")
        assert (np.unpackbits(row.view(np.uint8), bitorder="little") == (2 * bits.sum(axis=0, dtype=int) > len(part))).all()


def test_block_keys_hold_every_bit_once(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    words = [r.getrandbits(64) - 2**63 for _ in range(6)]
    df = spark.createDataFrame([tuple(words)], ", ".join(f"{c} bigint" for c in fuzzy_lines._SIMS))
    got = df.select(F.array(*fuzzy_lines.blocks_of([F.col(c) for c in fuzzy_lines._SIMS]))).first()[0]
    want = [(k << 20) + (words[k // 3] >> 20 * (k % 3) & 0xFFFFF) for k in range(18)]
    assert list(got) == want


def test_like_pairs_against_all_pairs():
    rng = np.random.default_rng(8)
    check = rng.integers(0, 2**48, 30)
    check = np.concatenate([check] + [check ^ sum(1 << int(b) for b in rng.integers(0, 48, k)) for k in (2, 6, 9, 11, 15)])
    n = len(check)
    key, size, comp = rng.integers(0, 3, n), rng.integers(90, 112, n), np.arange(n) % 7
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and comp[i] != comp[j]
            and abs(size[i] - size[j]) <= int(max(size[i], size[j]) * 0.1 + 1e-9)
            and int(check[i] ^ check[j]).bit_count() <= fuzzy_lines.CHECK_RADIUS}
    a, b, d = fuzzy_lines.like_pairs(key, size, check, np.arange(n), comp, 0.9)
    assert d.tolist() == [int(check[i] ^ check[j]).bit_count() for i, j in zip(a, b)]
    got = list(zip(a.tolist(), b.tolist()))
    assert set(got) == want and len(got) == len(want)
    a, b, _ = fuzzy_lines.like_pairs(key, size, check, np.arange(n), comp, 0.9, True)
    first = set(zip(a.tolist(), b.tolist()))
    assert first <= want and {x for p in first for x in p} == {x for p in want for x in p} and len(first) <= 2 * n


def test_pairs_of_a_large_group_come_in_pieces(monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "HELD_PAIRS", 5000)
    n, zero = 600, np.zeros(600, dtype=np.int64)
    comp = np.arange(n) % 30
    pieces = list(fuzzy_lines.pieces_of_like_pairs(zero, zero + 200, zero, np.arange(n), comp, 0.9))
    assert max(len(p[0]) for p in pieces) < 5000 + n
    assert len({(a, b) for p in pieces for a, b in zip(p[0], p[1])}) == sum(len(p[0]) for p in pieces) == (n * n - n * n // 30) // 2
    many = comp < 2
    pieces = list(fuzzy_lines.pieces_of_like_pairs(zero, zero + 200, zero, np.arange(n), comp, 0.9, many=many))
    assert {(a, b) for p in pieces for a, b in zip(p[0], p[1])} == {
        (a, b) for a in range(n) for b in range(a + 1, n) if comp[a] != comp[b] and (many[a] or many[b])}


def test_one_pair_of_each_two_groups_by_block(spark, monkeypatch):
    """Pairs that two groups of near lines have in one block do not multiply by the groups' lines."""
    rows = [(a, a % 12, 200 + a % 3, 0, *[7] * (fuzzy_lines.WORDS - 1), a % 2 == 0) for a in range(360)]
    lines = spark.createDataFrame(rows, "a bigint, comp bigint, size int, check bigint, "
                                  + ", ".join(f"{c} bigint" for c in fuzzy_lines._SIMS) + ", many boolean")
    for held in (10, 1 << 18):
        monkeypatch.setattr(fuzzy_lines, "HELD_PAIRS", held)
        found = fuzzy_lines._near_lines(lines, 0.9, "components").collect()
        assert {(min(x), max(x)) for x in ((r.a % 12, r.b % 12) for r in found)} == {(i, j) for i in range(12) for j in range(i + 1, 12)}
    assert len(found) <= 66 * 18
    assert fuzzy_lines._near_lines(lines, 0.9, "all").count() == sum(
        1 for a in range(360) for b in range(a + 1, 360) if a % 12 != b % 12 and (a % 2 == 0 or b % 2 == 0))


@pytest.mark.parametrize("give_up", [1, 2, 7, 64])
def test_pairs_given_up_on_the_way(monkeypatch, give_up):
    monkeypatch.setattr(fuzzy_lines, "GIVE_UP", give_up)
    rnd, left, right, most = random.Random(5), [], [], []
    for _ in range(300):
        a = "".join(rnd.choices("abcd", k=rnd.randint(20, 90)))
        b = list(a) if rnd.random() < 0.6 else rnd.choices("abcd", k=len(a))
        for _ in range(rnd.randint(0, 12)):
            k = rnd.randint(0, len(b))
            b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "d"])
        left.append(a)
        right.append("".join(b))
        most.append(rnd.randint(0, 12))
    got = fuzzy_lines.within_edits(left, right, np.array(most))
    assert got.tolist() == [_edits(a, b) <= n for a, b, n in zip(left, right, most)] and 0 < sum(got) < 300


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("stripe", [1, 64, fuzzy_lines.STRIPE])
def test_edits_side_by_side(monkeypatch, stripe):
    monkeypatch.setattr(fuzzy_lines, "STRIPE", stripe)
    rnd, left, right, most = random.Random(3), ["", "", "a", "x" * 300], ["", "ab", "", "x" * 310], [0, 1, 1, 10]
    for _ in range(800):
        a = "".join(rnd.choices("abcd\U0001F600", k=rnd.randint(0, 40)))
        b = list(a)
        for _ in range(rnd.randint(0, 8)):
            k = rnd.randint(0, len(b))
            b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "d"])
        left.append(a)
        right.append("".join(b))
        most.append(rnd.randint(0, 9))
    got = fuzzy_lines.within_edits(left, right, np.array(most))
    assert got.tolist() == [_edits(a, b) <= n for a, b, n in zip(left, right, most)]


def test_group_of_near_lines_at_every_distance(spark):
    """Variants of one line up to beyond the threshold from each other."""
    rnd = random.Random(9)
    base = [f"term{i:03d}" for i in range(60)]
    rows = []
    for d in range(60):
        w = list(base)
        for i in rnd.sample(range(60), rnd.randint(0, 5)):
            w[i] = w[i][:-1] + rnd.choice("xyz")
        rows.append((d, " ".join(w)))
    got = {r.doc_id: list(r.removed) for r in fuzzy_lines.removed_lines(_docs(spark, rows)).collect()}
    assert got == _brute_lines(rows)


def test_lines_of_rows_that_share_an_id(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"{line}\nfirst text only"), (1, line.replace("ten", "teen")), (2, f"precious content that nobody else has written\n{line}"),
            (2, "precious content that stands in the other text of this id"), (3, "x"), (3, "x")]
    out = sorted((r.doc_id, r.text) for r in fuzzy_lines.without_repeated_lines(_docs(spark, rows)).collect())
    assert len(out) == len(rows)
    texts = [t for _, t in out]
    assert sum(t.count("precious") for t in texts) == 2 and sum(line in t or "teen" in t for t in texts) == 1
    assert sorted(t for d, t in out if d == 3) in (["x", "x"], ["", "x"])


def test_grams_rule_out_no_pair_within_the_edits():
    rnd, left, right, most = random.Random(6), ["", "a", "ab" * 400], ["", "", "ba" * 400], [0, 1, 2]
    for _ in range(1500):
        a = "".join(rnd.choices("abcde\U0001F600", k=rnd.randint(0, 60)))
        b = list(a)
        for _ in range(rnd.randint(0, 9)):
            k = rnd.randint(0, len(b))
            b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "d"])
        left.append(a)
        right.append("".join(b))
        most.append(rnd.randint(0, 9))
    got = fuzzy_lines.may_be_within(left, right, np.array(most))
    near = np.array([_edits(a, b) <= n for a, b, n in zip(left, right, most)])
    assert got[near].all() and 0 < near.sum() < len(near)
    words = ["the", "of", "and"] * 30 + ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(3, 8))) for _ in range(300)]
    other = [" ".join(rnd.choices(words, k=90)) for _ in range(100)]
    some = fuzzy_lines.may_be_within(other[:50], other[50:], np.array([len(t) // 10 for t in other[50:]]))
    assert some.sum() <= 10  # lines that share frequent words


def test_a_pair_leaves_the_first_block_it_shares(spark):
    rnd, rows = random.Random(8), []
    words = [rnd.getrandbits(60) for _ in range(fuzzy_lines.WORDS - 1)]
    for a in range(60):
        w = list(words)
        for _ in range(rnd.randint(0, 70)):
            w[rnd.randrange(len(w))] ^= 1 << rnd.randrange(60)
        rows.append((a, a, 200, 0, *w, True))
    lines = spark.createDataFrame(rows, "a bigint, comp bigint, size int, check bigint, "
                                  + ", ".join(f"{c} bigint" for c in fuzzy_lines._SIMS) + ", many boolean")
    mask, want = (1 << 20) - 1, set()
    for x in rows:
        for y in rows[x[0] + 1:]:
            apart = [p ^ q for p, q in zip(x[4:-1], y[4:-1])]
            shared = any(d >> 20 * j & mask == 0 for d in apart for j in range(3))
            if shared and sum(d.bit_count() for d in apart) <= fuzzy_lines.RADIUS:
                want.add((x[0], y[0], sum(d.bit_count() for d in apart)))
    parts = [fuzzy_lines._near_lines(lines, 0.9, "all", k, 6).collect() for k in range(6)]
    got = [(r.a, r.b, r.apart) for part in parts for r in part]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 60 * 59 // 2


@pytest.mark.parametrize("range_bytes", [100, 1 << 25])
def test_pairs_meet_their_texts_by_tiles(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(fuzzy_lines, "RANGE_BYTES", range_bytes)
    rnd = random.Random(11)
    base = "".join(rnd.choices("abcdefgh ", k=60))
    texts = {(1 << 62) + a: _edited(rnd, base, rnd.choice((0.01, 0.03, 0.05))) for a in range(40)}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    got = fuzzy_lines._verified(spark.createDataFrame(list(texts.items()), "a bigint, line_text string"),
                                spark.createDataFrame(pairs, "a bigint, b bigint"), 0.9).collect()
    want = {(a, b) for a, b in pairs if _edits(texts[a], texts[b]) <= int(max(len(texts[a]), len(texts[b])) * 0.1 + 1e-9)}
    assert {(r.u, r.v) for r in got} == want and len(got) == len(want) and 0 < len(want) < len(pairs)


def test_no_shuffle_file_outlives_what_was_saved(spark):
    from shiplens.llm.common import saved

    def files():
        paths = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {x for x in re.findall(r"shuffle_\d+_\d+_\d+\.\w+", paths)}

    before = files()
    out = saved(spark.range(0, 1000, 1, 4).selectExpr("id % 7 k").groupBy("k").count(), "groups")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and sum(r["count"] for r in out.collect()) == 1000


# --------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from shiplens.llm.common import saved

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = saved(stage(spark, before, SF), "stage")
        assert after.schema == docs.schema, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "MinHash near-dedup":
            truth = _brute([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
            assert ids == {d for d, (_, _, kept) in truth.items() if kept}
        before = after
    pieces = P.STAGES[-1][1](spark, before, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before.select("doc_id").collect()}
    empty = docs.where("false")
    for _, stage in P.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.collect() == [] and empty.schema == docs.schema


def test_pipeline_is_registered_and_optional():
    import __spark_entry__ as E

    assert "pipeline" in E.queries() and E.oracle_sql().keys() <= E.queries().keys()
    assert [n for n in E.queries() if n.startswith("op")] == list(QUERIES)
    with pytest.raises(KeyError):
        E.oracle_sql()["pipeline"]


# ------------------------------------------- lines by edit similarity alone

def _near_by_edits(a, b, similarity=0.9):
    """Edit similarity by bit-parallel columns (Python integers as bit vectors)."""
    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    where = defaultdict(int)
    for i, c in enumerate(a):
        where[c] |= 1 << i
    full, top, up, down, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        x, y = eq | down, (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(y | up) & full, up & y
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
        if score - (len(b) - j - 1) > most:
            return False
    return score <= most


def _linked_by_edits(rows, min_words=5):
    """Removed lines per document, of the lines of enough words, by edit similarity alone."""
    occ = []
    for d, text in rows:
        for n, line in enumerate((text or "").encode().lower().split(b"\n")):
            words = re.findall(rb"[a-z0-9\x80-\xff]+", line)
            if words:
                occ.append((d, n, b" ".join(words).decode()))
    lines, groups = sorted({x for _, _, x in occ if x.count(" ") >= min_words - 1}, key=len), Groups()
    bags = np.array([np.bincount(np.frombuffer(x.encode(), np.uint8) & 63, minlength=64) for x in lines])
    sizes = np.array([len(x) for x in lines])
    for i, a in enumerate(lines):
        later = np.flatnonzero((sizes[i + 1:] * 0.9 <= sizes[i] + 1)) + i + 1
        # One edit changes one character, of at most four bytes, for another.
        for j in later[np.abs(bags[later] - bags[i]).sum(axis=1) <= 8 * (0.1 * sizes[later] + 1)]:
            if _near_by_edits(a, lines[j]):
                groups.link(a, lines[j])
    first, gone = {}, defaultdict(set)
    for d, n, norm in sorted(occ):
        if first.setdefault(groups.root(norm), (d, n)) != (d, n):
            gone[d].add(n)
    return {d: sorted(x) for d, x in gone.items()}


def _edited(rnd, line, share):
    out = list(line)
    for i in sorted(rnd.sample(range(len(line)), int(len(line) * share + 1e-9)), reverse=True):
        out[i:i + 1] = rnd.choice(([rnd.choice("xyz")], [], [out[i], rnd.choice("xyz")]))
    return "".join(out)


def test_near_lines_do_not_hang_on_a_word_gate(spark):
    """Single-letter edits all over a line leave few of its words whole: the
    share of pairs found falls with the share of edits (figures in the README)."""
    found = {}
    for share in (0.01, 0.02, 0.04, 0.07):
        rnd, rows = random.Random(7), []
        for d in range(0, 200, 2):
            size = (14, 30, 80)[d // 2 % 3]
            line = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvw", k=rnd.randint(3, 8))) for _ in range(size))
            rows += [(d, line), (d + 1, _edited(rnd, line, share))]
        want = _linked_by_edits(rows)
        assert len(want) == 100
        got = {r.doc_id: list(r.removed) for r in fuzzy_lines.removed_lines(_docs(spark, rows)).collect()}
        assert set(got) <= set(want)
        found[share] = len(got) / len(want)
    print("pairs found by share of edits:", found)
    assert found[0.01] >= 0.85 and list(found.values()) == sorted(found.values(), reverse=True)


def test_near_lines_of_the_whole_table_by_edits_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = _linked_by_edits([(d.doc_id, d.text) for d in docs])
    exact = _linked_by_edits([(d.doc_id, d.text) for d in docs], min_words=10**9)
    got = {r.doc_id: list(r.removed_lines) for r in QUERIES["op7_fuzzy_lines"](spark, SF).collect() if r.n_removed}
    near = {(d, n) for d, x in want.items() for n in x} - {(d, n) for d, x in exact.items() for n in x}
    found = {(d, n) for d, x in got.items() for n in x}
    print(f"near lines found: {len(near & found)} of {len(near)}")
    assert near and len(near & found) >= 0.9 * len(near)
    assert {(d, n) for d, x in exact.items() for n in x} <= found


def test_copies_of_short_unspaced_and_wordless_lines(spark):
    han = "本网站所有内容版权归原作者所有未经许可不得转载或用于商业用途谢谢合作请勿复制"
    thai = "สงวนลิขสิทธิ์ห้ามคัดลอกเนื้อหาโดยไม่ได้รับอนุญาตจากเจ้าของเว็บไซต์"
    rows = [(1, f"All rights reserved\n\n{han}\n----\nchapter 10\n{thai}"),
            (2, f"one\n all rights reserved.\n \n{han}\n ---- \nchapter 11\n{thai}"),
            (3, f"====\n{han.replace('谢谢', '多谢')}\n\n{thai[:-2]}\n本网站"), (4, "本网站\n本网络")]
    got = {r.doc_id: list(r.removed) for r in fuzzy_lines.removed_lines(_docs(spark, rows)).collect()}
    assert got == {2: [1, 3, 4, 6], 3: [1, 3], 4: [0]}
