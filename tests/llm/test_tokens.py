"""Operators 1 and 5: tokenisation, packing, wavelet-matrix files."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shiplens.llm import packing, wavelet
from shiplens.llm.common import new_table_path
from shiplens.llm.queries import QUERIES
from shiplens.llm.tokens import IdEncoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, start bigint, sequence_id string"  # the last two clash with outputs
ODD = ["", " ", "  \n\n ", "it's we'll  don't\t\tx", "ß€ é x  y", "a<|endoftext|>b", "x" * 5000, "1 2  3٣",
       "tail, tail. tail", "\x1cq \x85", "日本 語。", "ªº²½ ×÷", "'s's", "\n\n\nword\n word"]


@pytest.fixture(scope="module")
def encoder():
    return IdEncoder(max_units=50)


def _truth(encoder, texts):
    return {d: ids for d, ids in zip(texts, encoder._ids(["" if t is None else t for t in texts.values()]))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'sdl \n\t.,é1 ²<|>日 ", max_size=30), max_size=5))
def test_units_give_the_ids_of_whole_texts(texts):
    e = _encoder()
    assert e.encode(texts) == e._ids(texts)


def _encoder(cache=[]):
    if not cache:
        cache.append(IdEncoder(max_units=50))
    return cache[0]


def test_odd_texts_give_the_ids_of_whole_texts(encoder):
    assert encoder.encode(ODD) == encoder._ids(ODD) and len(encoder.units) <= 50


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA)


EDGES = [(3, None), (1, ""), (2, "short text"), (None, "no id"), (5, "word " * 9000), (2, "short text"), (7, "word " * 9000)]


def _check_packing(rows, truth, window=2048):
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, ids in truth.items():
        whole = ids + np.array([1], "<u4").tobytes()
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) // 4 and 0 < p.length <= window
            assert p.ids_crc32 == zlib.crc32(whole[4 * at:4 * (at + p.length)])
            at += p.length
        assert at == len(whole) // 4
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_units_are_merged_when_first_asked_for(monkeypatch):
    encoder, seen = IdEncoder(max_units=3), []
    merge = encoder.units.merge
    monkeypatch.setattr(encoder.units, "merge", lambda u: seen.append(u) or merge(u))
    texts = ["a b c d e f a b c d e f", "f e d", ""]
    assert encoder.encode(texts) == encoder._ids(texts) and len(seen) == 8 and len(encoder.units) == 3 and not encoder.units.beyond
    seen.clear()
    assert encoder.encode(texts) == encoder._ids(texts) and len(seen) == 5  # those beyond the table alone


def test_packing_of_the_whole_table(spark, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op1_packing"](spark, SF).collect()
    assert _check_packing(rows, _truth(encoder, {d.doc_id: d.text for d in docs})) == 0
    assert {r.doc_id for r in rows} == {d.doc_id for d in docs}


def test_packing_edges(spark, encoder):
    once = [r for r in EDGES if r[0] not in (2, 7)]
    rows = packing.digest(packing.pack_documents(_docs(spark, once).coalesce(1))).collect()
    assert _check_packing(rows, _truth(encoder, dict(once))) == 0
    twice = packing.pack_documents(_docs(spark, EDGES)).groupBy("doc_id").sum("length").collect()
    assert {d: n for d, n in twice}[2] == 2 * (len(encoder._ids(["short text"])[0]) // 4 + 1)
    assert packing.pack_documents(_docs(spark, [])).collect() == []


def test_sum_of_squares_takes_the_level_with_the_smallest_sum():
    rng = np.random.default_rng(3)
    bins, window = packing.SumOfSquares(64), 64
    for size in rng.integers(1, 64, 400):
        size = int(size)

        def after(level):
            n = bins.count.copy()
            n[level] -= level > 0
            n[level + size] += level + size < window
            return int((n[1:window] ** 2).sum())
        levels = [0] + [h for h in range(1, window - size + 1) if bins.count[h]]
        assert after(bins.level_for(size)) == min(map(after, levels))
        bins.place((0, 0, size, b"\0" * 4 * size))
    drained = list(bins.drain())
    fills = [sum(len(p[-1]) // 4 for p in w) for w in drained]
    assert all(f == window or f & (f - 1) == 0 for f in fills) and sum(f < window for f in fills) <= 6


def test_wavelet_access_rank_select():
    rng = np.random.default_rng(5)
    for high, n in ((50257, 5000), (3, 4100), (1, 1), (70000, 300)):
        ids = rng.integers(0, high, n).astype("<u4")
        f = wavelet.WaveletFile(wavelet.encode_shard(ids, np.array([1, 9]), np.array([n - 1, 1])))
        assert (f.tokens() == ids).all() and f.doc_ids.tolist() == [1, 9] and f.lengths.tolist() == [n - 1, 1]
        for i in rng.integers(0, n, 20):
            assert f.access(int(i)) == ids[i]
            token = int(ids[i])
            assert f.rank(token, int(i)) == int((ids[:i] == token).sum())
        token = int(ids[0])
        where = np.flatnonzero(ids == token)
        assert f.count(token) == len(where) and f.occurrences(token)[:50] == where[:50].tolist()
        assert f.count(1 << 20) == 0 and f.select(token, len(where)) == -1
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"x" * 64)


def test_wavelet_files_of_the_whole_table(spark, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = sorted(QUERIES["op5_wavelet"](spark, SF).collect())
    at = 0
    for (doc, ids), r in zip(_truth(encoder, {d.doc_id: d.text for d in docs}).items(), rows, strict=True):
        whole = ids + b"\0\0\0\0"
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(whole) // 4, zlib.crc32(whole))
        at += r.n_tokens


def test_wavelet_edges(spark, encoder):
    path = new_table_path(spark, "wavelet_test")
    wavelet.write_token_files(_docs(spark, EDGES), path, shard_tokens=100)
    rows = sorted(wavelet.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 5, 7]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert rows[1].ids == b"\0\0\0\0" == rows[4].ids
    empty = new_table_path(spark, "wavelet_test")
    wavelet.write_token_files(_docs(spark, []), empty)
    assert wavelet.read_token_files(spark, empty).collect() == []
