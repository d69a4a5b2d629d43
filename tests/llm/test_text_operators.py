"""Operators 3, 4, 9 and 10 against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiplens.llm import mixing, reply_trees, sanitize, toxicity
from shiplens.llm.queries import QUERIES

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _rows(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet").collect()


# --------------------------------------------------------------- toxicity

def test_toxicity_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, SF_MORE).collect()}
    docs = _rows(spark, SF_MORE, "documents")
    labels = {r.doc_id: r.toxic for r in _rows(spark, SF_MORE, "labels")}
    assert set(rows) == {d.doc_id for d in docs}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(labels[d], r.predicted) for d, r in rows.items() if r.held_out and d in labels]
    hits = sum(y and p for y, p in held)
    assert hits >= 0.6 * sum(y for y, _ in held)  # few labels of each language at this size
    assert sum(p for y, p in held if not y) <= 0.02 * len(held)


def _brute_segments(x):
    """All maximal-scoring segments: the best one, then those of both sides."""
    best = max(((sum(x[a:b]), -a, b - a) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0),
               key=lambda t: (round(t[0], 9), -t[2], t[1]))
    if best[0] <= 1e-9:
        return []
    a, b = -best[1], -best[1] + best[2]
    return [*_brute_segments(x[:a]), (a, b - 1), *[(a2 + b, b2 + b) for a2, b2 in _brute_segments(x[b:])]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.37, 2.91, 4.13]), max_size=24))
def test_segment_scan_finds_all_maximal_segments(positives):
    model = toxicity.Model(other=-0.731)
    got = model.segments([(i, w) for i, w in enumerate(positives) if w], len(positives))
    assert [(a, b) for a, b, _ in got] == _brute_segments([w or -0.731 for w in positives])


def test_toxicity_edges(spark):
    calm = "some calm words that stand here without any harm in them " * 5
    docs = spark.createDataFrame([(i, f"{calm}{i}" if i % 2 else f"awful brutish nasty {calm}{i}", "z") for i in range(200)]
                                 + [(300, None, "z"), (301, "", "z"), (None, "awful nasty brutish", "z"), (5, f"{calm}5", "z")],
                                 "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(3, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {}
    for r in toxicity.score_documents(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[300][0].score == got[301][0].score <= got[1][0].score < 0.3 and len(got[5]) == 2
    assert got[2][0].score > 0.7 and got[None][0].score > 0.7
    p = got[2][0].passages[0]
    assert f"awful brutish nasty {calm}"[p.start:p.end] == "awful brutish nasty"
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(1, 200, 2), 300, 301}
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(docs.where("false"), model).collect() == []


# ------------------------------------------------------------ reply trees

def test_conversations_round_trip(spark):
    table = {}
    for r in sorted(_rows(spark, SF, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        table.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    say = "<|im_end|><|im_start|>assistant ok"
    table[-1] = [("user", say), ("assistant", say)]
    got = {r.conv_id: r for r in QUERIES["op4_reply_trees"](spark, SF).collect()}
    assert set(got) == set(table)
    for c, turns in table.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(t) for _, t in turns)


TREES = "tree bigint, node bigint, parent bigint, score double, role string, text string, branch string"


def _nodes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TREES)


def test_best_branches_of_trees(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 2.0, "assistant", "b"),
            (1, 4, 2, 5.0, "user", "c"), (1, 5, 3, 1.0, "user", "d"), (1, 6, 3, 1.0, "user", "e"),
            (2, 1, 9, 1.0, "user", "orphan"),  # its parent is missing: a root
            (3, 1, 2, 1.0, "user", "x"), (3, 2, 1, 1.0, "user", "y"),  # a cycle: left out
            (4, 1, None, None, "user", None)]
    got = {(r.tree, r.branch, r.position): r.node for r in reply_trees.best_paths(_nodes(spark, rows), keep=2).collect()}
    assert got == {(1, 1, 0): 1, (1, 1, 1): 2, (1, 1, 2): 4,  # 0 + 1 + 5
                   (1, 2, 0): 1, (1, 2, 1): 3, (1, 2, 2): 5,  # 0 + 2 + 1; node 6 ties and is larger
                   (2, 1, 0): 1, (4, 1, 0): 1}
    texts = {(r.tree, r.branch): r.text for r in reply_trees.conversation_texts(
        reply_trees.format_conversations(_nodes(spark, rows))).collect()}
    assert texts[(1, 1)] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert reply_trees.best_paths(_nodes(spark, [])).collect() == []


def test_deep_tree(spark):
    rows = [(1, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(130)]
    got = sorted((r.position, r.node) for r in reply_trees.best_paths(_nodes(spark, rows)).collect())
    assert got == [(i, i) for i in range(130)]


def test_escapes_are_reversible(spark):
    parts = ["<|", "<\\|", "<\\\\|", "\\", "<", "|", "im_end|>", "\n", "a", "<|im_start|>"]
    texts = ["".join(p) for n in range(4) for p in itertools.product(parts, repeat=n)]
    rows = [(i, 1, None, 1.0, t[:12], t) for i, t in enumerate(texts)]
    for r in reply_trees.format_conversations(_nodes(spark, rows)).collect():
        inner = r.piece[len("<|im_start|>"):-len("<|im_end|>\n")]
        assert "<|" not in inner.replace("<\\|", "") or "<|im_end|>" not in inner
        assert reply_trees.parse_piece(r.piece) == (texts[r.tree][:12], texts[r.tree])


def test_conversation_edges(spark):
    """Null ids, roles and texts, repeated rows, extra columns, empty tables."""
    rows = [(None, 1, "user", "a"), (1, 2, "assistant", None), (1, 1, None, "b"), (1, 2, "assistant", None), (None, None, "x", "y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn int, role string, text string, node int")
    got = {r.conv_id: r for r in reply_trees.digest(reply_trees.format_conversations(reply_trees.linear_turns(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"\nb\nassistant\n\nassistant\n\n").hexdigest()
    assert reply_trees.format_conversations(reply_trees.linear_turns(df.where("false"))).collect() == []


# ----------------------------------------------------------------- mixing

def test_mix_of_the_whole_table(spark):
    docs = {d.doc_id: d for d in _rows(spark, SF, "documents")}
    rows = QUERIES["op9_mixing"](spark, SF).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in docs.items()}
    sources = sorted({r.source for r in docs.values()})
    total = {s: sum(n for d, n in size.items() if docs[d].source == s) for s in sources}
    target, budget, live = {}, 1.5 * sum(size.values()), list(sources)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    while True:
        share = {s: budget * weight[s] / sum(weight[x] for x in live) for s in live}
        full = [s for s in live if share[s] > 2 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * total[s]
            budget -= target[s]
            live.remove(s)
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        s = docs[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in sources)
    assert sorted(QUERIES["op9_mixing"](spark, SF).collect()) == sorted(rows)


def test_flow_is_cheapest_for_overlapping_sources():
    """All ways to route small patterns: the least number of second copies."""
    patterns, words = [("a",), ("a", "b"), ("b", "c")], [2, 2, 2]
    quotas = {"a": 4, "b": 1, "c": 2}
    flow = mixing.route(patterns, words, quotas, 2)
    got = {s: sum(f.get(s, 0) for f in flow) for s in quotas}
    assert got == quotas
    cost = sum(max(0, sum(f.values()) - n) for f, n in zip(flow, words))
    best = min(sum(max(0, sum(x) - n) for x, n in zip(((a1,), (a2, b2), (b3, c3)), words))
               for a1 in range(5) for a2 in range(5) for b2 in range(5) for b3 in range(5) for c3 in range(5)
               if a2 + b2 <= 4 and b3 + c3 <= 4 and a1 + a2 == 4 and b2 + b3 == 1 and c3 == 2)
    assert cost == best == 1


def test_mix_edges(spark):
    rows = [(1, ["a"], 10), (2, ["a", "b"], 10), (3, [None], 4), (4, ["b"], None), (4, ["b"], 0), (None, ["b"], 6), (5, [], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, sources array<string>, size bigint, taken string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix_sources(df.where("false")).collect() == []
    # 31.5 words by 3 : 1 : 2; "a" stops at 2, then 29.5 by 1 : 2 of which 19.7 is below 20.
    assert mixing.source_targets({"b": 10, None: 10, "a": 1}, (3, 1, 2), 1.5, 2.0) == {
        "a": 2.0, "b": pytest.approx(29.5 / 3), None: pytest.approx(59 / 3)}
    docs = spark.createDataFrame([(i, "w " * 5, "s0") for i in range(30)] + [(99, None, None), (98, "", "s1")],
                                 "doc_id bigint, text string, source string")
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and 40 <= taken.count() <= 50  # 225 of 150 words, in whole documents


# ------------------------------------------------------------ sanitising

_LITERAL = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _fits(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")),
            "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def _brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(_LITERAL) for m in re.finditer(p, text) if _fits(kind, m[0]))


PII = ["a@b.c", "x..@d-e.f.g", "@", "@@a.b", "1.2.3.4.5.6.7.8", "999.1.1.1", "00255.1.1.1", "4111 1111-1111 1111", "4111111111111111",
       "+49 (30) 123-456", "+1", "é", " ", "\n", "-", ".", "4", "+", "%a@b", "a@b", "12345678901234567890"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PII), max_size=9).map("".join))
def test_base_spans_are_the_literal_patterns(text):
    assert sanitize.base_spans(text) == _brute_spans(text)


def test_base_spans_in_linear_time():
    for text in ("9" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "+1" + "-" * 60_000):
        sanitize.base_spans(text)


def test_personal_data_of_the_whole_table(spark):
    docs = {d.doc_id: d.text for d in _rows(spark, SF_MORE, "documents")}
    kinds = [k for k, _ in _LITERAL]
    rows = QUERIES["op10_sanitize"](spark, SF_MORE).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = _brute_spans(docs[r.doc_id] or "")
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_terms_that_reveal_an_entity_are_found(spark):
    """A name that stands only by one address, on many different lines, reveals
    it; common words and names by many addresses do not."""
    rows = [(i, f"on day {i} we wrote Zorblatt ann@mail.example about topic{i} again") for i in range(8)]
    rows += [(100 + i, f"note {i} for Smith u{i}@mail.example about topic{i} again") for i in range(8)]
    rows += [(1000 + i, f"we wrote about day and note again number {i} Smith") for i in range(3900)]
    rows += [(5000, "nobody but zorblatt knows"), (5001, None), (None, "Zorblatt"), (5000, "nobody but zorblatt knows")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, spans int")
    got = {}
    for r in sanitize.find_personal_data(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    text = dict(rows)
    terms = {d: [text[d][s.start:s.end] for s in r[0].spans if s.kind == 4] for d, r in got.items()}
    assert terms[3] == ["Zorblatt"] and terms[5000] == ["zorblatt"] and terms[None] == ["Zorblatt"] and len(got[5000]) == 2
    assert all(not t for d, t in terms.items() if d is not None and 100 <= d < 6000 and d != 5000)
    assert got[3][0].base[0].kind == 0
    clean = {r.doc_id: r.text for r in sanitize.sanitise_documents(df.where("doc_id < 1000")).collect()}
    assert clean[102] == "note 2 for Smith [EMAIL] about topic2 again"
    assert sanitize.find_personal_data(df.where("false")).collect() == []
