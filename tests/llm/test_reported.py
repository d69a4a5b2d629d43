"""Faults once reported: repeated ids, copies of one vector, tiny components, long lines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiplens.llm import exact_topk, permutation_index, sanitize, setsketch, vectors

TEXT = " ".join(f"word{i}" for i in range(60))


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_copies_of_a_repeated_ids_second_text(spark):
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, TEXT), (1, other), (3, other + " more"), (4, TEXT + " again"), (5, "alone here"), (None, TEXT)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in setsketch.near_duplicates(_docs(spark, rows)).collect()), key=repr)
    assert [(d, c) for d, _, c in got] == [(1, 1), (1, 1), (3, 1), (4, 1), (5, 5), (None, None)]


def test_one_stray_in_a_large_bucket_is_dealt_linearly(spark):
    members = 4000
    rows = spark.range(members).select(F.lit(7).cast("bigint").alias("key"), F.lit(0).alias("band"), F.col("id").alias("rep"),
                                       F.when(F.col("id") == 9, F.lit(9)).otherwise(F.lit(0)).cast("bigint").alias("comp"))
    dealt = setsketch._blocked(rows)
    assert dealt.count() <= 2 * members
    meet = dealt.where("comp = 9").select("key", "i", "j").join(dealt.where("comp = 0"), ["key", "i", "j"])
    assert meet.select("rep").distinct().count() == members - 1


def test_sanitised_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "x a@b.cd"), (5, "y a@b.cd"), (5, "z"), (5, "z"), (2**60 + 1, None)]
    got = sorted(((r.doc_id, r.text) for r in sanitize.sanitise_documents(_docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, "x [EMAIL]"), (5, "y [EMAIL]"), (5, "z"), (5, "z"), (2**60 + 1, "")], key=repr)


def test_characters_whose_lower_case_is_longer_do_not_stop_folding():
    assert sanitize._folded("Zorblatt in İstanbul") == "zorblatt in İstanbul"
    assert len(sanitize._folded("İİ ẞ ΑΣ")) == len("İİ ẞ ΑΣ")


def test_words_near_an_identifier_at_any_distance_in_characters():
    far = "x" * 3000
    text = f"{far} Zorblatt {far} a@b.cd {far} quux"
    start = text.index("a@b.cd")
    terms = {t for _, _, t in sanitize._contexts(text, [(start, 0, start + 6)], 8)}
    short = text.replace(far, "x" * 30)
    start = short.index("a@b.cd")
    near = {t for _, _, t in sanitize._contexts(short, [(start, 0, start + 6)], 8)}
    assert len(terms) == len(near) == 3 and len(terms & near) == 2  # all but the filler


@pytest.mark.parametrize("x", [-1e-20, -2e-19, -1.0, 0.0, 1e-20, 0.5, -0.001, 1e300, -1e300])
def test_floor_of_any_component(spark, x):
    table = spark.createDataFrame([(1, [x])], "vec_id bigint, embedding array<double>")
    got = exact_topk.whole_numbers(table).first().v[0]
    assert got == (float(np.floor(256 * x)) if abs(x) < 1e290 else 256 * x)


def test_copies_of_one_vector_do_not_crowd_out_the_pivots(spark):
    r = np.random.default_rng(4)
    own = r.normal(size=(3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id bigint, embedding array<double>")
    least = table.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").first().embedding
    copies = spark.range(3000, 4000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(x) for x in least]).alias("embedding"))
    rows = vectors.valid_vectors(table.unionByName(copies), zeros=False)
    assert len(vectors.sample_pivots(rows, 256, 24)) == 256
    got = permutation_index.nearest(table.unionByName(copies), F.col("vec_id") % 20 == 0).collect()
    every = np.vstack([own, np.repeat([least], 1000, axis=0)])
    found: dict = {}
    for g in got:
        found.setdefault(g.query_id, {})[g.vec_id] = g.score
    hits = total = 0
    for q in range(0, 4000, 20):
        s = every @ every[q]
        s[q] = -np.inf
        limit = np.sort(s)[-20]
        hits += sum(v >= limit - 1e-9 for v in found[q].values())
        total += 20
    assert hits / total >= 0.9
