"""The cube grain gives the same results as the line grain for every
aggregate query (measures are additive; rounding hides sum order)."""

from __future__ import annotations

import pytest

from shiplens.operators.measures import CUBE, LINES, build_cube
from shiplens.plans import registry


@pytest.fixture(scope="module")
def cube(small_enriched):
    return build_cube(small_enriched).cache()


@pytest.mark.parametrize("name", registry.aggregate_queries())
def test_cube_equals_lines(small_enriched, cube, name):
    q = registry.QUERIES[name]
    a = sorted(tuple(r) for r in registry.present(q.fn(small_enriched, LINES), q).collect())
    b = sorted(tuple(r) for r in registry.present(q.fn(cube, CUBE), q).collect())
    assert a == b


def test_cube_is_much_smaller_than_lines(small_enriched, cube):
    assert cube.count() < small_enriched.count()
