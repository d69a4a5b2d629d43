"""Every registered query of the library against its DuckDB SQL (the driver's gate, at
sf0.001). The training-data queries are compared in tests/llm."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from shiplens.plans import oracle, registry
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

QUERIES = registry.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_entry_registers_them_all():
    assert QUERIES.keys() <= entry.queries().keys() and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, info = compare(spark, con, name, SF_SMALL, QUERIES[name], SQL[name])
    assert ok, info


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and df.columns[0] == "shipping_mode"
