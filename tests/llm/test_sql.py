"""The training-data queries that have SQL, against DuckDB."""

from __future__ import annotations

import pytest

from shiplens.llm.queries import QUERIES
from shiplens.llm.sql import ORACLE_SQL
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_sql_is_for_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    ok, info = compare(spark, con, name, SF_SMALL, QUERIES[name], ORACLE_SQL[name])
    assert ok, info
