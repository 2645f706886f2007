"""Queries with SQL against DuckDB on the smallest given tables."""

from __future__ import annotations

import os

import pytest

from logweir.llm import catalog
from tests.check_oracle import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not found")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, connect(DATA), name, catalog.QUERIES[name], catalog.SQL[name], DATA) is None


def test_all_are_registered():
    from __spark_entry__ import queries

    names = set(queries())
    assert "pipeline" in names
    assert all(any(name.startswith(f"op{number}_") for name in names) for number in range(1, 14))
