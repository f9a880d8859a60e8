from __future__ import annotations

import pytest

from corvella.plans import platform_queries, registry, text_queries, vector_queries  # noqa: F401
from tests.compare import same
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, oracle, name):
    same(registry.QUERIES[name](spark, str(DATA)), oracle, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows_without_sql(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
