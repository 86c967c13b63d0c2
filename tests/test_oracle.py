"""Every query with SQL equals DuckDB over the same tables."""

import pytest
from compare import connect, differences

from weftline.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf_dir, con, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), con, registry.SQL[name]) == ""


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
