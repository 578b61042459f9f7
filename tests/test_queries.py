"""Every core query with SQL gives what the SQL gives; every other one runs."""

import pytest

from sheafline.plans import more as registry
from tests.oracle_check import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in SQL:
        assert compare(spark, con, sf, name, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, sf).count() >= 0


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
