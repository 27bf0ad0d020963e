"""Every core query against its SQL counterpart, and the others for rows."""

import pytest

from lexmill.plans import catalog
from tests.compare import DATA, duck_rows, spark_rows

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert catalog.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == duck_rows(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry_point_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
