"""Every query of the subpackage over empty tables and rows of nulls."""

import pytest

from lexmill.llm import queries
from tests.compare import DATA, spark_rows
from tests.degenerate import degenerate

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {kind: degenerate(spark, tmp_path_factory.mktemp(kind) / "t", kind) for kind in ("empty", "nulls")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.endswith("_found")))
def test_rows_of_nulls_change_nothing(spark, folders, name):
    assert spark_rows(QUERIES[name](spark, folders["nulls"])) == spark_rows(QUERIES[name](spark, DATA))
