"""Hierarchies over empty tables and rows of nulls."""

import pytest

from lexmill.plans import hierarchies
from tests.compare import DATA, spark_rows
from tests.degenerate import degenerate


@pytest.mark.parametrize("name", ["p6_found", "p6_intervals", "p6_below"])
def test_no_rows(spark, tmp_path, name):
    assert hierarchies.QUERIES[name](spark, degenerate(spark, tmp_path / "t", "empty")).count() == 0


def test_rows_of_nulls_change_nothing(spark, tmp_path):
    folder = degenerate(spark, tmp_path / "t", "nulls")
    assert spark_rows(hierarchies.p6_found(spark, folder)) == spark_rows(hierarchies.p6_found(spark, DATA))
