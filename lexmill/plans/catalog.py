"""Every core query by name, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import contracts, files, harvest, hierarchies, lines, mining, more, rest, scanner, special, tables, texts, wider

FLAGSHIP = "p6_found"
_PARTS = (hierarchies, texts, tables, mining, files, special, more, scanner, harvest, lines, rest, wider, contracts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
