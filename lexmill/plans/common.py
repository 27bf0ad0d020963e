"""Small helpers shared by the named queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.functions.text import MARKED, PLAIN


def fixture(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    text = str(v)
    if any(ord(c) < 32 for c in text):
        parts, run = [], ""
        for c in text:
            if ord(c) < 32:
                if run:
                    parts.append(_literal(run))
                parts.append(f"chr({ord(c)})")
                run = ""
            else:
                run += c
        return " || ".join([*parts, *([_literal(run)] if run else [])])
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], cols: str) -> str:
    """The rows as a SQL table expression."""
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({cols}))"


def sql_fold(x: str) -> str:
    return f"translate(replace(replace(replace({x}, 'Œ', 'OE'), 'œ', 'oe'), 'ß', 'ss'), '{MARKED}', '{PLAIN}')"


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g'))"
