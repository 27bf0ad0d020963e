"""Filters, header mapping and lookups over records of named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def contains_all(wanted: dict[str, str]) -> Column:
    """Every named column contains its text, whatever the case."""
    return reduce(lambda a, b: a & b, [F.lower(c).contains(v.lower()) for c, v in wanted.items()], F.lit(True))


def any_contains(columns: list[str], text: str) -> Column:
    return F.exists(F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]), lambda x: x.contains(text.lower()))


def in_years(year: Column, spec: str) -> Column:
    """A year ``2010`` or an inclusive range ``2001-2010``; what is no number is out."""
    low, _, high = spec.partition("-")
    return F.coalesce(year.try_cast("double").cast("int").between(int(low), int(high or low)), F.lit(False))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns; unknown names are an error that lists them."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*columns)


def header_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), " +", " "))


def canonical_rows(cells: DataFrame, aliases: dict[str, str], fields: list[str], rest: str = "narrative") -> DataFrame:
    """Cells ``pos, id, header, value`` as one row per id; the last of several headers of a field wins.

    Cells under unknown headers are added to ``rest`` as ``header=value``.
    """
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    known = cells.withColumn("field", F.try_element_at(names, header_key(F.col("header"))))
    last = [F.max_by("value", F.when(F.col("field") == f, F.col("pos"))).alias(f) for f in fields]
    other = F.array_sort(F.collect_list(F.when(F.col("field").isNull() & (F.col("value") != ""), F.struct("pos", F.concat_ws("=", "header", "value").alias("t")))))
    out = known.groupBy("id").agg(*last, other.alias("__o"))
    tail = F.nullif(F.array_join(F.transform("__o", lambda x: x["t"]), " | "), F.lit(""))
    return out.withColumn(rest, F.concat_ws(" | ", rest, tail)).drop("__o")


def heading_rows(rows: DataFrame, prefix: str, order: str = "idx", code: str = "code") -> DataFrame:
    """Rows from the first code with the prefix to the next other code; blank codes belong to the code above."""
    start = rows.where(F.col(code).startswith(prefix)).agg(F.min(order).alias("__start"))
    stop = rows.join(F.broadcast(start), F.col(order) > F.col("__start")).where((F.col(code) != "") & ~F.col(code).startswith(prefix)).agg(F.min(order).alias("__stop"))
    bounds = start.join(stop)
    return rows.join(F.broadcast(bounds), (F.col(order) >= F.col("__start")) & (F.col("__stop").isNull() | (F.col(order) < F.col("__stop")))).drop("__start", "__stop")


def file_kind(path: Column) -> Column:
    """Kind of a file by its name; the first that fits counts."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"[.](png|jpg|so|exe|dll|zip)$"), "binary").when(low.rlike(r"(^|/)(requirements[.]txt|package[.]json|pyproject[.]toml|go[.]mod)$"), "dependency")
        .when(path.contains(".github/workflows/"), "workflow").when(low.rlike(r"[.](py|js|ts|sh|rb|go)$"), "code").when(low.rlike(r"[.]md$"), "markdown").otherwise("other")
    )


def missing(columns: list[str]) -> Column:
    """Names of the columns that are null or empty."""
    return F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in columns]), lambda x: x.isNotNull())


def value_counts(df: DataFrame, column: str, separator: str, name: str = "value") -> DataFrame:
    """Counts of the values of a column that may hold several."""
    return df.select(F.explode(F.split(column, separator)).alias(name)).where(F.col(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def suffix_pairs(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Pairs of names that are equal or of which one ends with a space and the other."""
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split(name, " "))), lambda k: F.array_join(F.slice(F.split(name, " "), k, 1 << 20), " "))
    long = names.select(F.col(key).alias("a"), F.explode(ends).alias("end"))
    hit = long.join(names.select(F.col(key).alias("b"), F.col(name).alias("end")), "end").where("a <> b").select("a", "b").distinct()
    return hit.select(F.col("a").alias("id"), F.col("b").alias("other")).union(hit.select("b", "a")).distinct()


def longest_prefix(rows: DataFrame, path: str, routes: DataFrame, prefix: str) -> DataFrame:
    """Each row with the route of the longest prefix of its path, at whole steps of the path."""
    steps = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    kept = rows.withColumn("__row", F.monotonically_increasing_id())
    hit = kept.select("__row", F.explode(every).alias(prefix)).join(routes, prefix)
    extra = [c for c in routes.columns if c != prefix]
    best = hit.groupBy("__row").agg(F.max_by(F.struct(*extra), F.length(prefix)).alias("__r"))
    return kept.join(best, "__row", "left").select(*rows.columns, *[F.col("__r")[c].alias(c) for c in extra])
