"""Operators on rows in order: running sums, carried values, islands, sessions, nearest smaller values.

A group may hold a third of all rows, so the operators that can work in two
steps do: rows are ordered within a portion of their group (a day, a run of
places, a range of hashes), and what a portion hands on to the next is worked
out from one row per portion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Places of a group that are ordered together.
RUN_LENGTH = 1024


def running_sum(df: DataFrame, group: str, order: list, portion: Column, value: Column, name: str, own: bool = True) -> DataFrame:
    """Sum of ``value`` over the group's rows up to each one, with it if ``own``.

    ``portion`` must rise with the order: no row of a later portion comes before one of an earlier.
    """
    rows = df.withColumn("__portion", portion).withColumn("__value", value)
    sums = rows.groupBy(group, "__portion").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(group).orderBy("__portion").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("__g"), F.col("__portion").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(group, "__portion").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    local = rows.withColumn("__local", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    joined = local.join(sums, local[group].eqNullSafe(sums["__g"]) & local["__portion"].eqNullSafe(sums["__p"]))
    return joined.withColumn(name, F.col("__base") + F.col("__local")).drop("__portion", "__value", "__local", "__base", "__g", "__p")


def by_day(ts: str) -> Column:
    """Portions by day; rows without a time come first, as nulls do in ascending order."""
    return F.coalesce(F.date_trunc("day", ts), F.lit("0001-01-01").cast("timestamp"))


def running_number(df: DataFrame, group: str, order: list, portion: Column, name: str) -> DataFrame:
    """Numbers the rows of each group from 1 in order."""
    return running_sum(df, group, order, portion, F.lit(1).cast("long"), name)


def carry_down(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and with each row; ``order`` is a whole number."""
    rows = df.withColumn("__value", value).withColumn("__run", F.floor(F.col(order) / RUN_LENGTH))
    upto = Window.partitionBy(group, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(upto))
    ends = rows.groupBy(group, "__run").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__end"))
    before = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(group, "__run", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    return local.join(ends, [group, "__run"]).withColumn(name, F.coalesce("__local", "__carried")).drop("__value", "__run", "__local", "__carried")


def islands(df: DataFrame, group: str, order: str, breaks: Column, name: str) -> DataFrame:
    """Numbers the runs of rows between breaks; a group is one paragraph's pieces."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(breaks.cast("int")).over(upto))


def nearest_smaller(df: DataFrame, group: str, order: str, value: str, name: str, levels: int = 64) -> DataFrame:
    """The nearest earlier row with a smaller value; values are small whole numbers such as indents."""
    found = sorted(r[0] for r in df.select(value).distinct().limit(levels + 1).collect() if r[0] is not None)
    if len(found) > levels:
        raise ValueError(f"more than {levels} levels")
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(value) > v, F.max(F.when(F.col(value) == v, F.col(order))).over(before)) for v in found]
    return df.withColumn(name, F.greatest(*last, F.lit(None).cast(df.schema[order].dataType), F.lit(None).cast(df.schema[order].dataType)))


def _sessions(rows: DataFrame, keys: list[str], order: list[str], began: str, ended: str, minutes: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    pause = F.col(began) - F.lag(ended).over(w)
    marked = rows.withColumn("__brk", F.when(pause.isNull() | (pause > F.make_dt_interval(mins=F.lit(minutes))), 1).otherwise(0))
    return marked.withColumn("session", F.sum("__brk").over(w))


def idle_sessions(events: DataFrame, user: str, ts: str, tie: str, minutes: int) -> DataFrame:
    """Sessions of a user's events; a pause of more than ``minutes`` begins a new one.

    Sessions are found within each day first and joined across midnight after.
    """
    daily = _sessions(events.withColumn("__day", by_day(ts)), [user, "__day"], [ts, tie], ts, ts, minutes)
    parts = daily.groupBy(user, "__day", "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events")).drop("session")
    rows = _sessions(parts, [user], ["began"], "began", "ended", minutes)
    return rows.groupBy(user, "session").agg(F.min("began").alias("began"), F.max("ended").alias("ended"), F.sum("events").alias("events"))


def next_time(events: DataFrame, user: str, ts: str, tie: str, name: str) -> DataFrame:
    """Each event with the time of the user's next one."""
    rows = events.withColumn("__day", by_day(ts))
    within = Window.partitionBy(user, "__day").orderBy(ts, tie)
    first = rows.groupBy(user, "__day").agg(F.min(ts).alias("__first"))
    first = first.select(user, "__day", F.lead("__first").over(Window.partitionBy(user).orderBy("__day")).alias("__after"))
    return rows.withColumn(name, F.lead(ts).over(within)).join(first, [user, "__day"]).withColumn(name, F.coalesce(name, "__after")).drop("__day", "__after")
