"""Dates, deadlines and stable identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names as they stand in Polish, English and French dates.
PL_MONTHS = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()
EN_MONTHS = "january february march april may june july august september october november december".split()
FR_MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
MONTHS = {m: k for names in (PL_MONTHS, EN_MONTHS, FR_MONTHS) for k, m in enumerate(names, 1)}
# French months as abbreviated in citations.
FR_SHORT = "janv. févr. mars avr. mai juin juill. août sept. oct. nov. déc.".split()


def month_number(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(names, F.lower(c))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def normalise_date(c: Column) -> Column:
    """ISO, ``d.m.Y``, ``d/m/Y`` and written-out dates of three languages; null if there is no such day."""
    t = F.trim(c)
    iso, dotted, slashed = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    day_first = r"^([0-9]{1,2})(?:er)? (\p{L}+) ([0-9]{4})(?: r\.)?$"
    month_first = r"^(\p{L}+) ([0-9]{1,2}), ([0-9]{4})$"
    x = lambda p, k: F.regexp_extract(t, p, k)
    return (
        F.when(t.rlike(iso), _ymd(x(iso, 1), x(iso, 2), x(iso, 3)))
        .when(t.rlike(dotted), _ymd(x(dotted, 3), x(dotted, 2), x(dotted, 1)))
        .when(t.rlike(slashed), _ymd(x(slashed, 3), x(slashed, 2), x(slashed, 1)))
        .when(t.rlike(day_first), _ymd(x(day_first, 3), month_number(x(day_first, 2)), x(day_first, 1)))
        .when(t.rlike(month_first), _ymd(x(month_first, 3), month_number(x(month_first, 1)), x(month_first, 2)))
    )


def french_date(d: Column, short: bool = False) -> Column:
    """``1er janvier 2020``; months abbreviated for citations if ``short``."""
    names = F.array(*[F.lit(m) for m in (FR_SHORT if short else FR_MONTHS)])
    day = F.when(F.dayofmonth(d) == 1, "1er").otherwise(F.dayofmonth(d).cast("string"))
    return F.concat_ws(" ", day, F.element_at(names, F.month(d)), F.year(d).cast("string"))


def add_business_days(d: Column, n: int) -> Column:
    """The n-th weekday after ``d``; the day itself does not count."""
    # Move a weekend start back to Friday, then cross two days for each five weekdays.
    dow = F.weekday(d)  # 0 Monday
    start = F.date_sub(d, F.when(dow >= 5, dow - 4).otherwise(0))
    w = F.weekday(start)
    return F.date_add(start, (F.lit(n) + 2 * F.floor((w + n) / 5)).cast("int"))


def roll_forward(d: Column) -> Column:
    """The day itself, or the Monday after a weekend."""
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def stale(at: Column, today: Column, days: int = 90) -> Column:
    return F.datediff(today, at) > days


def uid(*parts: Column) -> Column:
    """First 24 hex digits of the hash of the parts joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the hash of the parts joined by a zero character."""
    zero = F.lit("\x00")
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, zero, p)
    return F.substring(F.sha2(joined, 256), 1, 16)


def event_end(day: Column, days: Column, timed: Column) -> Column:
    """End of an event: 17:00 of the day for timed ones, else midnight after the last day."""
    return F.when(timed, F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit("17:00:00")))).otherwise(F.date_add(day, F.greatest(days, F.lit(1)).cast("int")).cast("timestamp"))


def clamp_score(x: Column) -> Column:
    """A score held to [0, 1] with two decimals, halves to even."""
    return F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 2)
