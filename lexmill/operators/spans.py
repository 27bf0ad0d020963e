"""Edits of text as spans with a ledger, and matches with their surroundings."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class EditRule(NamedTuple):
    key: str
    pattern: str
    replace: str
    #: Words of which one must stand in the ``reach`` characters before the match; empty: always.
    after: tuple[str, ...] = ()
    reach: int = 60


def paired_quotes(text: str) -> list[tuple[int, int, str]]:
    """Straight double quotes made opening and closing angle quotes, only if their number is even."""
    at = [m.start() for m in re.finditer('"', text)]
    return [] if len(at) % 2 else [(p, p + 1, "« " if k % 2 == 0 else " »") for k, p in enumerate(at)]


def edits(text: str, rules: list[EditRule], off: frozenset[str] = frozenset()) -> tuple[str, list[dict]]:
    """The edited text and the ledger: rule, number, place in the text before the rule, old and new.

    Rules run in sequence; ``off`` names rules (``key``) and single occurrences (``key#2``) to leave out.
    """
    ledger: list[dict] = []
    for rule in rules:
        if rule.key in off:
            continue
        found = paired_quotes(text) if rule.pattern == "quotes" else [(m.start(), m.end(), m.expand(rule.replace)) for m in re.finditer(rule.pattern, text)]
        out, last, number = [], 0, 0
        for a, b, new in found:
            if a < last or rule.after and not any(w in text[max(0, a - rule.reach) : a] for w in rule.after):
                continue
            number += 1
            if f"{rule.key}#{number}" in off or new == text[a:b]:
                continue
            ledger.append({"rule": rule.key, "number": number, "start": a, "before": text[a:b], "after": new})
            out += [text[last:a], new]
            last = b
        text = "".join([*out, text[last:]])
    return text, ledger


def apply_rules(df: DataFrame, text_col: str, rules: list[EditRule], off: frozenset[str] = frozenset()) -> DataFrame:
    """Adds ``edited`` and ``ledger``; null texts stay null with an empty ledger."""
    kind = "edited string, ledger array<struct<rule string, number int, start int, before string, after string>>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [edits(t, rules, off) if t is not None else (None, []) for t in texts]
        return pd.DataFrame(rows, columns=["edited", "ledger"])

    return df.withColumn("__r", run(text_col)).select("*", "__r.*").drop("__r")


def find_spans(df: DataFrame, text_col: str, patterns: list[tuple[str, str]], context: int = 50) -> DataFrame:
    """One row per match: ``kind, start, end, match, around``, with ``context`` characters on both sides.

    What stands between the matches tells where they are, so all of it is expressions.
    """
    text = F.col(text_col)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.length(x))

    def one(kind: str, pattern: str):
        found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern)
        return F.transform(found, lambda m, k: F.struct(F.lit(kind).alias("kind"), (total(F.slice(between, F.lit(1), k + 1)) + total(F.slice(found, F.lit(1), k))).alias("start"), m.alias("match")))

    rows = df.withColumn("__s", F.explode(F.concat(*[one(*p) for p in patterns]))).select("*", "__s.*").drop("__s")
    rows = rows.withColumn("end", F.col("start") + F.length("match"))
    first = F.greatest(F.col("start") - context, F.lit(0))
    return rows.withColumn("around", F.substring(text, first + 1, F.col("end") + context - first))


def pair_within(left: list[tuple[int, int]], right: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """Greedy pairs of spans: each left one with the first unused right one that begins within ``reach`` after it."""
    used: set[int] = set()
    out = []
    for i, (_, end) in enumerate(left):
        for j, (start, _) in enumerate(right):
            if j not in used and 0 <= start - end <= reach:
                used.add(j)
                out.append((i, j))
                break
    return out


def critical_path(tasks: list[tuple[str, int, list[tuple[str, str, int]]]]) -> dict[str, tuple[int, int, int]]:
    """Earliest start, latest start and float of tasks ``(name, duration, [(before, link, lag)])``; links FS, SS and FF.

    One project's plan is a bounded list; plans are worked side by side by ``applyInPandas``.
    """
    length = {n: d for n, d, _ in tasks}
    links = [(a, n, kind, lag) for n, _, before in tasks for a, kind, lag in before]
    shift = {"FS": lambda a, b: length[a], "SS": lambda a, b: 0, "FF": lambda a, b: length[a] - length[b]}
    early = dict.fromkeys(length, 0)
    for _ in length:
        moved = False
        for a, b, kind, lag in links:
            at = early[a] + shift[kind](a, b) + lag
            if at > early[b]:
                early[b], moved = at, True
        if not moved:
            break
    else:
        if links and any(early[a] + shift[k](a, b) + lag > early[b] for a, b, k, lag in links):
            raise ValueError("the tasks wait for each other")
    end = max((early[n] + length[n] for n in length), default=0)
    late = {n: end - length[n] for n in length}
    for _ in length:
        for a, b, kind, lag in links:
            late[a] = min(late[a], late[b] - shift[kind](a, b) - lag)
    return {n: (early[n], late[n], late[n] - early[n]) for n in length}
