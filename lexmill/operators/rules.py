"""Rule tables run over text: findings, suppression, baselines, verdicts, scored candidates.

A rule table becomes one array expression, so all patterns run in one pass over
each line inside generated code; nothing is joined or shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions.dates import fingerprint


class Rule(NamedTuple):
    name: str
    category: str
    severity: int  # 0 low, 1 medium, 2 high, 3 critical
    pattern: str
    #: Text without which the pattern cannot match; looked for first, as it costs a fraction.
    needs: str = ""


class Frame(NamedTuple):
    name: str
    field: str
    base: int  # hundredths
    pattern: str


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line`` from 1; empty texts have none."""
    return df.where(F.length(text_col) > 0).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def match_rules(df: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per line and rule that matches it, all other columns kept."""
    fits = lambda r: F.col(text_col).contains(r.needs) & F.col(text_col).rlike(r.pattern) if r.needs else F.col(text_col).rlike(r.pattern)
    hits = [F.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"))) for r in rules]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return df.withColumn("__hit", F.explode(found)).select("*", "__hit.*").drop("__hit")


def in_fence(df: DataFrame, id_col: str, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """Marks lines in code fences, fence lines included."""
    fence = F.trim(F.col(line_col)).startswith("```")
    upto = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("fenced", (F.sum(fence.cast("int")).over(upto) % 2 == 1) | fence)


def suppressed(c: Column) -> Column:
    """Lines with an inline marker are left alone."""
    return c.rlike(r"(noqa|nosec|scan:ignore)")


def with_fingerprint(findings: DataFrame, *parts: str) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(*[F.col(p).cast("string") for p in parts]))


def less_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not in the accepted baseline."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def verdict(critical: Column, high: Column, medium: Column, strict: bool = False) -> Column:
    """FAIL on a critical finding, or a high one if strict; WARN on a high or five medium; else PASS."""
    fail = (critical > 0) | (high > 0) if strict else critical > 0
    return F.when(fail, "FAIL").when((high > 0) | (medium >= 5), "WARN").otherwise("PASS")


def severity_counts(findings: DataFrame, key: str) -> DataFrame:
    names = ("low", "medium", "high", "critical")
    return findings.groupBy(key).agg(*[F.count_if(F.col("severity") == k).alias(n) for k, n in enumerate(names)], F.count(F.lit(1)).alias("total"))


def match_frames(sentences: DataFrame, text_col: str, frames: tuple[Frame, ...]) -> DataFrame:
    """One scored candidate per sentence and frame, in the frames' order."""
    hits = [F.when(F.col(text_col).rlike(f.pattern), F.struct(F.lit(k).alias("ordinal"), F.lit(f.name).alias("frame"), F.lit(f.field).alias("field"), F.lit(f.base).alias("base"))) for k, f in enumerate(frames)]
    return sentences.withColumn("__hit", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select("*", "__hit.*").drop("__hit")


def tier(score: Column, corroborated: Column, ner: Column, sparse: Column) -> Column:
    """Decision on a score in hundredths; mentions found by capital letters alone never promote."""
    return (
        F.when(~ner & (score >= 85), "promote").when(~ner & (score >= 65) & corroborated, "promote")
        .when(score >= 45, "hint").when(sparse & (score >= 35), "hint").otherwise("suppress")
    )


def best_candidates(candidates: DataFrame, key: list[str], score: str, ordinal: str, signals: str) -> DataFrame:
    """Per key the highest score, the first on ties, with all signals in order of appearance."""
    best = F.max_by(F.struct("*"), F.struct(F.col(score), -F.col(ordinal)))
    rows = candidates.groupBy(*key).agg(best.alias("b"), F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(signals).alias("s")))).alias("all"), F.min(ordinal).alias("slot"))
    return rows.select("b.*", F.array_distinct(F.flatten(F.transform("all", lambda x: x["s"]))).alias("merged"), "slot")
