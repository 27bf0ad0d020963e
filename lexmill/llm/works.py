"""Bibliographic records of one work, and the best record of each work field by field.

Records are grouped by usable DOI and by cleaned title and year. Within a work
the titles' tokens are aligned progressively, each column is voted with
weights, and the existing title closest to the consensus supplies the field;
authors and DOI are chosen by completeness. Ties go to the most trusted
source, then the latest record.

Distinct token sequences with their weights are what an alignment sees, so a
work with many copies costs no more than its spellings. A work with more
spellings than one portion is voted portion by portion, and the portions'
consensus sequences, with the weight of all their votes, are voted again until
one is left. Records are compared by aggregation alone.

Defined results: repeated rows count once; a null or blank title, and one cut
short without a match, joins no work by title; a work whose titles are all null
has no title row; no row for authors or DOI if no record has any.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from lexmill.llm import codepoints as cp
from lexmill.llm.persons import parse_person

#: Letters by which titles cut short are blocked; shorter ones are blocked by their first letter.
PREFIX = 12
#: Letters in which the beginnings of titles under one DOI may differ; those of other works share next to none.
START_ERRORS = 4
#: Spellings of a title that one task aligns at a time.
VOTE_PORTION = 256
#: Weight of a damaged title's vote against an undamaged one's.
DAMAGED_WEIGHT = 0.25
#: A group's labels are spread until nothing changes.
DOI = r"10\.\d{4,9}/[^\s\"<>]*[a-z0-9)]"


def repair(title: str) -> tuple[str, bool]:
    """The title without markup, entities and broken encoding, and whether it had any."""
    out = html.unescape(html.unescape(title))
    out = re.sub(r"</?[a-zA-Z][^>]*>", " ", out)
    damaged = re.sub(r"\s+", " ", out).strip() != re.sub(r"\s+", " ", title).strip()
    for code in ("latin-1", "cp1252"):
        try:
            better = out.encode(code).decode("utf-8")
        except UnicodeError:
            continue
        if better != out:
            return better, True
        break
    broken = "�" in out or re.search(r"\w\?\w", out) is not None
    return out, damaged or broken


def title_tokens(text: str) -> list[str]:
    fold = cp.fold_table()
    low = "".join(chr(fold[min(ord(c), cp.LIMIT)]) if c.isalnum() else " " for c in unicodedata.normalize("NFC", text))
    return low.split()


def _title(title: str | None) -> tuple[str | None, str | None, bool, bool]:
    """Key of tokens, those before the subtitle, cut short, damaged."""
    if title is None or not title.strip():
        return None, None, False, True
    text, damaged = repair(title)
    cut = bool(re.search(r"(…|\.\.\.)\s*$", text.strip()))
    letters = [c for c in text if c.isalpha() and c.lower() != c.upper()]
    flat = bool(letters) and (all(c.isupper() for c in letters) or all(c.islower() for c in letters))
    tokens = title_tokens(text)
    if cut and tokens and not re.search(r"[\s:,;–-](…|\.\.\.)\s*$", text.strip()):
        tokens[-1:] = [tokens[-1] + "~"]
    main = title_tokens(re.split(r":|[.;]\s|\s[–—-]\s", text, maxsplit=1)[0])
    return " ".join(tokens) or None, (" ".join(main) or None) if main != tokens else None, cut, damaged or cut or flat or "�" in text


def records(refs: DataFrame) -> DataFrame:
    """One row per ref_id with its title key, flags, DOI, author figures and surnames."""
    names = ["key", "main", "cut", "damaged", "named", "written", "surnames"]

    @F.pandas_udf("key string, main string, cut boolean, damaged boolean, named int, written int, surnames array<string>")
    def look(title: pd.Series, authors: pd.Series) -> pd.DataFrame:
        rows = []
        for t, people in zip(title, authors):
            parsed = [p for p in (parse_person(a) for a in (people if people is not None else []) if a) if p]
            rows.append((*_title(t), len(parsed), sum(p.written for p in parsed), sorted({p.surname for p in parsed})))
        return pd.DataFrame(rows, columns=names)

    one = refs.dropDuplicates(["ref_id"]).where("ref_id IS NOT NULL")
    doi = F.regexp_extract(F.lower(F.col("doi")), DOI, 0)
    return one.select("ref_id", "year", "sources", "retrieved_at", F.when(doi != "", doi).alias("doi"), look("title", "authors").alias("x")).select("ref_id", "year", "sources", "retrieved_at", "doi", "x.*")


def work_groups(recs: DataFrame, cut) -> DataFrame:
    """``ref_id, work``: the smallest ref_id of the records of the same work."""
    # A title that is another's part before the subtitle does not name a work.
    mains = recs.where("main IS NOT NULL AND NOT cut").select(F.col("main").alias("key"), F.lit(True).alias("part")).distinct()
    recs = cut(recs.join(mains, "key", "left").withColumn("part", F.coalesce("part", F.lit(False))))
    whole = recs.where("key IS NOT NULL AND NOT cut AND NOT part")
    # A record without a year belongs to the title's only year.
    years = whole.where("year IS NOT NULL").groupBy("key").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    dated = whole.join(years, "key", "left").withColumn("y", F.coalesce("year", F.when(F.col("y0") == F.col("y1"), F.col("y0"))))
    by_title = dated.select("ref_id", F.when(F.col("y").isNull() & F.col("y0").isNull(), F.concat(F.lit("t:"), "key")).when(F.col("y").isNotNull(), F.concat(F.lit("t:"), "key", F.lit("|"), F.col("y").cast("string"))).alias("k")).where("k IS NOT NULL")
    # One DOI under titles that differ from the start is a mistake in the data.
    by_doi = recs.where("doi IS NOT NULL").withColumn("start", F.substring("key", 1, PREFIX))
    common = by_doi.where("start IS NOT NULL").groupBy("doi", "start").count().groupBy("doi").agg(F.max_by("start", F.struct("count", "start")).alias("usual"))
    by_doi = by_doi.join(common, "doi", "left").select("ref_id", F.concat(F.lit("d:"), "doi", F.when(F.levenshtein("start", "usual") > START_ERRORS, F.concat(F.lit("|"), "start")).otherwise("")).alias("k"))
    # A title cut short joins the one whole title it begins, by an author and year in common.
    short = recs.where("key IS NOT NULL").withColumn("begin", F.regexp_replace("key", "~$", "")).where("begin <> ''")
    short = short.select("ref_id", "begin", "year", F.explode("surnames").alias("s"), F.when(F.length("begin") >= PREFIX, F.substring("begin", 1, PREFIX)).otherwise(F.substring("begin", 1, 1)).alias("p"))
    # Beginnings under PREFIX letters are cut titles alone: a whole title that short is no part of another's.
    short = short.join(recs.where("cut").select("ref_id").distinct().withColumn("is_cut", F.lit(True)), "ref_id", "left").where((F.length("begin") >= PREFIX) | F.col("is_cut")).drop("is_cut")
    starts = F.explode(F.array(F.substring("key", 1, PREFIX), F.substring("key", 1, 1))).alias("p")
    full = dated.select("key", F.col("y").alias("year"), F.explode("surnames").alias("s")).distinct().select("key", "year", "s", starts)
    near = short.join(full, ["year", "s", "p"]).where(F.expr("startswith(key, begin) AND key <> begin")).groupBy("ref_id").agg(F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("year").alias("year"))
    by_start = near.where("k0 = k1").select("ref_id", F.concat(F.lit("t:"), "k0", F.lit("|"), F.col("year").cast("string")).alias("k"))
    keys = cut(by_title.unionByName(by_doi).unionByName(by_start).distinct())
    label = cut(recs.select("ref_id", F.col("ref_id").alias("work")))
    while True:
        low = keys.join(label, "ref_id").groupBy("k").agg(F.min("work").alias("low"))
        best = keys.join(low, "k").groupBy("ref_id").agg(F.min("low").alias("low"))
        step = label.join(best, "ref_id", "left").select("ref_id", F.col("work").alias("old"), F.least("work", F.coalesce("low", "work")).alias("work"))
        # A record follows the record it points at.
        jump = label.select(F.col("ref_id").alias("work"), F.col("work").alias("next"))
        seen = Observation()
        step = step.join(jump, "work", "left").select("ref_id", "old", F.coalesce("next", "work").alias("work"))
        label = cut(step.observe(seen, F.count_if(F.col("work") != F.col("old")).alias("n")).drop("old"))
        if not seen.get["n"]:
            return label


def align(columns: list[dict[str, float]], total: float, tokens: list[str], weight: float) -> list[dict[str, float]]:
    """Add one token sequence to a progressive alignment: each column holds the weight of its tokens, '' the gaps."""
    n, m = len(columns), len(tokens)
    score = np.zeros((n + 1, m + 1))
    score[1:, 0] = -0.5 * np.arange(1, n + 1)
    score[0, 1:] = -0.5 * np.arange(1, m + 1)
    match = [[(c.get(t, 0.0) / max(total, 1e-9)) * 2 - 1 for t in tokens] for c in columns]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i, j] = max(score[i - 1, j - 1] + match[i - 1][j - 1], score[i - 1, j] - 0.5, score[i, j - 1] - 0.5)
    out, i, j = [], n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + match[i - 1][j - 1]:
            c = dict(columns[i - 1])
            c[tokens[j - 1]] = c.get(tokens[j - 1], 0) + weight
            i, j = i - 1, j - 1
        elif i and score[i, j] == score[i - 1, j] - 0.5:
            c = dict(columns[i - 1])
            c[""] = c.get("", 0) + weight
            i -= 1
        else:
            c = {tokens[j - 1]: weight, "": total}
            j -= 1
        out.append(c)
    return out[::-1]


def consensus(values: list[tuple[list[str], float]]) -> list[str]:
    """Voted tokens of weighted sequences, the heaviest and longest aligned first; a tie keeps the token."""
    columns: list[dict[str, float]] = []
    total = 0.0
    for tokens, weight in sorted(values, key=lambda v: (-v[1], -len(v[0]), v[0])):
        columns = align(columns, total, tokens, weight)
        total += weight
    voted = [max(c.items(), key=lambda x: (x[1], x[0] != "", x[0]))[0] for c in columns]
    return [t for t in voted if t]


def distance(a: list[str], b: list[str]) -> int:
    """Token edits between two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _sequences(keys, weights) -> list[tuple[list[str], float]]:
    return [(k.rstrip("~").split(), w) for k, w in zip(keys, weights)]


def _voted(seqs: list[tuple[list[str], float]]) -> list[str]:
    """Consensus of the sequences; one that is the beginning of another has lost its end and no vote on it."""
    order = sorted({tuple(s) for s, _ in seqs})
    begun = set()
    for a, b in zip(order, order[1:]):
        if len(b) > len(a) and b[: len(a)] == a or len(b) >= len(a) and a and b != a and b[: len(a) - 1] == a[:-1] and b[len(a) - 1].startswith(a[-1]):
            begun.add(a)
    return consensus([(s, w) for s, w in seqs if tuple(s) not in begun] or seqs)


def title_votes(values: DataFrame, cut) -> DataFrame:
    """``work, voted``: the consensus of each work's title keys (``work, key, weight``)."""

    @F.pandas_udf("string")
    def vote(groups: pd.Series) -> pd.Series:
        return pd.Series([" ".join(_voted(_sequences([g["key"] for g in group], [g["weight"] for g in group]))) for group in groups])

    now = values
    while True:
        portions = F.ceil(F.col("n") / VOTE_PORTION).cast("int")
        sizes = now.groupBy("work").agg(F.count(F.lit(1)).alias("n")).select("work", portions.alias("portions"))
        dealt = now.join(sizes, "work").withColumn("portion", F.pmod(F.xxhash64("key"), F.col("portions")))
        voted = dealt.groupBy("work", "portion").agg(F.collect_list(F.struct("key", "weight")).alias("v"), F.sum("weight").alias("weight"), F.max("portions").alias("portions"))
        voted = cut(voted.select("work", vote("v").alias("key"), "weight", "portions"))
        if not voted.where("portions > 1").limit(1).count():
            return voted.select("work", F.col("key").alias("voted"))
        # Portions that agree are one sequence with the weight of both.
        now = voted.groupBy("work", "key").agg(F.sum("weight").alias("weight"))


def best_records(refs: DataFrame, trust: DataFrame, cut, recs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``group_ref_id, field, best_ref_id`` of every work with two or more ref_ids; ``recs`` and ``labels`` if at hand."""
    recs = cut(records(refs)) if recs is None else recs
    labels = work_groups(recs, cut) if labels is None else labels
    many = labels.groupBy("work").count().where("count > 1").select("work")
    ranks = trust.groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    rank = recs.select("ref_id", F.explode("sources").alias("source")).join(ranks, "source").groupBy("ref_id").agg(F.min("trust_rank").alias("rank"))
    rows = recs.join(labels, "ref_id").join(many, "work").join(rank, "ref_id", "left").withColumn("rank", F.coalesce("rank", F.lit(1 << 30)))
    rows = cut(rows)
    values = rows.where("key IS NOT NULL").groupBy("work", "key").agg(F.sum(F.when(F.col("damaged"), DAMAGED_WEIGHT).otherwise(1.0)).alias("weight"))

    @F.pandas_udf("int")
    def far_from(keys: pd.Series, voted: pd.Series) -> pd.Series:
        return pd.Series([distance(s, v.split()) for (s, _), v in zip(_sequences(keys, keys), voted)])

    far = values.select("work", "key").join(title_votes(values, cut), "work").select("work", "key", far_from("key", "voted").alias("far"))
    titled = rows.join(far, ["work", "key"])
    tie: list[Column] = [F.col("rank"), -F.unix_micros("retrieved_at"), F.col("ref_id")]
    best = lambda df, *order: df.groupBy("work").agg(F.min_by("ref_id", F.struct(*[o.alias(f"o{k}") for k, o in enumerate([*order, *tie])])).alias("best"))
    title = best(titled, F.col("damaged") | (F.col("far") > 0), F.col("damaged"), F.col("far")).select("work", F.lit("title").alias("field"), "best")
    authors = best(rows.where("named > 0"), -F.col("named"), -F.col("written")).select("work", F.lit("authors").alias("field"), "best")
    doi = best(rows.where("doi IS NOT NULL")).select("work", F.lit("doi").alias("field"), "best")
    return title.unionByName(authors).unionByName(doi).select(F.col("work").alias("group_ref_id"), "field", F.col("best").alias("best_ref_id"))


def merged_records(refs: DataFrame, trust: DataFrame, cut) -> DataFrame:
    """One surviving record per work, also of one record: title, authors and DOI each of the best record, sources united."""
    recs = cut(records(refs))
    labels = cut(work_groups(recs, cut))
    one = refs.dropDuplicates(["ref_id"]).where("ref_id IS NOT NULL")
    chosen = best_records(refs, trust, cut, recs, labels).withColumnRenamed("best_ref_id", "ref_id")
    # A record alone in its work is its own best record.
    alone = labels.groupBy("work").agg(F.count(F.lit(1)).alias("n"), F.min("ref_id").alias("ref_id")).where("n = 1").select(F.col("work").alias("group_ref_id"), F.explode(F.array(*map(F.lit, ("title", "authors", "doi")))).alias("field"), "ref_id")
    chosen = chosen.unionByName(alone)
    wide = chosen.join(one.select("ref_id", "title", "authors", "doi"), "ref_id").groupBy("group_ref_id").agg(
        F.max(F.when(F.col("field") == "title", F.col("title"))).alias("title"), F.max(F.when(F.col("field") == "authors", F.col("authors"))).alias("authors"), F.max(F.when(F.col("field") == "doi", F.col("doi"))).alias("doi")
    )
    united = labels.join(one.select("ref_id", F.explode_outer("sources").alias("s")), "ref_id").groupBy(F.col("work").alias("group_ref_id")).agg(F.sort_array(F.collect_set("s")).alias("sources"), F.countDistinct("ref_id").alias("n_records"))
    return united.join(wide, "group_ref_id", "left").select("group_ref_id", "title", "authors", "doi", "sources", "n_records")
