"""Named queries of the line classifiers: events, provisions, relations and identifiers in Polish and English.

All lines of all documents are read, and a few that hold every class's case,
written the same way in the SQL. A class is one pattern over the line in lower
case; all classes of a query are one array expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions import dates as D, text as T
from lexmill.plans.common import fixture, sql_fold, values
from lexmill.plans.harvest import W
from lexmill.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# Wording of each class, Polish with and without its marks, and English.
EVENTS = {
    "entry_into_force": W(r"wchodzi w (?:życie|zycie)|entry into force|shall enter into force"), "application_start": W(r"stosuje się od|ma zastosowanie od|shall apply from|applies from"), "application_end": W(r"stosuje się do|obowiązuje do|shall apply until|apply until"),
    "deadline_general": W(r"najpóźniej do|do dnia|no later than|by [0-9]{1,2}"), "transposition_deadline": W(r"(?:państwa członkowskie|panstwa czlonkowskie) przyjm\p{L}+|transpozycj\p{L}*|member states shall adopt|shall transpose"), "repeal_effective": W(r"traci moc z dniem|uchyla się z dniem|shall be repealed with effect from|repealed from"),
    "review_clause": W(r"komisja dokonuje przeglądu|przegląd niniejszego rozporządzenia|commission shall review|review this regulation"), "reporting_deadline": W(r"przedkłada sprawozdanie|sprawozdanie do|shall submit a report|submit their reports?"), "publication_reference": W(r"dzienniku urzędowym unii europejskiej|opublikowan\p{L}*|official journal of the european union|published in the official journal"),
}
PROVISIONS = {
    "entry_into_force": EVENTS["entry_into_force"], "application_start": W(r"stosuje (?:się|sie) od|shall apply from|applies from"), "transitional_provisions": W(r"przepisy (?:przejściowe|przejsciowe)|transitional (?:provisions|arrangements)"), "derogation": W(r"(?:odstępstw|odstepstw)\p{L}*|by way of derogation|derogation"),
    "repeal": W(r"uchyla (?:się|sie)|traci moc|shall be repealed|repealed"), "amendment": W(r"zmienia (?:się|sie)|is amended|amended as follows"), "commission_implementing": W(r"komisja (?:przyjmuje|ustanawia)|the commission shall adopt|commission adopts"),
    "member_state_obligation": W(r"(?:państwa członkowskie|panstwa czlonkowskie) (?:ustanawiają|wyznaczają|ustanawiaja|wyznaczaja)|member states shall (?:designate|establish)"), "sanctions": W(r"sankcj\p{L}*|kara\p{L}*|penalt(?:y|ies)|sanctions?"), "competent_authority": W(r"(?:właściw|wlasciw)\p{L}* organ\p{L}*|competent authorit(?:y|ies)"),
    "deadline": W(r"(?:najpóźniej|najpozniej) do|do dnia|no later than|by [0-9]{1,2}"),
}
ACTORS = {"commission": W(r"komisj\p{L}*|commission"), "member_states": W(r"państwa członkowskie|panstwa czlonkowskie|member states"), "competent_authority": PROVISIONS["competent_authority"], "operators": W(r"(?:operator|importer|declarant)\p{L}*")}
RELATIONS = {
    "repeals": W(r"uchyla (?:się|sie)|traci moc|repeal(?:s|ed)?|shall be repealed"), "amends": W(r"zmienia się|w art\..{0,80}otrzymuje brzmienie|amend(?:s|ed|ment)?|is amended"), "supplements": W(r"uzupełnia|dodaje się|supplement(?:s|ed)?|add(?:s|ed)?"), "implements": W(r"wykonawcz\p{L}*|wdraża|implement(?:ing|s|ed)?|implementation of"),
    "corrigendum": W(r"sprostowanie|corrigendum|rectification"), "consolidated_version": W(r"wersja skonsolidowana|tekst jednolity|consolidated version|codified version"), "procedure": W(r"procedur\p{L}*|tryb ustawodawczy|legislative procedure|comitology"), "national_adaptation": W(r"dostosow\p{L}*|przepisy krajowe|national adaptation|transposition"),
    "national_sanctions": PROVISIONS["sanctions"], "competent_authority": W(r"(?:właściw|wlasciw)\p{L}* organ\p{L}*|organ (?:właściwy|wlasciwy)|competent authorit(?:y|ies)"),
}
_B = r"(?:^|[^\p{L}\p{N}_])"
DATES = (_B + r"([0-9]{4}-[0-9]{2}-[0-9]{2})", _B + r"([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})", _B + r"([0-9]{1,2} +\p{L}+ +[0-9]{4})")
FRAMES = (
    _B + r"(w terminie [0-9]+ (?:dni|dnia|miesięcy|miesiecy|miesiące|miesiąc|lat))", _B + r"(within [0-9]+ (?:days?|months?|years?))", _B + r"([0-9]+ (?:dni|dnia|miesięcy|miesiecy|lat) od dnia)", _B + r"([0-9]+ (?:days?|months?|years?) after)",
    _B + r"(z dniem (?:następującym|nastepujacym) po dniu publikacji|on the day following publication)",
)
_ARTICLE = _B + r"(art\.? *[0-9]+[a-z]?|article +[0-9]+[a-z]?)"

LINES = [
    "Rozporządzenie wchodzi w życie 12 maja 2024.", "It shall apply from 2025-01-02 until further notice.", "Stosuje się do 31.02.2028 r.", "Najpóźniej do 05/06/2026.", "Member States shall adopt the rules within 24 months.", "Traci moc z dniem 1 stycznia 2027.", "The Commission shall review this.", "They shall submit a report by 30 June.", "Published in the Official Journal of the European Union.", "Nothing of note here.",
    "Art. 5a is amended as follows", "Article 12 lays down transitional provisions", "By way of derogation the importer may wait", "Komisja przyjmuje akty wykonawcze w terminie 30 dni", "Państwa członkowskie wyznaczają właściwe organy", "The competent authority sets penalties", "Rok 14 dni od dnia ogłoszenia, z dniem następującym po dniu publikacji", "Sprostowanie i tekst jednolity", "The legislative procedure on national adaptation", "The act adds a clause and is repealed", "Uchyla się art. 7, a w art. 9 pkt 2 otrzymuje brzmienie:",
    "Regulation 32016R0679 on data", "Dyrektywa 2019/790", "see eli/reg/2016/679/oj", "The General Data Protection Regulation and personal data", "the market in digital assets", "gdpr",
]
_FIX = [(-1, k, x) for k, x in enumerate(LINES, 1)]
_LINES_SQL = f"""lines AS MATERIALIZED (SELECT doc_id, line_no, trim(line) AS line, lower(trim(line)) AS low FROM (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
 UNION ALL SELECT doc_id, line_no, line FROM {values(_FIX, 'doc_id, line_no, line')}) WHERE trim(line) <> '')"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, line_no, line, low`` of all documents' lines that are not blank, and of the cases."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    rows = docs.unionByName(fixture(spark, _FIX, "doc_id long, line_no int, line string"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''").withColumn("low", F.lower("line"))


def _named(t: dict[str, str]) -> Column:
    return F.array_sort(F.filter(F.array(*[F.when(F.col("low").rlike(p), F.lit(k)) for k, p in t.items()]), lambda x: x.isNotNull()))


def _named_sql(t: dict[str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {_q(p)}) THEN '{k}' END" for k, p in t.items()) + "], lambda x: x IS NOT NULL))"


def _found(ps: tuple[str, ...], col: str = "line") -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(col, F.lit(p), 1) for p in ps])))


def _found_sql(ps: tuple[str, ...], col: str = "line") -> str:
    return "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all({col}, {_q(p)}, 1)" for p in ps) + "])))"


def normalised(found: Column) -> Column:
    days = F.transform(found, lambda x: D.normalise_date(F.regexp_replace(x, " +", " ")).cast("string"))
    return F.array_sort(F.array_distinct(F.filter(days, lambda x: x.isNotNull())))


_MONTHS_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in D.MONTHS.items()) + "}"


def _day_sql(x: str) -> str:
    pad = lambda y: f"lpad({y}, 2, '0')"
    part = lambda sep, k: f"split_part({x}, '{sep}', {k})"
    dotted = lambda sep: f"{part(sep, 3)} || '-' || {pad(part(sep, 2))} || '-' || {pad(part(sep, 1))}"
    words = f"regexp_replace({x}, ' +', ' ', 'g')"
    w = lambda k: f"split_part({words}, ' ', {k})"
    iso = f"CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-') THEN {x} WHEN regexp_matches({x}, '^[0-9]+[.][0-9]+[.]') THEN {dotted('.')} WHEN regexp_matches({x}, '^[0-9]+/[0-9]+/') THEN {dotted('/')} WHEN regexp_matches({words}, '^[0-9]+ \\p{{L}}+ [0-9]+$') THEN {w(3)} || '-' || {pad(f'CAST({_MONTHS_SQL}[lower({w(2)})] AS VARCHAR)')} || '-' || {pad(w(1))} END"
    return f"CAST(TRY_CAST({iso} AS DATE) AS VARCHAR)"


def _normalised_sql(found: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({found}, lambda x: {_day_sql('x')}), lambda y: y IS NOT NULL)))"


_JOIN = lambda c: F.array_join(c, ",")
_JOIN_SQL = lambda c: f"array_to_string({c}, ',')"


@query(f"""WITH {_LINES_SQL}, e AS (SELECT *, {_named_sql(EVENTS)} AS ev, {_found_sql(DATES)} AS ds, {_found_sql(FRAMES, 'low')} AS fs FROM lines)
 SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {_JOIN_SQL('ev')} AS events, {_JOIN_SQL('ds')} AS dates, {_JOIN_SQL(_normalised_sql('ds'))} AS days, {_JOIN_SQL('fs')} AS timeframes FROM e WHERE len(ev) > 0 OR len(ds) > 0 OR len(fs) > 0""")
def h30_legal_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a legal event, a date or a time frame; a date that is no day stays unnormalised."""
    e = lines(spark, d).select("doc_id", "line_no", _named(EVENTS).alias("ev"), _found(DATES).alias("ds"), _found(FRAMES, "low").alias("fs")).where("size(ev) > 0 OR size(ds) > 0 OR size(fs) > 0")
    return e.select("doc_id", "line_no", _JOIN("ev").alias("events"), _JOIN("ds").alias("dates"), _JOIN(normalised(F.col("ds"))).alias("days"), _JOIN("fs").alias("timeframes"))


@query(f"WITH {_LINES_SQL}, e AS (SELECT *, {_named_sql(EVENTS)} AS ev, {_normalised_sql(_found_sql(DATES))} AS ds, {_found_sql(DATES)} AS raw, {_found_sql(FRAMES, 'low')} AS fs FROM lines), k AS (SELECT * FROM e WHERE len(ev) > 0 OR len(raw) > 0 OR len(fs) > 0) SELECT 'lines' AS what, count(*) AS n FROM k UNION ALL SELECT 'with_dates', count(*) FILTER (len(ds) > 0) FROM k UNION ALL SELECT 'with_timeframes', count(*) FILTER (len(fs) > 0) FROM k UNION ALL SELECT 'event:' || ev, count(*) FROM (SELECT unnest(ev) AS ev FROM k) GROUP BY ev")
def a4_date_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the legal lines, in one aggregation: each line gives the names it counts under."""
    k = h30_legal_lines(spark, d)
    names = F.concat(F.array(F.lit("lines"), F.when(F.col("days") != "", "with_dates"), F.when(F.col("timeframes") != "", "with_timeframes")), F.when(F.col("events") != "", F.transform(F.split("events", ","), lambda x: F.concat(F.lit("event:"), x))).otherwise(F.array().cast("array<string>")))
    return k.select(F.explode(names).alias("what")).where("what IS NOT NULL").groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINES_SQL}, e AS (SELECT *, {_named_sql(PROVISIONS)} AS ev, {_found_sql(DATES)} AS ds, {_found_sql(FRAMES[:4], 'low')} AS fs, {_found_sql((_ARTICLE,), 'low')} AS arts, {_named_sql(ACTORS)} AS ac FROM lines)
 SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {_JOIN_SQL('ev')} AS events, {_JOIN_SQL('ac')} AS actors, {_JOIN_SQL('arts')} AS articles, {_JOIN_SQL(_normalised_sql('ds'))} AS days, {_JOIN_SQL('fs')} AS timeframes FROM e WHERE len(ev) > 0 OR len(ds) > 0 OR len(fs) > 0 OR len(arts) > 0""")
def h31_final_provisions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of final provisions: any event, article, date or time frame; actors alone do not keep a line."""
    e = lines(spark, d).select("doc_id", "line_no", _named(PROVISIONS).alias("ev"), _named(ACTORS).alias("ac"), _found(DATES).alias("ds"), _found(FRAMES[:4], "low").alias("fs"), _found((_ARTICLE,), "low").alias("arts"))
    e = e.where("size(ev) > 0 OR size(ds) > 0 OR size(fs) > 0 OR size(arts) > 0")
    return e.select("doc_id", "line_no", _JOIN("ev").alias("events"), _JOIN("ac").alias("actors"), _JOIN("arts").alias("articles"), _JOIN(normalised(F.col("ds"))).alias("days"), _JOIN("fs").alias("timeframes"))


@query(f"""WITH {_LINES_SQL}, e AS (SELECT {_named_sql(PROVISIONS)} AS ev, {_found_sql(DATES)} AS ds, {_found_sql(FRAMES[:4], 'low')} AS fs, {_found_sql((_ARTICLE,), 'low')} AS arts, {_named_sql(ACTORS)} AS ac FROM lines), k AS (SELECT * FROM e WHERE len(ev) > 0 OR len(ds) > 0 OR len(fs) > 0 OR len(arts) > 0)
 SELECT 'event:' || x AS what, count(*) AS n FROM (SELECT unnest(ev) AS x FROM k) GROUP BY x UNION ALL SELECT 'actor:' || x, count(*) FROM (SELECT unnest(ac) AS x FROM k) GROUP BY x UNION ALL SELECT 'lines', count(*) FROM k UNION ALL SELECT 'with_dates', count(*) FILTER (len({_normalised_sql('ds')}) > 0) FROM k UNION ALL SELECT 'with_deadlines', count(*) FILTER (len(fs) > 0 OR list_contains(ev, 'deadline')) FROM k""")
def a3_provision_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each event and actor occurs, and how many lines have dates and deadlines."""
    k = h31_final_provisions(spark, d)
    prefixed = lambda c, p: F.when(F.col(c) != "", F.transform(F.split(c, ","), lambda x: F.concat(F.lit(p), x))).otherwise(F.array().cast("array<string>"))
    late = (F.col("timeframes") != "") | F.array_contains(F.split("events", ","), "deadline")
    names = F.concat(F.array(F.lit("lines"), F.when(F.col("days") != "", "with_dates"), F.when(late, "with_deadlines")), prefixed("events", "event:"), prefixed("actors", "actor:"))
    return k.select(F.explode(names).alias("what")).where("what IS NOT NULL").groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {_JOIN_SQL('r')} AS relations FROM (SELECT *, {_named_sql(RELATIONS)} AS r FROM lines) WHERE len(r) > 0")
def h32_relation_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", _JOIN(_named(RELATIONS)).alias("relations")).where("relations <> ''")


@query(f"WITH {_LINES_SQL} SELECT relation, count(*) AS n FROM (SELECT unnest({_named_sql(RELATIONS)}) AS relation FROM lines) GROUP BY relation")
def a5_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(F.explode(_named(RELATIONS)).alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


# Instruments with their full names and hints.
ALIASES = (("gdpr", "general data protection regulation", ("personal data", "data subject")), ("mica", "regulation on markets in crypto assets", ("digital assets", "token")), ("dsm", "directive on copyright in the digital single market", ("copyright",)), ("rome-i", "regulation on the law applicable to contractual obligations", ("applicable law", "contract")))
STOPWORDS = ("the", "and", "for", "with", "regulation", "directive", "law")
_CELEX, _ELI, _ACT = r"(?:^|[^0-9A-Za-z])(3?[0-9]{4}[RLD][0-9]{4})(?:$|[^0-9A-Za-z])", r"(eli/[a-z_]+/[0-9]{4}/[0-9]+(?:/oj)?)", r"(?:^|[^0-9/])([0-9]{4}/[0-9]{1,4}|[0-9]{1,4}/[0-9]{4})(?:$|[^0-9/])"


def _tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9-]{3,})"), 1)), lambda x: ~x.isin(*STOPWORDS))


def _tokens_sql(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({x}, '([a-z0-9-]{{3,}})', 1)), lambda t: t NOT IN ({', '.join(map(_q, STOPWORDS))}))"


def _rank_sql(key: str, name: str, hints: tuple[str, ...]) -> tuple[str, str]:
    hits = " + ".join(f"CAST(contains(f, {_q(h)}) AS INTEGER)" for h in hints)
    overlap = f"len(list_intersect(tk, {_tokens_sql(_q(name))}))"
    return f"6 * CAST(regexp_matches(f, {_q(W(key))}) AS INTEGER) + 4 * CAST(contains(f, {_q(name)}) AS INTEGER) + 3 * ({hits}) + CASE WHEN {overlap} >= 2 THEN {overlap} ELSE 0 END", hits


_RANKED_SQL = " UNION ALL ".join(f"SELECT doc_id, line_no, {k} AS ordinal, '{a}' AS alias, CAST({_rank_sql(a, n, h)[0]} AS INTEGER) AS score, CAST({_rank_sql(a, n, h)[1]} AS INTEGER) AS hints FROM fl" for k, (a, n, h) in enumerate(ALIASES))
_FL_SQL = f"fl AS (SELECT *, {_tokens_sql('f')} AS tk FROM (SELECT doc_id, line_no, line, lower({sql_fold('line')}) AS f FROM lines))"


def alias_scores(rows: DataFrame) -> DataFrame:
    """``ranked``: aliases of a score above 0 as (-score, -hints, place, alias), best first; the table is unrolled, not joined."""
    f = F.lower(T.fold(F.col("line")))
    rows = rows.withColumn("f", f).withColumn("tk", _tokens(F.col("f")))
    each = []
    for k, (key, name, hints) in enumerate(ALIASES):
        hit = sum((F.col("f").contains(h).cast("int") for h in hints), F.lit(0))
        overlap = F.size(F.array_intersect("tk", _tokens(F.lit(name))))
        score = 6 * F.col("f").rlike(W(key)).cast("int") + 4 * F.col("f").contains(name).cast("int") + 3 * hit + F.when(overlap >= 2, overlap).otherwise(0)
        each.append(F.when(score > 0, F.struct((-score).alias("s"), (-hit).alias("h"), F.lit(k).alias("k"), F.lit(key).alias("alias"))))
    return rows.withColumn("ranked", F.array_sort(F.filter(F.array(*each), lambda x: x.isNotNull())))


@query(f"WITH {_LINES_SQL}, {_FL_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, string_agg(alias || '=' || score, ',' ORDER BY score DESC, hints DESC, ordinal) AS ranking FROM ({_RANKED_SQL}) WHERE score > 0 GROUP BY doc_id, line_no")
def l2_alias_order(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of each line by score, then by hints, then as listed."""
    r = alias_scores(lines(spark, d)).where("size(ranked) > 0")
    return r.select("doc_id", "line_no", F.array_join(F.transform("ranked", lambda x: F.concat_ws("=", x["alias"], (-x["s"]).cast("string"))), ",").alias("ranking"))


@query(f"WITH {_LINES_SQL}, {_FL_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '{a}' AS alias, CAST(len(list_intersect(tk, {_tokens_sql(_q(n))})) AS INTEGER) AS shared FROM fl" for a, n, _ in ALIASES) + ") WHERE shared >= 2")
def u3_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Lines that share two words or more with an instrument's name."""
    rows = lines(spark, d).withColumn("tk", _tokens(F.lower(T.fold(F.col("line")))))
    shared = F.array(*[F.struct(F.lit(a).alias("alias"), F.size(F.array_intersect("tk", _tokens(F.lit(n)))).alias("shared")) for a, n, _ in ALIASES])
    return rows.select("doc_id", "line_no", F.explode(F.filter(shared, lambda x: x["shared"] >= 2)).alias("x")).select("doc_id", "line_no", "x.*")


@query(f"""WITH {_LINES_SQL}, {_FL_SQL}, r AS (SELECT doc_id, line_no, arg_min(alias, {{'s': -score, 'h': -hints, 'o': ordinal}}) AS alias, max(score) AS score FROM ({_RANKED_SQL}) WHERE score > 0 GROUP BY doc_id, line_no),
 x AS (SELECT l.doc_id, l.line_no, nullif(regexp_extract(line, {_q(_CELEX)}, 1), '') AS celex, nullif(regexp_extract(line, {_q(_ELI)}, 1), '') AS eli, nullif(regexp_extract(line, {_q(_ACT)}, 1), '') AS act, alias, score FROM lines l LEFT JOIN r ON r.doc_id = l.doc_id AND r.line_no = l.line_no)
 SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN celex IS NOT NULL THEN 'celex' WHEN eli IS NOT NULL THEN 'eli' WHEN alias IS NOT NULL THEN 'alias' ELSE 'act_number' END AS match_type, CASE WHEN celex IS NOT NULL THEN CASE WHEN length(celex) = 9 THEN '3' || celex ELSE celex END ELSE coalesce(eli, alias, act) END AS identifier,
 CASE WHEN celex IS NOT NULL OR eli IS NOT NULL THEN 'high' WHEN alias IS NOT NULL AND score >= 6 THEN 'high' ELSE 'medium' END AS confidence FROM x WHERE coalesce(celex, eli, alias, act) IS NOT NULL""")
def h33_identify(spark: SparkSession, d: str) -> DataFrame:
    """The first that a line holds of: a CELEX number, an ELI path, an alias, an act's number."""
    pick = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    best = F.try_element_at("ranked", F.lit(1))
    x = alias_scores(lines(spark, d)).select("doc_id", "line_no", pick(_CELEX).alias("celex"), pick(_ELI).alias("eli"), pick(_ACT).alias("act"), best["alias"].alias("alias"), (-best["s"]).alias("score"))
    kind = F.when(F.col("celex").isNotNull(), "celex").when(F.col("eli").isNotNull(), "eli").when(F.col("alias").isNotNull(), "alias").otherwise("act_number")
    celex = F.when(F.length("celex") == 9, F.concat(F.lit("3"), "celex")).otherwise(F.col("celex"))
    sure = F.when(F.col("celex").isNotNull() | F.col("eli").isNotNull() | F.coalesce(F.col("score") >= 6, F.lit(False)), "high").otherwise("medium")
    return x.where("coalesce(celex, eli, alias, act) IS NOT NULL").select("doc_id", "line_no", kind.alias("match_type"), F.coalesce(celex, "eli", "alias", "act").alias("identifier"), sure.alias("confidence"))
