"""Named queries of the remaining small operators: predicates, lookups, scalar functions, classifiers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexmill.functions import dates as D, text as T
from lexmill.operators import tabular
from lexmill.plans.common import fixture, values
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


_DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
_PARA = "(SELECT DISTINCT doc_id, idx, text FROM blocks WHERE block_type = 'paragraph' AND text IS NOT NULL)"


def _para(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").where("block_type = 'paragraph' AND text IS NOT NULL").select("doc_id", "idx", "text").distinct()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL")


# ---- predicates

_HEADS = [("Invoice_No",), ("  Time   Keeper ",), ("HOURS",), ("a_b  c",)]


@query(f"SELECT h, trim(regexp_replace(replace(lower(h), '_', ' '), ' +', ' ', 'g')) AS field FROM {values(_HEADS, 'h')}")
def pred7_header_key(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _HEADS, "h string").select("h", tabular.header_key(F.col("h")).alias("field"))


_FOUND = [(1, 0, "x = 1"), (2, 2, "key = 'a'  # noqa"), (3, 3, "eval(x)"), (4, 2, "b"), (5, 1, "rule: never use eval"), (6, 2, "example of eval")]


@query(f"SELECT id FROM {values(_FOUND, 'id, severity, line')} WHERE severity >= 2 AND NOT regexp_matches(line, '(noqa|nosec|scan:ignore)') AND NOT regexp_matches(line, '^(rule|example)')")
def pred10_severity_floor(spark: SparkSession, d: str) -> DataFrame:
    """Findings at or above a severity, less marked lines (P11) and lines that talk about the rule (P12)."""
    from lexmill.operators.rules import suppressed

    f = fixture(spark, _FOUND, "id int, severity int, line string")
    return f.where((F.col("severity") >= 2) & ~suppressed(F.col("line")) & ~F.col("line").rlike("^(rule|example)")).select("id")


_PREDICATES = [(1, "buyer", "equals", "buyer"), (2, "buyer", "one_of", "seller,buyer"), (3, "C-12", "regex", "[A-Z]-[0-9]+"), (4, "C-12x", "regex", "[A-Z]-[0-9]+"), (5, None, "equals", "x"), (6, "b", "one_of", "seller,buyer")]


@query(f"SELECT id, coalesce(CASE kind WHEN 'equals' THEN v = want WHEN 'one_of' THEN list_contains(string_split(want, ','), v) WHEN 'regex' THEN regexp_full_match(v, want) END, false) AS ok FROM {values(_PREDICATES, 'id, v, kind, want')}")
def pred15_value_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = fixture(spark, _PREDICATES, "id int, v string, kind string, want string")
    ok = F.when(F.col("kind") == "equals", F.col("v") == F.col("want")).when(F.col("kind") == "one_of", F.array_contains(F.split("want", ","), F.col("v"))).when(F.col("kind") == "regex", F.expr("v RLIKE concat('^(?:', want, ')$')"))
    return p.select("id", F.coalesce(ok, F.lit(False)).alias("ok"))


@query("SELECT ref_id, title IS NOT NULL AND title <> '' AS titled, coalesce(len(authors), 0) > 0 AS has_authors, verifiable_id.value IS NOT NULL AND verifiable_id.value <> '' AS has_id FROM (SELECT ref_id, any_value(title) AS title, any_value(authors) AS authors, any_value(verifiable_id) AS verifiable_id FROM refs GROUP BY ref_id)")
def pred16_filled(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").groupBy("ref_id").agg(F.any_value("title").alias("title"), F.any_value("authors").alias("authors"), F.any_value("verifiable_id").alias("v"))
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return r.select("ref_id", F.coalesce(full("title"), F.lit(False)).alias("titled"), (F.coalesce(F.size("authors"), F.lit(0)) > 0).alias("has_authors"), F.coalesce(full("v.value"), F.lit(False)).alias("has_id"))


# ---- sources on literals

_RESULTS = [("hal", '{"title_s": ["A study"], "doiId_s": "10.1000/a", "producedDateY_i": 2020}'), ("openalex", '{"title": "A study", "doi": "https://doi.org/10.1000/A", "publication_year": 2020}'), ("crossref", '{"title": ["Other"], "DOI": "10.1000/B"}')]


@query(f"SELECT source, CASE source WHEN 'hal' THEN json_extract_string(x, '$.title_s[0]') WHEN 'openalex' THEN json_extract_string(x, '$.title') ELSE json_extract_string(x, '$.title[0]') END AS title, regexp_replace(lower(coalesce(json_extract_string(x, '$.doiId_s'), json_extract_string(x, '$.doi'), json_extract_string(x, '$.DOI'))), '^https://doi.org/', '') AS doi, TRY_CAST(coalesce(json_extract_string(x, '$.producedDateY_i'), json_extract_string(x, '$.publication_year')) AS INTEGER) AS year FROM {values(_RESULTS, 'source, x')}")
def s21_common_record(spark: SparkSession, d: str) -> DataFrame:
    """Records of several services in one schema."""
    r = fixture(spark, _RESULTS, "source string, x string")
    j = lambda p: F.get_json_object("x", p)
    title = F.when(F.col("source") == "hal", j("$.title_s[0]")).when(F.col("source") == "openalex", j("$.title")).otherwise(j("$.title[0]"))
    return r.select("source", title.alias("title"), T.doi(F.coalesce(j("$.doiId_s"), j("$.doi"), j("$.DOI"))).alias("doi"), F.coalesce(j("$.producedDateY_i"), j("$.publication_year")).try_cast("int").alias("year"))


_BASE = [("- fingerprint: ab12",), ("  reason: known",), ("- fingerprint: 'cd34'",), ("# comment",)]


@query(f"SELECT regexp_extract(line, 'fingerprint: *[\"'']?([0-9a-f]+)', 1) AS fingerprint FROM {values(_BASE, 'line')} WHERE contains(line, 'fingerprint:')")
def s29_baseline_lines(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _BASE, "line string").where(F.col("line").contains("fingerprint:")).select(F.regexp_extract("line", "fingerprint: *[\"']?([0-9a-f]+)", 1).alias("fingerprint"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^(#{{1,6}} |\\s*[-*] )') THEN 'markdown' ELSE 'text' END AS reader FROM {_DOCS}")
def s16_route_by_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.when(F.col("text").rlike(r"(?m)^(#{1,6} |\s*[-*] )"), "markdown").otherwise("text").alias("reader"))


@query("SELECT doc_id, idx, CASE WHEN k > 40 THEN 'TRUNCATED' END AS code FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM (SELECT DISTINCT doc_id, idx FROM blocks))")
def s30_limit_codes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks beyond a document's limit get a code and stay; places within a document are dense or gapped."""
    from lexmill.operators.ordered import running_number

    b = table(spark, d, "blocks").select("doc_id", "idx").distinct()
    numbered = running_number(b, "doc_id", ["idx"], F.floor(F.col("idx") / 1024), "k")
    return numbered.select("doc_id", "idx", F.when(F.col("k") > 40, "TRUNCATED").alias("code"))


# ---- lookups

@query("SELECT DISTINCT l.parent FROM ownership_links l ANTI JOIN (SELECT DISTINCT child FROM ownership_links WHERE child IS NOT NULL) c ON l.parent = c.child WHERE l.parent IS NOT NULL")
def j5_orphan_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents that stand below nobody."""
    links = table(spark, d, "ownership_links")
    children = links.where("child IS NOT NULL").select(F.col("child").alias("parent")).distinct()
    return links.where("parent IS NOT NULL").select("parent").distinct().join(children, "parent", "left_anti")


@query("SELECT matter_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS net FROM (SELECT matter_id, count(*) AS n FROM documents WHERE matter_id IS NOT NULL AND doc_date < DATE '2022-01-01' GROUP BY matter_id) a FULL JOIN (SELECT matter_id, count(*) AS n FROM documents WHERE matter_id IS NOT NULL AND doc_date >= DATE '2022-01-01' GROUP BY matter_id) b USING (matter_id) WHERE coalesce(b.n, 0) - coalesce(a.n, 0) > 0")
def j14_net_new(spark: SparkSession, d: str) -> DataFrame:
    """More documents after the date than before, in one aggregation instead of a full join."""
    late = F.when(F.col("doc_date") >= "2022-01-01", 1).when(F.col("doc_date") < "2022-01-01", -1).otherwise(0).cast("long")
    return table(spark, d, "documents").where("matter_id IS NOT NULL").groupBy("matter_id").agg(F.sum(late).alias("net")).where("net > 0")


@query("SELECT a.doc_id, a.text IS NOT DISTINCT FROM b.text AS same FROM documents a JOIN (SELECT doc_id, text FROM documents) b ON a.doc_id = b.doc_id")
def j16_checksum_join(spark: SparkSession, d: str) -> DataFrame:
    """Expected and actual hashes compared by key; the texts themselves are not moved."""
    h = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return h.join(h.select("doc_id", F.col("h").alias("want")), "doc_id").select("doc_id", (F.col("h") == F.col("want")).alias("same"))


_PLACES = [(1, "Kiev"), (2, "Kyiv"), (3, "Lwów"), (4, "Lviv"), (5, "Paris")]
_VARIANTS = [("kiev", "kyiv"), ("lwow", "lviv")]


@query(f"SELECT id, coalesce(canonical, lower(translate(place, 'ó', 'o'))) AS place FROM {values(_PLACES, 'id, place')} LEFT JOIN {values(_VARIANTS, 'variant, canonical')} ON lower(translate(place, 'ó', 'o')) = variant")
def j20_place_variants(spark: SparkSession, d: str) -> DataFrame:
    p = fixture(spark, _PLACES, "id int, place string").withColumn("variant", F.lower(T.fold(F.col("place"))))
    return p.join(F.broadcast(fixture(spark, _VARIANTS, "variant string, canonical string")), "variant", "left").select("id", F.coalesce("canonical", "variant").alias("place"))


# ---- aggregations and order

@query("SELECT source_format, lang, count(*) AS docs FROM documents GROUP BY GROUPING SETS ((source_format), (lang), ())")
def a8_counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.groupingSets([["source_format"], ["lang"], []], "source_format", "lang").agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT doc_id, count(*) FILTER (text LIKE '%shall%') AS required, count(*) FILTER (text LIKE '% may %') AS optional, count(*) AS total FROM {_PARA} GROUP BY doc_id")
def a19_condition_counts(spark: SparkSession, d: str) -> DataFrame:
    return _para(spark, d).groupBy("doc_id").agg(F.count_if(F.col("text").contains("shall")).alias("required"), F.count_if(F.col("text").contains(" may ")).alias("optional"), F.count(F.lit(1)).alias("total"))


@query("SELECT field, CASE WHEN filled > 0 THEN 'populated' ELSE 'absent' END AS coverage FROM (SELECT unnest(['title', 'doi', 'year', 'container']) AS field, unnest([count(title), count(doi), count(year), count(container)]) AS filled FROM refs)")
def a25_field_coverage(spark: SparkSession, d: str) -> DataFrame:
    fields = ("title", "doi", "year", "container")
    n = table(spark, d, "refs").agg(*[F.count(c).alias(c) for c in fields])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.when(F.col(c) > 0, "populated").otherwise("absent").alias("coverage")) for c in fields])).alias("x")).select("x.*")


@query(f"SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '[0-9]+[.,][0-9]+'))) AS BIGINT) AS decimals, count(DISTINCT regexp_extract(text, '([A-Z][a-z]+) (?:Ltd|Inc|Corp)', 1)) AS names FROM {_PARA} GROUP BY doc_id")
def a27_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return _para(spark, d).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit("[0-9]+[.,][0-9]+"))).alias("decimals"), F.count_distinct(F.regexp_extract("text", "([A-Z][a-z]+) (?:Ltd|Inc|Corp)", 1)).alias("names"))


_RULE_PAIRS = [(1, 1, "del", "a "), (1, 2, "ins", "the "), (1, 3, "regular", "the end"), (2, 1, "ins", "x "), (2, 2, "regular", " y")]


@query(f"SELECT para, seg, CASE WHEN ends_with(part, ' ') AND starts_with(nxt, ' ') THEN 'double space' WHEN trim(part) = split_part(trim(nxt), ' ', 1) THEN 'repeated word' END AS finding FROM (SELECT *, lead(part) OVER (PARTITION BY para ORDER BY seg) AS nxt FROM {values(_RULE_PAIRS, 'para, seg, kind, part')}) WHERE (ends_with(part, ' ') AND starts_with(nxt, ' ')) OR trim(part) = split_part(trim(nxt), ' ', 1)")
def w8_pair_rules(spark: SparkSession, d: str) -> DataFrame:
    s = fixture(spark, _RULE_PAIRS, "para int, seg int, kind string, part string").withColumn("nxt", F.lead("part").over(Window.partitionBy("para").orderBy("seg")))
    finding = F.when(F.col("part").endswith(" ") & F.col("nxt").startswith(" "), "double space").when(F.trim("part") == F.split_part(F.trim("nxt"), F.lit(" "), F.lit(1)), "repeated word")
    return s.select("para", "seg", finding.alias("finding")).where("finding IS NOT NULL")


@query("SELECT DISTINCT ref_id, array_to_string(authors[1:4], '; ') AS first_four FROM refs WHERE len(authors) > 0")
def l4_first_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").where("size(authors) > 0").select("ref_id", F.array_join(F.slice("authors", 1, 4), "; ").alias("first_four")).distinct()


@query("SELECT DISTINCT ref_id, array_to_string(list_sort(list_distinct(list_filter(sources, lambda x: x <> ''))), ',') AS sources FROM refs WHERE sources IS NOT NULL")
def x7_unique_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").where("sources IS NOT NULL").select("ref_id", F.array_join(F.array_sort(F.array_distinct(F.filter("sources", lambda x: x != ""))), ",").alias("sources")).distinct()


# ---- text and dates

@query(f"SELECT doc_id, idx, regexp_extract(text, '^([A-Z][A-Za-z. ]*?) (?:shall|agrees to|may|undertakes|relies)', 1) AS subject FROM {_PARA} WHERE regexp_matches(text, '^([A-Z][A-Za-z. ]*?) (?:shall|agrees to|may|undertakes|relies)')")
def t10_subject(spark: SparkSession, d: str) -> DataFrame:
    p = "^([A-Z][A-Za-z. ]*?) (?:shall|agrees to|may|undertakes|relies)"
    return _para(spark, d).where(F.col("text").rlike(p)).select("doc_id", "idx", F.regexp_extract("text", p, 1).alias("subject"))


@query("SELECT DISTINCT party_id, concat_ws('|', CASE WHEN type = 'person' THEN 'P' WHEN type = 'organisation' THEN 'O' ELSE 'U' END, nullif(trim(lower(name)), ''), jurisdiction) AS key FROM parties")
def t8_semantic_key(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("type") == "person", "P").when(F.col("type") == "organisation", "O").otherwise("U")
    return table(spark, d, "parties").select("party_id", F.concat_ws("|", kind, F.nullif(F.trim(F.lower("name")), F.lit("")), F.col("jurisdiction")).alias("key")).distinct()


@query(f"SELECT doc_id, idx, regexp_extract(text, 'notice that ([A-Z][A-Za-z. ]+?) sent', 1) AS sender, CASE WHEN contains(text, 'registered mail') THEN 'mail' WHEN contains(text, 'written notice') THEN 'writing' ELSE 'unknown' END AS method FROM {_PARA} WHERE contains(text, 'notice')")
def t14_notice_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    method = F.when(t.contains("registered mail"), "mail").when(t.contains("written notice"), "writing").otherwise("unknown")
    return _para(spark, d).where(t.contains("notice")).select("doc_id", "idx", F.regexp_extract("text", "notice that ([A-Z][A-Za-z. ]+?) sent", 1).alias("sender"), method.alias("method"))


_RANKS = [(1, "first"), (2, "2nd"), (3, "third"), (4, "21st"), (5, "last"), (6, "")]


@query(f"SELECT id, coalesce(CASE lower(w) WHEN 'first' THEN 1 WHEN 'second' THEN 2 WHEN 'third' THEN 3 WHEN 'fourth' THEN 4 END, TRY_CAST(nullif(regexp_extract(w, '^([0-9]+)(?:st|nd|rd|th)$', 1), '') AS INTEGER)) AS rank FROM {values(_RANKS, 'id, w')}")
def t16_rank(spark: SparkSession, d: str) -> DataFrame:
    words = F.create_map(*[F.lit(x) for k, w in enumerate(("first", "second", "third", "fourth"), 1) for x in (w, k)])
    number = F.nullif(F.regexp_extract("w", "^([0-9]+)(?:st|nd|rd|th)$", 1), F.lit("")).try_cast("int")
    return fixture(spark, _RANKS, "id int, w string").select("id", F.coalesce(F.try_element_at(words, F.lower("w")), number).alias("rank"))


# Roles in order of precedence.
ROLES = ("guarantor", "licensor", "lessee", "seller", "buyer")


@query(f"SELECT doc_id, idx, CASE {' '.join(f'''WHEN contains(lower(text), '{r}') THEN '{r}' ''' for r in ROLES)} END AS role FROM {_PARA} WHERE {' OR '.join(f'''contains(lower(text), '{r}')''' for r in ROLES)}")
def t17_role(spark: SparkSession, d: str) -> DataFrame:
    """The first role of a fixed order that the text names."""
    low = F.lower("text")
    role = F.coalesce(*[F.when(low.contains(r), F.lit(r)) for r in ROLES])
    return _para(spark, d).select("doc_id", "idx", role.alias("role")).where("role IS NOT NULL")


# Marker words of each language.
MARKERS = {"de": "der die das und nicht", "es": "el los las del una", "pt": "os das uma não pelo", "pl": "się nie oraz przez jest"}
_MARK = {k: "(^| )(" + "|".join(w.split()) + ")( |$)" for k, w in MARKERS.items()}


@query("SELECT doc_id, arg_max(lang, {'n': n, 'l': lang}) AS lang, max(n) AS hits FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS lang, len(regexp_extract_all(lower(text), '{p}')) AS n FROM {_DOCS}" for k, p in _MARK.items()) + ") GROUP BY doc_id HAVING max(n) >= 5")
def t33_marker_language(spark: SparkSession, d: str) -> DataFrame:
    counts = F.array(*[F.struct(F.regexp_count(F.lower("text"), F.lit(p)).cast("long").alias("n"), F.lit(k).alias("lang")) for k, p in _MARK.items()])
    return _docs(spark, d).select("doc_id", F.array_max(counts).alias("b")).select("doc_id", "b.lang", F.col("b.n").alias("hits")).where("hits >= 5")


@query(f"SELECT doc_id, idx, unnest(regexp_extract_all(text, '(within|for a period of|for at least) [0-9]+ (days|months|years)')) AS phrase FROM {_PARA}")
def d3_timeframes(spark: SparkSession, d: str) -> DataFrame:
    return _para(spark, d).select("doc_id", "idx", F.explode(F.regexp_extract_all("text", F.lit("(within|for a period of|for at least) [0-9]+ (days|months|years)"), 0)).alias("phrase"))


_DEADLINE = ("no later than ([A-Z][a-z]+ [0-9]+, [0-9]{4})", "before ([A-Z][a-z]+ [0-9]+, [0-9]{4})", "on ([0-9]+ days). written notice", "within ([0-9]+ days)", "(promptly)")


@query("SELECT doc_id, idx, deadline FROM (SELECT doc_id, idx, coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in _DEADLINE) + f") AS deadline FROM {_PARA}) WHERE deadline IS NOT NULL")
def d5_deadline_phrase(spark: SparkSession, d: str) -> DataFrame:
    """The first kind of deadline, in a fixed order, that the text states."""
    pick = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in _DEADLINE])
    return _para(spark, d).select("doc_id", "idx", pick.alias("deadline")).where("deadline IS NOT NULL")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 17 HOUR ELSE CAST(CAST(o_orderdate AS DATE) + CAST(greatest(o_orderkey % 4, 1) AS INTEGER) AS TIMESTAMP) END AS ends FROM orders")
def d11_event_end(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    end = D.event_end(F.to_date("o_orderdate"), F.col("o_orderkey") % 4, F.col("o_orderpriority") == "1-URGENT")
    return o.select("o_orderkey", end.cast("timestamp_ntz").alias("ends"))


_HASHED = [(1, "body SELF more"), (2, "SELF"), (3, "none")]


@query(f"SELECT id, sha256(replace(x, 'SELF', repeat('0', 64))) AS own FROM {values(_HASHED, 'id, x')}")
def d15_self_hash(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _HASHED, "id int, x string").select("id", F.sha2(F.replace("x", F.lit("SELF"), F.lit("0" * 64)), 256).alias("own"))


_SCORES = [(1, 0.125), (2, 0.685), (3, 1.5), (4, -0.2), (5, 0.335), (6, 0.0)]


@query(f"SELECT id, round_even(least(greatest(CAST(x AS DOUBLE), 0.0), 1.0), 2) AS score FROM {values(_SCORES, 'id, x')}")
def d16_clamped_score(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _SCORES, "id int, x double").select("id", D.clamp_score(F.col("x")).alias("score"))


_LOOSE = [(1, '{"b": [1, {"c": true}], "a": null}'), (2, "[]"), (3, "x"), (4, '"s"')]
_FLAT = [(1, "a=; b[0]=1; b[1].c=true"), (2, ""), (3, None), (4, "=s")]


@query(f"SELECT * FROM {values(_FLAT, 'id, flat')}")
def x2_flatten_json(spark: SparkSession, d: str) -> DataFrame:
    """Any JSON as sorted ``path=value`` pairs; null where it is none."""

    def walk(v, path=""):
        if isinstance(v, dict):
            for k in sorted(v):
                yield from walk(v[k], f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            for k, x in enumerate(v):
                yield from walk(x, f"{path}[{k}]")
        else:
            yield f"{path}={'' if v is None else str(v).lower() if isinstance(v, bool) else v}"

    @F.pandas_udf("string")
    def flat(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return "; ".join(walk(json.loads(t)))
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return fixture(spark, _LOOSE, "id int, x string").select("id", flat("x").alias("flat"))


# ---- classifiers

_CLOSING = {"completeness": ("Definitions", "Governing law", "Notices"), "money": ("Price and payment", "Limitation of liability")}


@query("SELECT doc_id, " + ", ".join(f"count(DISTINCT text) FILTER (text IN ({', '.join(repr(x) for x in xs)})) = {len(xs)} AS {k}" for k, xs in _CLOSING.items()) + " FROM blocks WHERE block_type = 'heading' GROUP BY doc_id")
def h37_completeness(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "blocks").where("block_type = 'heading'")
    whole = lambda xs: F.count_distinct(F.when(F.col("text").isin(*xs), F.col("text"))) == len(xs)
    return h.groupBy("doc_id").agg(*[whole(xs).alias(k) for k, xs in _CLOSING.items()])


_TRACKED = [(1, 1, "ins", ""), (1, 2, "del", "a"), (1, 3, "ins", "a"), (2, 1, "del", "x"), (2, 2, "ins", "y"), (3, 1, "regular", "k")]


@query(f"SELECT para, seg, CASE WHEN part = '' THEN 'empty' ELSE 'no change' END AS noop FROM (SELECT *, lead(part) OVER w AS np, lead(kind) OVER w AS nk FROM {values(_TRACKED, 'para, seg, kind, part')} WINDOW w AS (PARTITION BY para ORDER BY seg)) WHERE kind <> 'regular' AND (part = '' OR (kind = 'del' AND nk = 'ins' AND np = part))")
def h39_noop_changes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("para").orderBy("seg")
    s = fixture(spark, _TRACKED, "para int, seg int, kind string, part string").withColumn("np", F.lead("part").over(w)).withColumn("nk", F.lead("kind").over(w))
    hit = (F.col("kind") != "regular") & ((F.col("part") == "") | (F.col("kind") == "del") & (F.col("nk") == "ins") & (F.col("np") == F.col("part")))
    return s.where(hit).select("para", "seg", F.when(F.col("part") == "", "empty").otherwise("no change").alias("noop"))


_AUTHORS = [(1, "Kim", 12, 1), (2, "", 3, 3), (3, "Lee", 20, 3), (4, "Lee", 9, 1)]


@query(f"SELECT id, author = '' OR (edits >= 10 AND edits >= 5 * paragraphs) AS artifact FROM {values(_AUTHORS, 'id, author, edits, paragraphs')}")
def h40_conversion_artifacts(spark: SparkSession, d: str) -> DataFrame:
    a = fixture(spark, _AUTHORS, "id int, author string, edits int, paragraphs int")
    return a.select("id", ((F.col("author") == "") | (F.col("edits") >= 10) & (F.col("edits") >= 5 * F.col("paragraphs"))).alias("artifact"))


@query(f"SELECT doc_id, idx, CASE WHEN regexp_matches(text, '(dismissed|observed|held|asked|wrote|said)') AND regexp_matches(text, '(19|20)[0-9]{{2}}') THEN 66 ELSE 42 END AS score FROM {_PARA} WHERE regexp_matches(text, '(dismissed|observed|held|asked|wrote|said)')")
def h15_events(spark: SparkSession, d: str) -> DataFrame:
    verb = F.col("text").rlike("(dismissed|observed|held|asked|wrote|said)")
    return _para(spark, d).where(verb).select("doc_id", "idx", F.when(F.col("text").rlike("(19|20)[0-9]{2}"), 66).otherwise(42).alias("score"))


@query("SELECT doc_id, field, arg_max(source, {'c': confidence, 's': source}) AS source, max(confidence) AS confidence FROM (SELECT doc_id, 'party' AS field, coalesce(role, 'none') AS source, CASE WHEN role IS NULL THEN 50 ELSE 80 END AS confidence FROM parties UNION ALL SELECT doc_id, 'ownership', 'links', 70 FROM ownership_links) GROUP BY doc_id, field")
def h24_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of several sources, the most confident per document and field."""
    p = table(spark, d, "parties").select("doc_id", F.lit("party").alias("field"), F.coalesce("role", F.lit("none")).alias("source"), F.when(F.col("role").isNull(), 50).otherwise(80).alias("confidence"))
    o = table(spark, d, "ownership_links").select("doc_id", F.lit("ownership").alias("field"), F.lit("links").alias("source"), F.lit(70).alias("confidence"))
    return p.unionByName(o).groupBy("doc_id", "field").agg(F.max_by("source", F.struct("confidence", "source")).alias("source"), F.max("confidence").alias("confidence"))


_ARTICLES = [(1, "Art. 1 One.\nArt. 2 Two\nmore.\nArt. 3 Three.", 2), (2, "Art. 1 Only.", 1), (3, "Art. 1 x", 9)]


@query(f"SELECT id, CASE WHEN strpos(x, 'Art. ' || n || ' ') > 0 THEN trim(split_part(substr(x, strpos(x, 'Art. ' || n || ' ')), chr(10) || 'Art. ', 1)) END AS article FROM {values(_ARTICLES, 'id, x, n')}")
def h35_article_slice(spark: SparkSession, d: str) -> DataFrame:
    """The text of one article up to the next heading."""
    a = fixture(spark, _ARTICLES, "id int, x string, n int").withColumn("at", F.locate("@", F.replace(F.col("x"), F.concat(F.lit("Art. "), F.col("n").cast("string"), F.lit(" ")), F.lit("@"))))
    return a.select("id", F.when(F.col("at") > 0, F.trim(F.split_part(F.expr("substring(x, at)"), F.lit("\nArt. "), F.lit(1)))).alias("article"))
