"""Named queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import text as T
from lexmill.plans.common import fixture, sql_clean, sql_fold, values
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


@query(f"""SELECT doc_id, idx, {sql_clean('text')} AS cleaned, CASE WHEN length({sql_clean('text')}) > 80 THEN left({sql_clean('text')}, 80) || '…' ELSE {sql_clean('text')} END AS snippet,
 regexp_replace({sql_clean('text')}, '^[ .,;:]+|[ .,;:]+$', '', 'g') AS role FROM (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL)""")
def t2_clean_text(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL").select("doc_id", "idx", "text").distinct()
    return b.select("doc_id", "idx", T.clean(F.col("text")).alias("cleaned"), T.snippet(F.col("text"), 80).alias("snippet"), T.role(F.col("text")).alias("role"))


@query(f"SELECT party_id, {sql_fold('name')} AS folded FROM (SELECT DISTINCT party_id, name FROM parties WHERE name IS NOT NULL)")
def t3_strip_diacritics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parties").where("name IS NOT NULL").select("party_id", "name").distinct().select("party_id", T.fold(F.col("name")).alias("folded"))


@query("SELECT DISTINCT doc_id, idx, translate(lower(text), 'ąćęłńóśźż', 'acelnoszz') AS folded FROM blocks WHERE lang IN ('pl', 'PL') AND text IS NOT NULL")
def t4_polish_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").where("lang IN ('pl', 'PL') AND text IS NOT NULL").select("doc_id", "idx", T.fold_polish(F.col("text")).alias("folded")).distinct()


@query(f"SELECT DISTINCT ref_id, trim(regexp_replace(lower({sql_fold('title')}), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM refs WHERE title IS NOT NULL")
def t5_title_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").where("title IS NOT NULL").select("ref_id", T.title_key(F.col("title")).alias("title_key")).distinct()


_DOI_SQL = r"regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:[ ]*)', '')"


@query(rf"SELECT DISTINCT ref_id, CASE WHEN regexp_matches({_DOI_SQL}, '^10\.[0-9]{{4,9}}/[^ ]+$') THEN {_DOI_SQL} END AS doi FROM refs WHERE doi IS NOT NULL")
def t6_doi_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").where("doi IS NOT NULL").select("ref_id", T.doi(F.col("doi")).alias("doi")).distinct()


_KEY_SQL = rf"trim(regexp_replace(regexp_replace(lower({sql_fold('text')}), '[^\p{{L}}\p{{N}} ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {_KEY_SQL} AS k FROM documents WHERE text IS NOT NULL) GROUP BY k")
def w10_dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Documents equal but for case, marks and punctuation, the first kept; hashed so that no text is shuffled."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(T.fold(F.col("text"))), r"[^\p{L}\p{N} ]", " "), " +", " "))
    return docs.select("doc_id", F.sha2(key, 256).alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("k")


_FORMS = r"(?:Ltd|Inc|Corp|plc|LLC|GmbH|SARL|SAS|Ltée)"


@query(rf"SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ {_FORMS}')) AS name FROM documents WHERE text IS NOT NULL) GROUP BY name")
def t11_company_names(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Z][a-z]+ {_FORMS}"), 0)).alias("name"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("docs"))


@query(r"""SELECT doc_id, count(*) AS amounts, CAST(sum(a) AS DOUBLE) AS total, CAST(max(a) AS DOUBLE) AS largest FROM (
 SELECT doc_id, CAST(replace(unnest(regexp_extract_all(text, '[$£€] ?([0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})', 1)), ',', '') AS DECIMAL(18,2)) AS a FROM documents WHERE text IS NOT NULL) GROUP BY doc_id""")
def t12_money(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(T.money(F.col("text"))).alias("a"))
    return a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("amounts"), F.sum("a").cast("double").alias("total"), F.max("a").cast("double").alias("largest"))


_ANCHORS = r"^([a-z§])([0-9]+)(?:[.#]([0-9]+))?$"


@query(rf"SELECT kind, count(*) AS n, max(first) AS most_first, max(second) AS most_second FROM (SELECT DISTINCT doc_id, idx, regexp_extract(anchor, '{_ANCHORS}', 1) AS kind, TRY_CAST(regexp_extract(anchor, '{_ANCHORS}', 2) AS INTEGER) AS first, TRY_CAST(nullif(regexp_extract(anchor, '{_ANCHORS}', 3), '') AS INTEGER) AS second FROM blocks WHERE regexp_matches(anchor, '{_ANCHORS}')) GROUP BY kind")
def t18_anchor_parts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where(F.col("anchor").rlike(_ANCHORS))
    part = lambda k: F.regexp_extract("anchor", _ANCHORS, k)
    rows = b.select("doc_id", "idx", part(1).alias("kind"), part(2).try_cast("int").alias("first"), F.nullif(part(3), F.lit("")).try_cast("int").alias("second")).distinct()
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("most_first"), F.max("second").alias("most_second"))


_HTML = [(1, "<p>A &amp; B</p><script>var x=1;</script><style>p{}</style>"), (2, "<h1>Title</h1>\n<ul><li>one</li><li>two &lt; 3</li></ul>"), (3, "plain"), (4, ""), (5, "a&nbsp;b &quot;c&quot; it&#39;s")]


@query(rf"""SELECT id, {sql_clean("replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')")} AS text FROM {values(_HTML, 'id, html')}""")
def t19_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _HTML, "id int, html string").select("id", T.strip_html(F.col("html")).alias("text"))


@query(r"""SELECT DISTINCT ref_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS as_xml,
 replace(replace(replace(replace(title, '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n') AS as_ics, replace(replace(title, '|', '\|'), chr(10), ' ') AS as_md,
 replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(title, '\', chr(1)), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{', '\{'), '}', '\}'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}') AS as_latex
 FROM (SELECT ref_id, title FROM refs WHERE title IS NOT NULL UNION ALL SELECT -1, 'a\b {c} $~^ 5% #_&|<"x">; y, z')""")
def t20_escapes(spark: SparkSession, d: str) -> DataFrame:
    """All titles, and one that holds every character that is escaped."""
    rows = table(spark, d, "refs").where("title IS NOT NULL").select("ref_id", "title")
    return _escaped(rows.unionByName(fixture(spark, [(-1, 'a\\b {c} $~^ 5% #_&|<"x">; y, z')], "ref_id long, title string")))


def _escaped(r: DataFrame) -> DataFrame:
    return r.select("ref_id", *[T.escape(F.col("title"), s).alias(f"as_{s}") for s in ("xml", "ics", "md", "latex")]).distinct()


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_partkey AS n FROM part UNION SELECT * FROM (VALUES (0), (18278), (18279), (475255), (9007199254740993)) v(n)), w AS (SELECT n, n AS rest, '' AS letters FROM n UNION ALL SELECT n, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INTEGER)) || letters FROM w WHERE rest > 0)
 SELECT n, CASE WHEN n > 0 THEN letters END AS letters, CASE WHEN n > 0 THEN n END AS back FROM w WHERE rest <= 0""")
def t21_column_letters(spark: SparkSession, d: str) -> DataFrame:
    """All part keys as spreadsheet columns and back, and some greater ones; null for a key below 1, which has no letters."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("n")).unionByName(fixture(spark, [(0,), (18278,), (18279,), (475255,), (9007199254740993,)], "n long")).distinct()
    p = p.withColumn("letters", T.column_letters(F.col("n")))
    return p.withColumn("back", T.column_index(F.col("letters")).cast("long"))


@query(f"SELECT DISTINCT party_id, regexp_replace(regexp_replace(lower({sql_fold('name')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(name, '[^\\p{{L}}\\p{{N}}._-]+', '_', 'g') AS filename FROM parties WHERE name IS NOT NULL")
def t22_slug_and_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parties").where("name IS NOT NULL").select("party_id", T.slug(F.col("name")).alias("slug"), T.safe_filename(F.col("name")).alias("filename")).distinct()


# Typographic rules, in the order they run.
TYPOGRAPHY = ((r" {2,}", " "), (r" +([,.])", r"$1"), (r"\.\.\.", "…"), (r"([0-9])-([0-9])", r"$1–$2"), (r"(^|[^A-Za-z])n[oO] ?([0-9])", r"$1n° $2"), (r" ([!?;:])", "\u202f$1"))


def _typography_sql(x: str) -> str:
    for a, b in TYPOGRAPHY:
        x = f"regexp_replace({x}, '{a}', '{b.replace('$', chr(92))}', 'g')"
    return x


@query(f"SELECT DISTINCT doc_id, idx, {_typography_sql('text')} AS fixed, {_typography_sql('text')} <> text AS edited FROM blocks WHERE block_type = 'paragraph' AND text IS NOT NULL AND starts_with(lower(lang), 'fr')")
def t24_typography(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    for a, b in TYPOGRAPHY:
        c = F.regexp_replace(c, a, b)
    b = table(spark, d, "blocks").where("block_type = 'paragraph' AND text IS NOT NULL AND startswith(lower(lang), 'fr')")
    return b.select("doc_id", "idx", c.alias("fixed"), (c != F.col("text")).alias("edited")).distinct()


_CASES = [(1, "Lessee", "tenant"), (2, "lessee", "tenant"), (3, "LESSEE", "tenant"), (4, "Édit", "acte"), (5, "", "tenant"), (6, "9th", "tenth")]


@query(f"SELECT id, CASE WHEN upper(left(a, 1)) = left(a, 1) AND lower(left(a, 1)) <> left(a, 1) THEN upper(left(b, 1)) || substr(b, 2) ELSE b END AS word FROM {values(_CASES, 'id, a, b')}")
def t26_keep_case(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _CASES, "id int, a string, b string").select("id", T.keep_case(F.col("a"), F.col("b")).alias("word"))


_SEGMENTS = [(1, 1, "regular", "The "), (1, 2, "del", "seller "), (1, 3, "ins", "buyer "), (1, 4, "regular", "pays."), (2, 1, "ins", "New."), (3, 1, "del", "Gone."), (4, 1, "regular", "Same.")]


@query(f"SELECT para, coalesce(string_agg(CASE WHEN kind <> 'del' THEN part END, '' ORDER BY seg), '') AS accepted, coalesce(string_agg(CASE WHEN kind <> 'ins' THEN part END, '' ORDER BY seg), '') AS rejected FROM {values(_SEGMENTS, 'para, seg, kind, part')} GROUP BY para")
def t28_accept_reject(spark: SparkSession, d: str) -> DataFrame:
    s = fixture(spark, _SEGMENTS, "para int, seg int, kind string, part string").groupBy("para").agg(F.array_sort(F.collect_list(F.struct("seg", "kind", "part"))).alias("s"))
    view = lambda no: F.array_join(F.transform(F.filter("s", lambda x: x["kind"] != no), lambda x: x["part"]), "")
    return s.select("para", view("del").alias("accepted"), view("ins").alias("rejected"))


@query(r"""SELECT doc_id, idx, phrase FROM (SELECT DISTINCT doc_id, idx, unnest(regexp_extract_all(text, '[«“]([^«»“”]+)[»”]', 1)) AS phrase FROM blocks WHERE text IS NOT NULL) WHERE len(string_split(trim(phrase), ' ')) >= 3""")
def t30_quoted_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Quoted phrases of three words or more that a translation has to keep."""
    b = table(spark, d, "blocks").where("text IS NOT NULL").select("doc_id", "idx", F.explode(F.regexp_extract_all("text", F.lit("[«“]([^«»“”]+)[»”]"), 1)).alias("phrase")).distinct()
    return b.where(F.size(F.split(F.trim("phrase"), " ")) >= 3)


@query("""SELECT d.doc_id, CASE WHEN n_chars < 150 THEN 'short' WHEN t / n_chars < 0.3 THEN 'block' WHEN t / n_chars < 0.6 THEN 'warn' ELSE 'ok' END AS band FROM documents d
 JOIN (SELECT doc_id, sum(n)::DOUBLE AS t FROM (SELECT doc_id, idx, max(length(text)) AS n FROM blocks WHERE text IS NOT NULL GROUP BY doc_id, idx) GROUP BY doc_id) b USING (doc_id) WHERE n_chars > 0""")
def t31_length_ratio_bands(spark: SparkSession, d: str) -> DataFrame:
    """Characters of a document's blocks against the document's own: what normalising dropped."""
    b = table(spark, d, "blocks").where("text IS NOT NULL").groupBy("doc_id", "idx").agg(F.max(F.length("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").cast("double").alias("t"))
    return table(spark, d, "documents").where("n_chars > 0").join(b, "doc_id").select("doc_id", T.ratio_band(F.col("n_chars"), F.col("t")).alias("band"))


def _bag(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_COUNT = lambda bag: f"len(list_filter(string_split_regex(lower({sql_fold('text')}), '[^a-z]+'), lambda x: x IN {_bag(bag)}))"


@query(f"SELECT guess, label, count(*) AS docs FROM (SELECT CASE WHEN en >= 3 AND en > fr THEN 'en' WHEN fr >= 3 AND fr > en THEN 'fr' ELSE 'und' END AS guess, label FROM (SELECT lang AS label, {_COUNT(T.EN_WORDS)} AS en, {_COUNT(T.FR_WORDS)} AS fr FROM documents WHERE text IS NOT NULL)) GROUP BY guess, label")
def t32_language_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("lang").alias("label"), T.language(F.col("text")).alias("guess"))
    return docs.groupBy("guess", "label").agg(F.count(F.lit(1)).alias("docs"))


# Wording that a lexicon rules out, with its severity and language.
LEXICON_RULES = (("shall_be_deemed", "is deemed", 1, "en"), ("and_or", "and/or", 2, "en"), ("best_efforts", "best efforts", 1, "fr"), ("rebus", "rebus sic stantibus", 2, "en"), ("cas_fortuit", "Cas fortuit", 1, "en"))


@query("SELECT rule, severity, count(*) AS hits FROM (SELECT DISTINCT b.doc_id, b.idx, r.rule, r.severity FROM blocks b JOIN (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{e}')" for a, b, c, e in LEXICON_RULES) + ") r(rule, words, severity, lang) ON starts_with(lower(b.lang), r.lang) AND contains(b.text, r.words)) GROUP BY rule, severity")
def t35_lexicon_compliance(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("text IS NOT NULL")
    hits = F.array(*[F.when(F.lower("lang").startswith(lang) & F.col("text").contains(words), F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"))) for rule, words, sev, lang in LEXICON_RULES])
    return b.select("doc_id", "idx", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).distinct().groupBy("x.rule", "x.severity").agg(F.count(F.lit(1)).alias("hits"))


@query("""SELECT DISTINCT ref_id, concat_ws(', ', array_to_string(authors[1:3], ' & ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END, '« ' || title || ' »', container, CAST(year AS VARCHAR)) AS citation FROM refs WHERE title IS NOT NULL AND len(authors) > 0""")
def t36_citation(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").where("title IS NOT NULL AND size(authors) > 0")
    who = F.concat(F.array_join(F.slice("authors", 1, 3), " & "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
    return r.select("ref_id", F.concat_ws(", ", who, F.concat(F.lit("« "), "title", F.lit(" »")), "container", F.col("year").cast("string")).alias("citation")).distinct()


_APPEALS = [(1, "19-12.345"), (2, "19 12345"), (3, "n° 1912345"), (4, "12.345"), (5, None)]


@query(f"SELECT id, CASE WHEN length(digits) = 7 THEN substr(digits, 1, 2) || '-' || substr(digits, 3, 2) || '.' || substr(digits, 5) ELSE raw END AS number FROM (SELECT id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM {values(_APPEALS, 'id, raw')})")
def t37_appeal_number(spark: SparkSession, d: str) -> DataFrame:
    a = fixture(spark, _APPEALS, "id int, raw string").withColumn("digits", F.regexp_replace("raw", "[^0-9]", ""))
    return a.select("id", F.when(F.length("digits") == 7, F.concat(F.substring("digits", 1, 2), F.lit("-"), F.substring("digits", 3, 2), F.lit("."), F.substring("digits", 5, 3))).otherwise(F.col("raw")).alias("number"))


#: Characters of items whose runs are broadcast; more are joined by shuffle.
ITEM_CHARS = 20_000_000
_GRAMS_SQL = "list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))"


@query(f"""WITH e AS (SELECT DISTINCT item_id, unnest({_GRAMS_SQL}) AS g FROM (SELECT item_id, list_filter(string_split_regex(lower({sql_fold('passage')}), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM eval_items)),
 d AS (SELECT DISTINCT doc_id, unnest({_GRAMS_SQL}) AS g FROM (SELECT doc_id, list_filter(string_split_regex(lower({sql_fold('text')}), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL))
 SELECT doc_id, item_id, count(*) AS shared FROM d JOIN e USING (g) GROUP BY doc_id, item_id""")
def t38_ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared runs of eight words, by hash; the items are broadcast behind a check of their size, else both sides are shuffled by hash."""
    words = lambda c: F.filter(F.split(F.lower(T.fold(F.col(c))), "[^a-z0-9]+"), lambda x: x != "")
    gram = lambda k: F.xxhash64(*[F.get("w", k + F.lit(j)) for j in range(8)])
    grams = F.when(F.size("w") >= 8, F.transform(F.sequence(F.lit(0), F.size("w") - 8), gram)).otherwise(F.array().cast("array<bigint>"))
    items = table(spark, d, "eval_items")
    e = items.select("item_id", words("passage").alias("w")).select("item_id", F.explode(grams).alias("g")).distinct()
    small = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(grams)).alias("g"))
    return t.join(F.broadcast(e) if small <= ITEM_CHARS else e, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


# Names whose near misses are looked for.
KNOWN_NAMES = ("buyer", "seller", "respondent", "claimant", "guarantor")
_NEAR = [(1, "buyer"), (2, "buyre"), (3, "seler"), (4, "respondant"), (5, "claimants"), (6, "tenant"), (7, "Guarantr")]


@query(f"SELECT id, word, known, CAST(levenshtein(lower(word), known) AS INTEGER) AS distance FROM {values(_NEAR, 'id, word')} JOIN (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in KNOWN_NAMES)}) k(known) ON levenshtein(lower(word), known) BETWEEN 1 AND 2")
def t39_near_misses(spark: SparkSession, d: str) -> DataFrame:
    w = fixture(spark, _NEAR, "id int, word string")
    hits = F.transform(F.array(*[F.lit(k) for k in KNOWN_NAMES]), lambda k: F.struct(k.alias("known"), F.levenshtein(F.lower("word"), k).alias("distance")))
    return w.select("id", "word", F.explode(F.filter(hits, lambda x: x["distance"].between(1, 2))).alias("x")).select("id", "word", "x.*")


@query(f"""SELECT DISTINCT party_id, mode, variant FROM (SELECT party_id, name, unnest(['upper', 'plain', 'reversed', 'initial']) AS mode, unnest([upper(name), {sql_fold('name')}, split_part(name, ' ', 2) || ', ' || split_part(name, ' ', 1), left(name, 1) || '. ' || split_part(name, ' ', 2)]) AS variant
 FROM parties WHERE type = 'person' AND regexp_matches(name, '^[A-Z][a-z]+ [A-Z][a-z]+$')) WHERE variant <> name""")
def t41_name_variants(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parties").where("type = 'person'").where(F.col("name").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"))
    first, last = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2))
    forms = {"upper": F.upper("name"), "plain": T.fold(F.col("name")), "reversed": F.concat(last, F.lit(", "), first), "initial": F.concat(F.substring("name", 1, 1), F.lit(". "), last)}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("variant")) for m, v in forms.items()]))
    return p.select("party_id", "name", each.alias("x")).where("x.variant <> name").select("party_id", "x.mode", "x.variant").distinct()


@query(r"SELECT DISTINCT party_id, upper(regexp_replace(trim(reg_no), '[ ./_-]+', '', 'g')) AS reg_no FROM parties WHERE reg_no IS NOT NULL")
def t42_identifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parties").where("reg_no IS NOT NULL").select("party_id", T.identifier(F.col("reg_no")).alias("reg_no")).distinct()


_REDACT = r"[$£€] ?[0-9][0-9,.]*|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[A-Z]\. [A-Z]\. [A-Z][a-z]+"


@query(rf"SELECT DISTINCT doc_id, idx, regexp_replace(text, '{_REDACT}', '[redacted]', 'g') AS redacted FROM blocks WHERE regexp_matches(text, '{_REDACT}')")
def t43_redact(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where(F.col("text").rlike(_REDACT))
    return b.select("doc_id", "idx", F.regexp_replace("text", _REDACT, "[redacted]").alias("redacted")).distinct()


_RANGES = [(1, "1-3,5"), (2, "7"), (3, "2-2, 9 - 10"), (4, "x,4"), (5, "5-3"), (6, "")]


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter([CASE WHEN regexp_matches(p, '^[0-9]+$') THEN CAST(p AS INTEGER) END FOR p IN parts], lambda x: x IS NOT NULL),
 flatten([CASE WHEN regexp_matches(p, '^[0-9]+-[0-9]+$') THEN range(CAST(split_part(p, '-', 1) AS INTEGER), CAST(split_part(p, '-', 2) AS INTEGER) + 1) ELSE [] END FOR p IN parts])))), ',') AS pages FROM (SELECT id, string_split(replace(spec, ' ', ''), ',') AS parts FROM {values(_RANGES, 'id, spec')})""")
def s17_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _RANGES, "id int, spec string").select("id", F.array_join(T.page_ranges(F.col("spec")), ",").alias("pages"))


@query("SELECT doc_id, idx, CAST((length(text) - length(replace(text, '«', ''))) - (length(text) - length(replace(text, '»', ''))) AS INTEGER) AS balance FROM (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE contains(text, '«') OR contains(text, '»'))")
def a23_quote_balance(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where(F.col("text").contains("«") | F.col("text").contains("»")).select("doc_id", "idx", "text").distinct()
    return b.select("doc_id", "idx", T.quote_balance(F.col("text")).alias("balance"))


