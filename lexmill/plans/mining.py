"""Named queries of scanners, harvesters and line classifiers: rule tables over documents and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import text as T
from lexmill.operators import rules as R
from lexmill.plans.common import fixture, sql_clean, sql_fold, values
from lexmill.session import cut_lineage, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _esc(p: str) -> str:
    return p.replace("'", "''")


# What the scanner looks for in running text.
SCAN_RULES = (
    R.Rule("registered_number", "identifier", 1, r"[A-Z]-?[0-9]{2,}/[0-9]{2,}", "/"),
    R.Rule("ipv4", "network", 1, r"(^|[^0-9.])([0-9]{1,3}[.]){3}[0-9]{1,3}([^0-9.]|$)", "."),
    R.Rule("email", "contact", 2, r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}", "@"),
    R.Rule("base64_run", "obfuscation", 2, r"(^|[^A-Za-z0-9+/])[A-Za-z0-9+/]{60,}"),
    R.Rule("hex_dump", "obfuscation", 1, r"^[0-9a-f]{8}( +[0-9a-f]{2}){8,}"),
    R.Rule("zero_width", "obfuscation", 3, r"[\x{200B}\x{2060}\x{FEFF}]"),
    R.Rule("boilerplate", "noise", 0, r"(do not copy|no text layer|continued overleaf|CONFIDENTIAL)"),
    R.Rule("amount", "money", 0, r"[$£€] ?[0-9]{1,3}(,[0-9]{3})+"),
)
_LINES_SQL = "(SELECT doc_id, source, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0))"
_HITS_SQL = " UNION ALL ".join(f"SELECT doc_id, source, line_no, line, '{r.name}' AS rule, '{r.category}' AS category, {r.severity} AS severity FROM lines WHERE regexp_matches(line, '{_esc(r.pattern)}')" for r in SCAN_RULES)
_FINDINGS_SQL = f"WITH lines AS {_LINES_SQL}, hits AS ({_HITS_SQL}), f AS (SELECT *, left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || CAST(line_no AS VARCHAR) || chr(0) || rule), 16) AS fingerprint FROM hits WHERE NOT regexp_matches(line, '(noqa|nosec|scan:ignore)'))"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    rows = docs.where(F.length("text") > 0).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    hits = R.match_rules(rows.where(~R.suppressed(F.col("line"))), "line", SCAN_RULES)
    return R.with_fingerprint(hits, "doc_id", "line_no", "rule")


@query(_FINDINGS_SQL + " SELECT doc_id, line_no, rule, category, severity, fingerprint FROM f")
def h44_findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "rule", "category", "severity", "fingerprint")


@query(_FINDINGS_SQL + ", b AS (SELECT fingerprint FROM f WHERE severity = 0) SELECT source, count(*) FILTER (severity = 0) AS low, count(*) FILTER (severity = 1) AS medium, count(*) FILTER (severity = 2) AS high, count(*) FILTER (severity = 3) AS critical, count(*) AS total, CASE WHEN count(*) FILTER (severity = 3) > 0 THEN 'FAIL' WHEN count(*) FILTER (severity = 2) > 0 OR count(*) FILTER (severity = 1) >= 5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM b) GROUP BY source")
def a7_audit_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Findings less the accepted baseline, counted by severity, with each source's verdict."""
    f = cut_lineage(_findings(spark, d).select("source", "severity", "fingerprint"))
    counts = R.severity_counts(R.less_baseline(f, f.where("severity = 0")), "source")
    return counts.withColumn("verdict", R.verdict(F.col("critical"), F.col("high"), F.col("medium")))


@query(_FINDINGS_SQL + " SELECT doc_id, string_agg(rule || ':' || line_no, ',' ORDER BY severity DESC, line_no, rule) AS report FROM f WHERE severity >= 2 GROUP BY doc_id")
def k4_grouped_report(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d).where("severity >= 2")
    item = F.struct((-F.col("severity")).alias("s"), "line_no", "rule")
    return f.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(":", x["rule"], x["line_no"].cast("string"))), ",").alias("report"))


# Sentences of English blocks by a plain splitter: a mark, spaces, a capital letter; guards keep abbreviations whole.
GUARDS = ("Inc", "Corp", "Ltd", "No", "cl", "art", "Sched", "Mr", "Ms", "Dr", "Prof", "Capt", "vol", "pp", "para", "Esq", "Cf", "approx", "excl")
_GUARD = "(" + "|".join(GUARDS) + ")"


def _split(c):
    c = F.regexp_replace(c, rf"(^|[^A-Za-z]){_GUARD}[.]", "$1$2\u0001")
    return F.transform(F.split(F.regexp_replace(c, r"([.!?]) +([A-Z“\"])", "$1\u0002$2"), "\u0002"), lambda s: F.replace(s, F.lit("\u0001"), F.lit(".")))


_SPLIT_SQL = rf"string_split(regexp_replace(regexp_replace(text, '(^|[^A-Za-z]){_GUARD}[.]', '\1\2' || chr(1), 'g'), '([.!?]) +([A-Z“\"])', '\1' || chr(2) || '\2', 'g'), chr(2))"
#: Labels of language are missing or wrong in part, so every text is looked at.
_TEXTS = "block_type IN ('paragraph', 'list_item') AND text IS NOT NULL"
_BLOCKS_SQL = f"(SELECT DISTINCT doc_id, idx, text FROM blocks WHERE {_TEXTS})"
_SENT_SQL = f"(SELECT doc_id, idx, generate_subscripts(s, 1) AS pos, replace(unnest(s), chr(1), '.') AS sentence FROM (SELECT doc_id, idx, {_SPLIT_SQL} AS s FROM {_BLOCKS_SQL}))"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where(_TEXTS).select("doc_id", "idx", "text").distinct()
    return b.select("doc_id", "idx", F.posexplode(_split(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos") + 1)


@query(f"SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, sentence FROM {_SENT_SQL}")
def t1_plain_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


# Frames in order, with the field each fills and its score in hundredths.
FRAMES = (
    R.Frame("negative_duty", "obligation", 76, r"(undertakes not to|shall not|may not)"), R.Frame("positive_duty", "obligation", 72, r"(agrees to|shall|must keep|must deliver)"),
    R.Frame("condition", "condition", 62, r"(^|[^a-z])(if|unless|provided that|where) "), R.Frame("subject_to", "condition", 56, r"^(Subject to|Save as provided)"),
    R.Frame("discretion", "decision", 58, r"may (terminate|assign)"), R.Frame("remedy", "remedy", 58, r"(indemnify|reimburse|cure a material breach)"),
    R.Frame("notice", "communication", 62, r"(written notice|registered mail)"), R.Frame("deadline", "deadline", 66, r"(no later than|before [A-Z]|within [0-9]+ days|until the date)"),
    R.Frame("ownership", "ownership", 70, r"[0-9.]+% of the shares"), R.Frame("payment", "transfer", 66, r"(payable|Fees are capped|Interest accrues|costs of)"),
    R.Frame("authority", "authority", 68, r" v[.] [A-Z]"), R.Frame("statute", "authority", 56, r"(of the Act|See Reg[.])"),
)
#: The frame whose candidates stay hints whatever their score, as mentions found by capitals do.
HINTS_ALONE = "deadline"
#: A document with fewer candidates is sparse.
SPARSE = 5
# Wording that weakens or strengthens a candidate.
ANTI_SIGNALS = ("hesitated", "whether", "pleaded but not pressed")
SIGNALS = {"dated": (12, r"(19|20)[0-9]{2}"), "amount": (8, r"[$£€] ?[0-9]"), "party_role": (10, r"the (Buyer|Seller|Lessee|Licensor|Guarantor|Distributor|Operator|Carrier)")}
_CAND_SQL = f"(SELECT * FROM ({' UNION ALL '.join(f'''SELECT doc_id, idx, pos, sentence, {k} AS ordinal, '{f.name}' AS frame, '{f.field}' AS field, {f.base} AS base FROM s WHERE regexp_matches(sentence, '{_esc(f.pattern)}')''' for k, f in enumerate(FRAMES))}))"
_SCORE_SQL = "least(greatest(base + " + " + ".join(f"{w} * CAST(regexp_matches(sentence, '{p}') AS INTEGER)" for w, p in SIGNALS.values()) + " - least(28, 7 * (" + " + ".join(f"CAST(contains(sentence, '{w}') AS INTEGER)" for w in ANTI_SIGNALS) + ")), 0), 100)"
_SCORED_SQL = f"WITH s AS {_SENT_SQL}, c AS (SELECT *, {_SCORE_SQL} AS score FROM {_CAND_SQL})"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    c = R.match_frames(_sentences(spark, d), "sentence", FRAMES)
    boost = sum((w * F.col("sentence").rlike(p).cast("int") for w, p in SIGNALS.values()), F.lit(0))
    anti = sum((F.col("sentence").contains(w).cast("int") for w in ANTI_SIGNALS), F.lit(0))
    return c.withColumn("score", F.least(F.greatest(F.col("base") + boost - F.least(F.lit(28), 7 * anti), F.lit(0)), F.lit(100)))


@query(_SCORED_SQL + " SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, frame, field, score FROM c")
def h5_frame_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("doc_id", "idx", "pos", "frame", "field", "score")


@query(_SCORED_SQL + ", k AS (SELECT field, count(DISTINCT doc_id) > 1 AS corroborated FROM c GROUP BY field), sp AS (SELECT doc_id, count(*) < 5 AS sparse FROM c GROUP BY doc_id) SELECT field, decision, count(*) AS n FROM (SELECT field, CASE WHEN score >= 85 AND frame <> 'deadline' THEN 'promote' WHEN score >= 65 AND corroborated AND frame <> 'deadline' THEN 'promote' WHEN score >= 45 THEN 'hint' WHEN sparse AND score >= 35 THEN 'hint' ELSE 'suppress' END AS decision FROM c JOIN k USING (field) JOIN sp USING (doc_id)) GROUP BY field, decision")
def h23_tier_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by score, corroboration and how sparse the document is; a frame of hints alone never promotes."""
    return _decisions(_candidates(spark, d))


def _decisions(candidates: DataFrame) -> DataFrame:
    c = cut_lineage(candidates.select("doc_id", "field", "frame", "score"))
    sparse = c.groupBy("doc_id").agg((F.count(F.lit(1)) < SPARSE).alias("sparse"))
    k = c.groupBy("field").agg((F.count_distinct("doc_id") > 1).alias("corroborated"))
    decided = c.join(F.broadcast(k), "field").join(sparse, "doc_id").select("field", R.tier(F.col("score"), F.col("corroborated"), F.col("frame") == HINTS_ALONE, F.col("sparse")).alias("decision"))
    return decided.groupBy("field", "decision").agg(F.count(F.lit(1)).alias("n"))


@query(_SCORED_SQL + " SELECT doc_id, field, arg_max(frame, {'s': score, 'o': -(idx * 100000 + pos * 100 + ordinal)}) AS frame, max(score) AS score, count(*) AS merged FROM c GROUP BY doc_id, field")
def u5_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Per document and field the highest score, the first on ties."""
    return _best(_candidates(spark, d))


def _best(candidates: DataFrame) -> DataFrame:
    c = candidates.withColumn("o", F.col("idx") * 100000 + F.col("pos") * 100 + F.col("ordinal"))
    return c.groupBy("doc_id", "field").agg(F.max_by("frame", F.struct("score", -F.col("o"))).alias("frame"), F.max("score").alias("score"), F.count(F.lit(1)).alias("merged"))


_MERGE = [("a", 1, 70, "x"), ("a", 2, 70, "y"), ("a", 3, 60, "x"), ("b", 4, 10, "z"), ("b", 5, 90, "q")]


@query(f"""WITH m AS {values(_MERGE, 'k, ordinal, score, signal')} SELECT k, (SELECT ordinal FROM m x WHERE x.k = m.k ORDER BY score DESC, ordinal LIMIT 1) AS kept, max(score) AS score, (SELECT string_agg(signal, ',' ORDER BY o) FROM (SELECT signal, min(ordinal) AS o FROM m y WHERE y.k = m.k GROUP BY signal)) AS signals FROM m GROUP BY k""")
def u5_merge_signals(spark: SparkSession, d: str) -> DataFrame:
    c = fixture(spark, _MERGE, "k string, ordinal int, score int, signal string").withColumn("signals", F.array("signal"))
    return R.best_candidates(c, ["k"], "score", "ordinal", "signals").select("k", F.col("ordinal").alias("kept"), "score", F.array_join("merged", ",").alias("signals"))


# Line classes for final provisions in Polish and English.
EVENTS = {"entry_into_force": r"(wchodzi w życie|enters into force|enter into force)", "repeal": r"(traci moc|is repealed)", "deadline": r"(najpóźniej do dnia|no later than|within [0-9]+ days)", "term": r"(w terminie [0-9]+|for a period of [0-9]+|przez [0-9]+ miesięcy)", "start": r"(^Od dnia|^As of|^À compter du)"}
ACTORS = {"court": r"(Sąd|sąd|Court|Tribunal|tribunal)", "regulator": r"(organ nadzoru|Licensing Board|autorité)", "arbitrator": r"(arbiter|arbitrator|arbitre)"}


@query(f"SELECT doc_id, idx, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(text, '{p}') THEN '{e}' END''' for e, p in EVENTS.items())}], lambda x: x IS NOT NULL), ',') AS events, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(text, '{p}') THEN '{a}' END''' for a, p in ACTORS.items())}], lambda x: x IS NOT NULL), ',') AS actors, regexp_extract(text, '(?:art|Art)[.] ([0-9]+)', 1) AS article FROM (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE block_type = 'paragraph' AND text IS NOT NULL) WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in EVENTS.values()))
def h31_provision_lines(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("block_type = 'paragraph' AND text IS NOT NULL").select("doc_id", "idx", "text").distinct()
    names = lambda t: F.array_join(F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in t.items()]), lambda x: x.isNotNull()), ",")
    out = b.select("doc_id", "idx", names(EVENTS).alias("events"), names(ACTORS).alias("actors"), F.regexp_extract("text", r"(?:art|Art)[.] ([0-9]+)", 1).alias("article"))
    return out.where("events <> ''")


# Relations between acts or clauses.
RELATIONS = {"replaces": "was replaced", "prevents": "prevents the", "subject": "Subject to", "exception": "relies on the exception", "upholds": "was upheld", "dismisses": "dismissed the application"}


@query("SELECT relation, count(*) AS blocks FROM (SELECT DISTINCT doc_id, idx, relation FROM blocks, (VALUES " + ", ".join(f"('{r}', '{w}')" for r, w in RELATIONS.items()) + ") t(relation, words) WHERE contains(text, words)) GROUP BY relation")
def h32_relations(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("text IS NOT NULL")
    hit = F.filter(F.array(*[F.when(F.col("text").contains(w), F.lit(r)) for r, w in RELATIONS.items()]), lambda x: x.isNotNull())
    return b.select("doc_id", "idx", F.explode(hit).alias("relation")).distinct().groupBy("relation").agg(F.count(F.lit(1)).alias("blocks"))


_IDS = [(1, "see 32016R0679 on data"), (2, "Dz.U. 2020 poz. 1740"), (3, "http://data.europa.eu/eli/reg/2016/679/oj"), (4, "the GDPR applies"), (5, "nothing here"), (6, "act 12/2004 and 32019L0790")]
_CELEX, _ACT, _ELI = r"3[0-9]{4}[RLD][0-9]{4}", r"poz[.] [0-9]+|[0-9]+/[0-9]{4}", r"eli/[a-z]+/[0-9]{4}/[0-9]+"


@query(f"SELECT id, CASE WHEN regexp_matches(x, '{_CELEX}') THEN regexp_extract(x, '{_CELEX}') WHEN regexp_matches(x, '{_ELI}') THEN regexp_extract(x, '{_ELI}') WHEN contains(lower(x), 'gdpr') THEN 'gdpr' WHEN regexp_matches(x, '{_ACT}') THEN regexp_extract(x, '{_ACT}') END AS identifier, CASE WHEN regexp_matches(x, '{_CELEX}') THEN 95 WHEN regexp_matches(x, '{_ELI}') THEN 90 WHEN contains(lower(x), 'gdpr') THEN 80 WHEN regexp_matches(x, '{_ACT}') THEN 70 ELSE 0 END AS confidence FROM {values(_IDS, 'id, x')}")
def h33_identifier_cascade(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    found = lambda p: F.regexp_extract(x, p, 0)
    ident = F.when(x.rlike(_CELEX), found(_CELEX)).when(x.rlike(_ELI), found(_ELI)).when(F.lower(x).contains("gdpr"), "gdpr").when(x.rlike(_ACT), found(_ACT))
    sure = F.when(x.rlike(_CELEX), 95).when(x.rlike(_ELI), 90).when(F.lower(x).contains("gdpr"), 80).when(x.rlike(_ACT), 70).otherwise(0)
    return fixture(spark, _IDS, "id int, x string").select("id", ident.alias("identifier"), sure.alias("confidence"))


# House-style rules.
STYLE = (R.Rule("double_space", "style", 0, r"[^ ]  +[^ ]"), R.Rule("space_before_comma", "style", 0, r" ,"), R.Rule("three_stops", "style", 0, r"[.]{3}"), R.Rule("and_or", "style", 1, r"and/or"), R.Rule("missing_stop", "style", 0, r"[a-z]$"))


@query()
def h36_house_style(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("block_type = 'paragraph' AND text IS NOT NULL").select("doc_id", "idx", "text").distinct()
    return R.match_rules(b, "text", STYLE).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("hits"))


SQL["h36_house_style"] = "WITH b AS (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE block_type = 'paragraph' AND text IS NOT NULL) SELECT rule, severity, count(*) AS hits FROM (" + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, {r.severity} AS severity FROM b WHERE regexp_matches(text, '{r.pattern}')" for r in STYLE) + ") GROUP BY rule, severity"


_FRONT = [(1, "---\nname: my-skill\ndescription: Does things\n---\nbody"), (2, "no front"), (3, "---\nname: Bad Name\ndescription: x\n---\n"), (4, "---\nname: ok\n---\n"), (5, "---\nname: ok\ndescription: y\ncolour: red\n---\n")]


@query(f"SELECT id, CASE WHEN NOT starts_with(x, '---' || chr(10)) THEN 'no frontmatter' WHEN regexp_extract(x, '(?m)^name: *(.+)$', 1) = '' THEN 'no name' WHEN regexp_extract(x, '(?m)^description: *(.+)$', 1) = '' THEN 'no description' WHEN NOT regexp_matches(regexp_extract(x, '(?m)^name: *(.+)$', 1), '^[a-z0-9-]+$') THEN 'bad name' WHEN regexp_matches(split_part(x, '---' || chr(10), 2), '(?m)^(colour|other):') THEN 'unknown key' ELSE 'ok' END AS finding FROM {values(_FRONT, 'id, x')}")
def h43_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    field = lambda k: F.regexp_extract(x, rf"(?m)^{k}: *(.+)$", 1)
    keys = F.regexp_extract_all(F.split_part(x, F.lit("---\n"), F.lit(2)), F.lit(r"(?m)^([a-z_-]+):"), 1)
    unknown = F.exists(keys, lambda k: ~k.isin("name", "description", "license"))
    finding = F.when(~x.startswith("---\n"), "no frontmatter").when(field("name") == "", "no name").when(field("description") == "", "no description").when(~field("name").rlike("^[a-z0-9-]+$"), "bad name").when(unknown, "unknown key").otherwise("ok")
    return fixture(spark, _FRONT, "id int, x string").select("id", finding.alias("finding"))


_CASES = [(1, "ICSID Case No. ARB/12/5", None), (2, "", "https://x.org/case?caseno=ARB%2F03%2F19"), (3, "none", "https://x.org/"), (4, "PCA Case No. 2013-09", None)]


@query(f"SELECT id, coalesce(nullif(regexp_extract(title, '(ARB(?:[(]AF[)])?/[0-9]+/[0-9]+|[0-9]{{4}}-[0-9]{{2}})'), ''), nullif(regexp_extract(replace(coalesce(url, ''), '%2F', '/'), '(ARB(?:[(]AF[)])?/[0-9]+/[0-9]+)'), '')) AS number FROM {values(_CASES, 'id, title, url')}")
def h46_case_numbers(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    url = F.url_decode(F.coalesce("url", F.lit("")))
    return fixture(spark, _CASES, "id int, title string, url string").select("id", F.coalesce(pick(F.col("title"), r"(ARB(?:[(]AF[)])?/[0-9]+/[0-9]+|[0-9]{4}-[0-9]{2})"), pick(url, r"(ARB(?:[(]AF[)])?/[0-9]+/[0-9]+)")).alias("number"))


@query(f"SELECT doc_id, idx, level, slug, parent FROM (SELECT doc_id, idx, level, trim(regexp_replace(lower({sql_fold('text')}), '[^a-z0-9]+', '-', 'g'), '-') AS slug, array_to_string(heading_path, ' / ') AS parent FROM (SELECT DISTINCT doc_id, idx, level, text, heading_path FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL AND level <= 2))")
def h25_heading_seeds(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL AND level <= 2").select("doc_id", "idx", "level", "text", "heading_path").distinct()
    return h.select("doc_id", "idx", "level", T.slug(F.col("text")).alias("slug"), F.array_join("heading_path", " / ").alias("parent"))


@query("SELECT doc_id, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT doc_id, 'EMPTY_TEXT' AS code FROM documents WHERE coalesce(text, '') = '' UNION ALL SELECT doc_id, 'NO_BLOCKS' FROM documents ANTI JOIN (SELECT DISTINCT doc_id FROM blocks) b USING (doc_id) UNION ALL SELECT doc_id, 'NO_DATE' FROM documents WHERE doc_date IS NULL UNION ALL SELECT doc_id, 'LONG_TEXT' FROM documents WHERE n_chars > 20000) GROUP BY doc_id")
def h26_warning_codes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.coalesce("text", F.lit("")) == "").alias("empty"), F.col("doc_date").isNull().alias("undated"), (F.col("n_chars") > 20000).alias("long"))
    has = table(spark, d, "blocks").select("doc_id").distinct().withColumn("has", F.lit(True))
    codes = F.array_sort(F.filter(F.array(F.when(F.col("empty"), "EMPTY_TEXT"), F.when(F.col("has").isNull(), "NO_BLOCKS"), F.when(F.col("undated"), "NO_DATE"), F.when(F.col("long"), "LONG_TEXT")), lambda x: x.isNotNull()))
    return docs.join(has, "doc_id", "left").select("doc_id", F.array_join(codes, ",").alias("codes")).where("codes <> ''")


_OWNER = r"remaining ([0-9.]+)% of the shares is held by ([A-Z][a-z]+ [A-Z][A-Za-z]+)"


@query(f"SELECT DISTINCT doc_id, idx, owner, TRY_CAST(share AS DOUBLE) AS share FROM (SELECT doc_id, idx, unnest(regexp_extract_all(text, '{_OWNER}', 2)) AS owner, unnest(regexp_extract_all(text, '{_OWNER}', 1)) AS share FROM blocks WHERE text IS NOT NULL)")
def h13_every_owner(spark: SparkSession, d: str) -> DataFrame:
    """All owners of a block."""
    p = F.lit(_OWNER)
    found = F.arrays_zip(F.regexp_extract_all("text", p, 2).alias("owner"), F.regexp_extract_all("text", p, 1).alias("share"))
    b = table(spark, d, "blocks").where("text IS NOT NULL").select("doc_id", "idx", F.explode(found).alias("x"))
    return b.select("doc_id", "idx", "x.owner", F.col("x.share").try_cast("double").alias("share")).distinct()


_ACT_NAME = r"[A-Z][A-Za-z0-9]+(?: (?:[A-Z][A-Za-z0-9]*|of|and|the|for|in|to|on)){0,10} Act\b"
_SECTION = r"\b(?:ss?[.]|[Ss]ections?) ?[0-9]++(?:[.][0-9]++)*+(?:[(][0-9A-Za-z]+[)])*+"
_OF_ACT = rf" of (?:the )?(?:Act\b|{_ACT_NAME})"
# Kinds of citations of law.
CITATIONS = {
    "case": r"\b[A-Z][a-z]+ [A-Za-z.]+ v[.] [A-Z][a-z]+\b", "neutral": r"\b(?:19|20)[0-9]{2} [A-Z]{2,6} [0-9]+\b|\[(?:19|20)[0-9]{2}\] [A-Z]{2,6}(?: [A-Z][A-Za-z]+)? [0-9]+\b",
    "canlii": r"\b(?:19|20)[0-9]{2} CanLII [0-9]+\b", "act": rf"\b{_ACT_NAME}", "statute_section": _SECTION + _OF_ACT, "bare_section": rf"{_SECTION}(?!{_OF_ACT})", "rule": r"\b(?:[Rr]ules?|Reg[.]|[Rr]egulations?) ?[0-9]+(?:[.][0-9]+)*(?:[(][0-9A-Za-z]+[)])*",
}


_PLAIN_SECTION = _SECTION.replace("++", "+").replace("*+", "*")
_CITED_SQL = " UNION ALL ".join(
    [f"SELECT doc_id, idx, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS citation FROM b" for k, p in CITATIONS.items() if "section" not in k]
    + [f"SELECT doc_id, idx, CASE WHEN regexp_matches(x, '{_OF_ACT}$') THEN 'statute_section' ELSE 'bare_section' END, x FROM (SELECT doc_id, idx, unnest(regexp_extract_all(text, '{_PLAIN_SECTION}(?:{_OF_ACT})?')) AS x FROM b)"]
)


@query(f"WITH b AS (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE text IS NOT NULL) SELECT kind, citation, count(*) AS cites FROM ({_CITED_SQL}) GROUP BY kind, citation")
def h16_every_citation(spark: SparkSession, d: str) -> DataFrame:
    """All citations of a block, of every kind, with the times each is cited."""
    b = table(spark, d, "blocks").where("text IS NOT NULL").select("doc_id", "idx", "text").distinct()
    kinds = lambda k, p: F.transform(F.regexp_extract_all("text", F.lit(p), 0), lambda c: F.struct(F.lit(k).alias("kind"), c.alias("citation")))
    found = F.flatten(F.array(*[kinds(k, p) for k, p in CITATIONS.items()]))
    return b.select(F.explode(found).alias("x")).groupBy("x.kind", "x.citation").agg(F.count(F.lit(1)).alias("cites"))


_CELLS = ("Responsible Party", "Obligation", "Due Date", "Status")


@query(r"SELECT doc_id, idx, trim(c[1]) AS party, trim(c[2]) AS obligation, trim(c[3]) AS due, nullif(trim(c[4]), '') AS status FROM (SELECT DISTINCT doc_id, idx, string_split(text, ' | ') AS c FROM blocks WHERE block_type = 'table_row' AND text IS NOT NULL) WHERE len(c) >= 4")
def h19_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cells of table rows by their columns' meaning."""
    b = table(spark, d, "blocks").where("block_type = 'table_row' AND text IS NOT NULL").select("doc_id", "idx", F.split("text", r" \| ").alias("c")).distinct().where("size(c) >= 4")
    cell = lambda k: F.trim(F.col("c").getItem(k))
    return b.select("doc_id", "idx", cell(0).alias("party"), cell(1).alias("obligation"), cell(2).alias("due"), F.nullif(cell(3), F.lit("")).alias("status"))


@query(f"SELECT doc_id, count(*) AS sections, string_agg(t, ' > ' ORDER BY idx) AS outline FROM (SELECT doc_id, idx, {sql_clean('any_value(text)')} AS t FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL GROUP BY doc_id, idx) GROUP BY doc_id")
def k3_outline(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL").groupBy("doc_id", "idx").agg(T.clean(F.any_value("text")).alias("t"))
    return h.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), " > ").alias("outline"))

