"""Named queries of operators that need more than expressions: patches, span edits, spans in context, plans."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.operators import patches, spans
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


_DOC = json.dumps({"evidence": [{"id": "E1"}], "parties": [{"name": "A"}]})
_PATCHES = [
    (1, _DOC, '[{"op": "add", "path": "/parties/-", "value": {"name": "B", "evidence_id": "E1", "source_ref": "p1"}}]'), (2, _DOC, '[{"op": "remove", "path": "/parties/5"}]'),
    (3, _DOC, '[{"op": "add", "path": "/parties/-", "value": {"name": "C", "evidence_id": "E9"}}]'), (4, _DOC, '[{"op": "move", "path": "/x"}]'), (5, "broken", "[]"), (6, _DOC, '[{"op": "replace", "path": "/parties/0/name", "value": "Z"}]'),
]
_PATCHED = [(1, "", 2), (2, "POINTER", None), (3, "EVIDENCE,SOURCE", None), (4, "FORM", None), (5, "JSON", None), (6, "", 1)]


@query(f"SELECT id, findings, parties FROM {values(_PATCHED, 'id, findings, parties')}")
def h28_patch_gate(spark: SparkSession, d: str) -> DataFrame:
    out = patches.apply_patches(fixture(spark, _PATCHES, "id int, document string, patch string"))
    return out.select("id", F.array_join("findings", ",").alias("findings"), F.size(F.from_json("patched", "parties array<struct<name string>>")["parties"]).alias("parties"))


# Edits of French legal text.
EDIT_RULES = [spans.EditRule("quotes", "quotes", ""), spans.EditRule("ligature", "oeuvre", "œuvre"), spans.EditRule("spaces", " {2,}", " "), spans.EditRule("future", r"devra", "doit", ("Preneur", "Bailleur", "Garante"))]


_FR_PARAS = "(SELECT DISTINCT doc_id, idx, text FROM blocks WHERE block_type = 'paragraph' AND starts_with(lower(lang), 'fr') AND text IS NOT NULL)"
_EDITED_SQL = f"""q AS (SELECT doc_id, idx, CASE WHEN (len(string_split(text, chr(34))) - 1) % 2 = 0 THEN list_reduce(list_transform(string_split(text, chr(34)), lambda x, k: CASE WHEN k = 1 THEN x WHEN k % 2 = 0 THEN '« ' || x ELSE ' »' || x END), lambda a, b: a || b) ELSE text END AS t, CASE WHEN (len(string_split(text, chr(34))) - 1) % 2 = 0 THEN len(string_split(text, chr(34))) - 1 ELSE 0 END AS n FROM {_FR_PARAS}),
 l AS (SELECT doc_id, idx, replace(t, 'oeuvre', 'œuvre') AS t, n + len(string_split(t, 'oeuvre')) - 1 AS n FROM q), s AS (SELECT doc_id, idx, regexp_replace(t, ' {{2,}}', ' ', 'g') AS t, n + len(regexp_extract_all(t, ' {{2,}}')) AS n FROM l),
 d AS (SELECT *, string_split(t, 'devra') AS p FROM s), g AS (SELECT *, list_transform(range(1, len(p)), lambda k: regexp_matches(right(array_to_string(p[1:k], 'devra'), 60), 'Preneur|Bailleur|Garante')) AS gate FROM d),
 e AS (SELECT doc_id, idx, list_reduce(list_transform(p, lambda x, k: CASE WHEN k = 1 THEN x WHEN gate[k - 1] THEN 'doit' || x ELSE 'devra' || x END), lambda a, b: a || b) AS edited, n + len(list_filter(gate, lambda x: x)) AS n FROM g)"""


@query(f"WITH {_EDITED_SQL} SELECT doc_id, idx, edited, CAST(n AS INTEGER) AS edits FROM e")
def h41_span_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edited French paragraphs with the number of edits by rule."""
    b = table(spark, d, "blocks").where("block_type = 'paragraph' AND startswith(lower(lang), 'fr') AND text IS NOT NULL").select("doc_id", "idx", "text").distinct()
    out = spans.apply_rules(b, "text", EDIT_RULES)
    return out.select("doc_id", "idx", "edited", F.size("ledger").alias("edits"))


@query(f"WITH {_EDITED_SQL}, r AS (SELECT doc_id, idx, len(string_split(edited, chr(34))) - 1 AS quotes, len(string_split(edited, 'oeuvre')) - 1 AS ligatures, len(regexp_extract_all(edited, ' {{2,}}')) AS spaces, string_split(edited, 'devra') AS p FROM e) SELECT doc_id, idx, CAST(CASE WHEN quotes % 2 = 0 THEN quotes ELSE 0 END + ligatures + spaces + len(list_filter(range(1, len(p)), lambda k: regexp_matches(right(array_to_string(p[1:k], 'devra'), 60), 'Preneur|Bailleur|Garante'))) AS INTEGER) AS further FROM r")
def h42_idempotent_edits(spark: SparkSession, d: str) -> DataFrame:
    """A second run over edited text finds nothing more to edit."""
    again = spans.apply_rules(h41_span_edits(spark, d).select("doc_id", "idx", F.col("edited").alias("text")), "text", EDIT_RULES)
    return again.select("doc_id", "idx", F.size("ledger").alias("further"))


_ON = r"[0-9]{1,2} \p{L}+\.? [0-9]{4}"
# Kinds of French references and their patterns.
REFERENCES = [
    ("cassation", rf"Cass\.? (?:civ\. ?[0-9]+(?:re|e)|com\.|soc\.|crim\.|Ass\. ?pl[ée]n\.|Ch\. ?mixte)[, ]+{_ON},? ?n° ?[0-9]{{2}}-[0-9]{{2}}[. ]?[0-9]{{3}}"), ("cassation_short", rf"(?:Civ\. ?[0-9]+(?:re|e)|Com\.|Soc\.|Crim\.)[, ]+{_ON},? ?n° ?[0-9]{{2}}-[0-9]{{2}}[. ]?[0-9]{{3}}"),
    ("council", rf"CE[, ]+(?:Ass\.|Sect\.)?[, ]*{_ON},? ?n° ?[0-9]{{4,7}}"), ("council_long", rf"Conseil d['’] ?[EÉ]tat[, ]+{_ON}"), ("constitutional", rf"Cons\. ?const\.[, ]+{_ON},? ?n° ?[0-9]{{2,4}}-[0-9]{{2,4}} ?(?:QPC|DC|LP)?"), ("appeal", rf"CA [A-ZÀ-Ü][a-zà-ü-]+[, ]+(?:pôle [0-9]+,? ?)?(?:ch\. ?[0-9]+[, ]+)?{_ON}"),
    ("code_article", r"[Aa]rt(?:icle)?\.? (?:[LRDA]\.? ?)?[0-9]+(?:-[0-9]+)* (?:du )?(?:code |C\. ?)\p{L}+"), ("code_short", r"[Aa]rt(?:icle)?\.? (?:[LRDA]\.? ?)?[0-9]+(?:-[0-9]+)* (?:CPC|CPP|CJA|CGCT|CSP|CSS)"), ("law", rf"[Ll]oi n° ?[0-9]{{2,4}}-[0-9]{{1,5}} du {_ON}"), ("decree", rf"[Dd][ée]cr(?:et)?\.? n° ?[0-9]{{2,4}}-[0-9]{{1,5}} du {_ON}"), ("ordinance", rf"[Oo]rd(?:onnance)?\.? n° ?[0-9]{{2,4}}-[0-9]{{1,5}} du {_ON}"),
    ("article", r"[A-ZÀ-Ü][a-zà-ü]+(?: [A-Z]\.)+[, ]+«[^»]+»[, ]+[A-Z][a-zà-ü.]+(?: [a-zà-ü.]+)* [0-9]{4}"), ("book", r"[A-ZÀ-Ü][a-zà-ü]+ ?\([A-Z][a-z]?\.\)[, ]+[A-ZÀ-Ü][^,]+, ?[A-ZÀ-Ü][^,]+, ?[0-9]{4}"), ("human_rights", rf"CEDH[, ]+{_ON}[, ]+[A-ZÀ-Ü][a-zà-ü]+ c[/.] ?[A-ZÀ-Ü]"), ("european", rf"CJ(?:UE|CE)[, ]+{_ON}[, ]+(?:aff\. ?)?C-[0-9]+/[0-9]+"),
    ("plain_article", r"art\. [0-9]+(?: al\. [0-9]+)?"), ("decision", r"n° [0-9]+-[0-9]+\.[0-9]+"), ("chapter", r"chap\. [0-9]+"), ("page", r"p\. [0-9]+"),
]
_REF_FIX = [
    (-1, 0, "Voir Cass. civ. 1re, 12 juill. 2023, n° 21-12.345 puis Com., 3 mai 2001, n° 99-10.222."), (-2, 0, "CE, Sect., 5 juin 1998, n° 12345 ; Conseil d’État, 2 mai 1990 ; Cons. const., 1 mars 2010, n° 2010-1 QPC ; CA Lyon, ch. 3, 4 avril 2012."), (-3, 0, "Art. L. 110-1 C. com et article 1240 du code civil, art. 4 CPC, loi n° 85-677 du 5 juillet 1985, décret n° 2001-12 du 3 mars 2001, ordonnance n° 2016-131 du 10 février 2016."),
    (-4, 0, "Dupont J., « La clause », Rev. dr. 2010, et Durand (P.), Traité, Dalloz, 1999 ; CEDH, 3 mai 2000, Martin c. Italie ; CJUE, 4 mai 2010, aff. C-12/09."),
]


def _spans_sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    rows = " UNION ALL ".join(f"SELECT doc_id, idx, text, '{k}' AS kind, regexp_extract_all(text, {quote(p)}) AS m, string_split_regex(text, {quote(p)}) AS s FROM b" for k, p in REFERENCES)
    return f"""WITH b AS (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE starts_with(lower(lang), 'fr') AND text IS NOT NULL UNION ALL SELECT * FROM {values(_REF_FIX, 'doc_id, idx, text')}), x AS ({rows}), y AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM x WHERE len(m) > 0),
 z AS (SELECT doc_id, idx, text, kind, m[k] AS match, CAST(list_sum(list_transform(s[1:k], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda v: length(v))), 0) AS INTEGER) AS start FROM y)
 SELECT doc_id, idx, kind, start, CAST(start + length(match) AS INTEGER) AS "end", match, substr(text, greatest(start - 50, 0) + 1, start + length(match) + 50 - greatest(start - 50, 0)) AS around FROM z"""


@query(_spans_sql())
def h34_references(spark: SparkSession, d: str) -> DataFrame:
    """References of every kind in French text, with their places and fifty characters around each."""
    b = table(spark, d, "blocks").where("startswith(lower(lang), 'fr') AND text IS NOT NULL").select("doc_id", "idx", "text").distinct().unionByName(fixture(spark, _REF_FIX, "doc_id long, idx int, text string"))
    return spans.find_spans(b, "text", REFERENCES).select("doc_id", "idx", "kind", "start", "end", "match", "around")


# Twelve typographic rules in the order they run; a part in parentheses stays.
TYPOGRAPHY = (
    ("apostrophes", r"([\p{L}\p{N}_])'", "$1’"), ("suspension", r"\.\.\.+", "…"), ("low_marks", r" +([,.])", "$1"), ("civilities", r"(^|[^\p{L}])Mr(?:\.|([^\p{L}.])|$)", "$1M.$2"), ("ordinals_first", r"(^|[^\p{L}\p{N}])1[èe]re($|[^\p{L}\p{N}])", "$1" + "1re" + "$2"), ("ordinals", r"(^|[^\p{L}\p{N}])([0-9]+)(?:[èe]me|ième|è)($|[^\p{L}\p{N}])", "$1$2e$3"),
    ("ligatures", r"oeu", "œu"), ("ligatures_upper", r"Oeu", "Œu"), ("thin_spaces", r" ([;?!])", "\u202f$1"), ("colon_spaces", r" (:)", "\u00a0$1"), ("references", r"(art\.|al\.|p\.|pp\.|vol\.|ch\.|§) ([0-9])", "$1\u00a0$2"), ("dashes", r"([^ ]) *— *", "$1\u00a0— "), ("spaces", r" {2,}", " "), ("capitals", r"(^|[^\p{L}])Etat(s?)($|[^\p{L}])", "$1État$2$3"),
)
_TYPO_FIX = [(-1, 0, "L'Etat c'est Mr Dupont, la 1ere fois... le 2ème jour , à 3 h ; oeuvre — fin :  p. 3 art. 5"), (-2, 0, "Rien à faire.")]


def _typo_sql(x: str) -> str:
    for _, a, b in TYPOGRAPHY:
        x = f"regexp_replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace('$', chr(92))}', 'g')"
    return x


@query(f"WITH b AS (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE text IS NOT NULL AND starts_with(lower(lang), 'fr') UNION ALL SELECT * FROM {values(_TYPO_FIX, 'doc_id, idx, text')}) SELECT doc_id, idx, {_typo_sql('text')} AS fixed FROM b")
def t24_all_typography(spark: SparkSession, d: str) -> DataFrame:
    """All typographic rules one after the other, as one chain of expressions; quotation marks are those of ``h41``."""
    b = table(spark, d, "blocks").where("text IS NOT NULL AND startswith(lower(lang), 'fr')").select("doc_id", "idx", "text").distinct().unionByName(fixture(spark, _TYPO_FIX, "doc_id long, idx int, text string"))
    c = F.col("text")
    for _, pattern, new in TYPOGRAPHY:
        c = F.regexp_replace(c, pattern, new)
    return b.select("doc_id", "idx", c.alias("fixed"))


_PAIRS = [(1, "Alpha v. Beta [2020] UKSC 1 and Gamma v. Delta [2019] EWCA 22"), (2, "[2018] EWHC 3 stands alone"), (3, "Alpha v. Beta, a case of long standing that nobody cites by number any more, [2020] UKSC 1")]


_NEAR = r"([A-Z][a-z]+ v\. [A-Z][a-z]+).{0,50}?(\[[0-9]{4}\] [A-Z]+ [0-9]+)"


@query(f"SELECT id, unnest(regexp_extract_all(x, '{_NEAR}', 1)) AS name, unnest(regexp_extract_all(x, '{_NEAR}', 2)) AS cite FROM {values(_PAIRS, 'id, x')}")
def j13_name_citation_pairs(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<struct<name string, cite string>>")
    def pair(texts: pd.Series) -> pd.Series:
        def one(t):
            names, cites = list(re.finditer(r"[A-Z][a-z]+ v\. [A-Z][a-z]+", t)), list(re.finditer(r"\[\d{4}\] [A-Z]+ \d+", t))
            got = spans.pair_within([m.span() for m in names], [m.span() for m in cites], 50)
            return [{"name": names[i].group(0), "cite": cites[j].group(0)} for i, j in got]

        return texts.map(one)

    return fixture(spark, _PAIRS, "id int, x string").select("id", F.explode(pair("x")).alias("p")).select("id", "p.*")


_PLAN = [("a", 3, []), ("b", 2, [("a", "FS", 0)]), ("c", 4, [("a", "SS", 1)]), ("d", 1, [("b", "FS", 0), ("c", "FF", 2)])]


_LINKS = [(before, n, kind, lag) for n, _, links in _PLAN for before, kind, lag in links]


@query(f"""WITH RECURSIVE t AS {values([(n, length) for n, length, _ in _PLAN], 'task, days')}, l AS (SELECT a, b, lag + CASE kind WHEN 'FS' THEN ta.days WHEN 'SS' THEN 0 ELSE ta.days - tb.days END AS shift FROM {values(_LINKS, 'a, b, kind, lag')} k JOIN t ta ON ta.task = k.a JOIN t tb ON tb.task = k.b),
 f AS (SELECT task, 0 AS at FROM t UNION ALL SELECT b, f.at + shift FROM f JOIN l ON l.a = f.task), e AS (SELECT task, CAST(max(f.at) AS INTEGER) AS earliest FROM f GROUP BY task), fin AS (SELECT max(earliest + days) AS done FROM e JOIN t USING (task)),
 g AS (SELECT task, done - days AS at FROM t, fin UNION ALL SELECT a, g.at - shift FROM g JOIN l ON l.b = g.task), h AS (SELECT task, CAST(min(g.at) AS INTEGER) AS latest FROM g GROUP BY task) SELECT task, earliest, latest, latest - earliest AS slack FROM e JOIN h USING (task)""")
def w17_critical_path(spark: SparkSession, d: str) -> DataFrame:
    rows = [("p", n, length, [list(map(str, x)) for x in before]) for n, length, before in _PLAN]

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        got = spans.critical_path([(n, int(length), [(x[0], x[1], int(x[2])) for x in before]) for n, length, before in zip(pdf["task"], pdf["days"], pdf["before"])])
        return pd.DataFrame([(n, *v) for n, v in got.items()], columns=["task", "earliest", "latest", "slack"])

    return fixture(spark, rows, "project string, task string, days int, before array<array<string>>").groupBy("project").applyInPandas(plan, "task string, earliest int, latest int, slack int")


@query(r"SELECT DISTINCT doc_id, idx FROM blocks WHERE regexp_matches(text, '(^|[^A-Za-z])(the the|of of|that that|shall shall|le le|de de|les les) ')")
def t29_repeated_words(spark: SparkSession, d: str) -> DataFrame:
    """Function words typed twice in a row, by a back reference."""
    b = table(spark, d, "blocks").where(F.col("text").rlike(r"(^|[^A-Za-z])(the|of|that|shall|le|de|les) \2 "))
    return b.select("doc_id", "idx").distinct()


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE matter_id = 1) AND matter_id IS NOT NULL")
def w15_not_yet_seen(spark: SparkSession, d: str) -> DataFrame:
    """Documents that an earlier run, here that of matter 1, has not worked through."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND matter_id IS NOT NULL").select("doc_id", "matter_id")
    return docs.select("doc_id").join(docs.where("matter_id = 1").select("doc_id"), "doc_id", "left_anti")
