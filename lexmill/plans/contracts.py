"""Named queries of what readers and writers outside this library hand over or ask for: page spans, requests, retries, diagrams, LaTeX, archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import text as T
from lexmill.operators.ordered import carry_down
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


# ---- pages of a document as a PDF library hands them over: spans with their size and weight

_SPANS = [(1, 0, 18.0, False, "Title"), (1, 1, 10.0, False, "Body one."), (1, 2, 10.0, False, "Body two."), (2, 3, 10.0, True, "Bold head"), (2, 4, 10.0, False, "More."), (3, 5, 9.0, False, "All alike."), (3, 6, 9.0, False, "Still alike."), (4, 7, 14.0, False, "Big"), (4, 8, 13.95, False, "Nearly as big"), (4, 9, 8.0, False, "small"), (4, 10, 8.0, False, "small too"), (4, 11, 8.0, False, "  ")]
#: Pages that are read; lines beyond get a code and stay.
PAGES = 3


@query(f"""WITH s AS (SELECT page, idx, CAST(size AS DOUBLE) AS size, bold, trim(text) AS text FROM {values(_SPANS, 'page, idx, size, bold, text')} WHERE trim(text) <> ''), p AS (SELECT *, max(size) OVER (PARTITION BY page) AS most, median(size) OVER (PARTITION BY page) AS body FROM s), h AS (SELECT *, size >= most - 0.1 AND (size > body OR bold) AS head FROM p)
 SELECT idx, 'page' || page AS anchor, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS block_type, text, last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER (ORDER BY idx) AS above, CASE WHEN page > {PAGES} THEN 'PDF_PAGE_LIMIT_REACHED' END AS code FROM h""")
def s13_page_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages as blocks: a heading has its page's largest type and is larger than most or bold."""
    s = fixture(spark, _SPANS, "page int, idx int, size double, bold boolean, text string").withColumn("text", F.trim("text")).where("text <> ''")
    page = s.groupBy("page").agg(F.max("size").alias("most"), F.median("size").alias("body"))
    h = s.join(page, "page").withColumn("head", (F.col("size") >= F.col("most") - 0.1) & ((F.col("size") > F.col("body")) | F.col("bold"))).withColumn("doc", F.lit(1))
    c = carry_down(h, "doc", "idx", F.when(F.col("head"), F.col("text")), "above")
    return c.select("idx", F.concat(F.lit("page"), F.col("page").cast("string")).alias("anchor"), F.when(F.col("head"), "heading").otherwise("paragraph").alias("block_type"), "text", "above", F.when(F.col("page") > PAGES, "PDF_PAGE_LIMIT_REACHED").alias("code"))


_RULED = [(1, True, [["A", "B"], ["1", "2"], ["3", ""]]), (2, False, None), (3, True, []), (4, True, [["H"], ["r1"], ["r2"], ["r3"]])]
#: Cells of a table from which a code is set.
TABLE_CELLS = 3


@query(f"SELECT page, array_to_string(cells[1], ' | ') AS headers, CAST(greatest(coalesce(len(cells), 0) - 1, 0) AS INTEGER) AS body_rows, CASE WHEN NOT library THEN 'PDF_TABLES_UNAVAILABLE' WHEN len(cells) > 1 AND (len(cells) - 1) * len(cells[1]) > {TABLE_CELLS} THEN 'PDF_TABLE_CELL_LIMIT_REACHED' END AS code FROM {values(_RULED, 'page, library, cells')}")
def s14_ruled_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables found on pages, the first row as headers; where the library is not there a code says so and nothing is lost silently."""
    t = fixture(spark, _RULED, "page int, library boolean, cells array<array<string>>")
    n = F.coalesce(F.size("cells"), F.lit(0))
    code = F.when(~F.col("library"), "PDF_TABLES_UNAVAILABLE").when((n > 1) & ((n - 1) * F.size(F.get("cells", F.lit(0))) > TABLE_CELLS), "PDF_TABLE_CELL_LIMIT_REACHED")
    return t.select("page", F.array_join(F.get("cells", F.lit(0)), " | ").alias("headers"), F.greatest(n - 1, F.lit(0)).alias("body_rows"), code.alias("code"))


# ---- requests

_ASKED = [(1, "good faith", None, None, False, None, None, False, 20), (2, None, None, "19-12.345", False, None, None, False, 5), (3, None, "Dupont", None, False, 2010, None, False, 10), (4, "la clause", None, None, True, 2000, 2005, True, 50)]
# Kinds of document asked for unless all are wanted.
TYPES = "(ART OR COUV OR OUV OR THESE)"


@query(f"""SELECT id, CASE WHEN number IS NOT NULL THEN 'title_t:"' || number || '"' WHEN author IS NOT NULL THEN 'authLastName_t:' || author WHEN exact THEN 'title_t:"' || query || '"' ELSE '(title_t:(' || query || ') OR abstract_t:(' || query || ') OR keyword_t:(' || query || '))' END AS q,
 concat_ws(' AND ', 'domain_s:shs.droit', CASE WHEN NOT all_types THEN 'docType_s:{TYPES}' END, CASE WHEN y0 IS NOT NULL OR y1 IS NOT NULL THEN 'producedDateY_i:[' || coalesce(y0, 1900) || ' TO ' || coalesce(y1, 2030) || ']' END) AS filters, 'producedDate_tdate desc' AS sort, n AS rows FROM {values(_ASKED, 'id, query, author, number, exact, y0, y1, all_types, n')}""")
def s20_pushed_query(spark: SparkSession, d: str) -> DataFrame:
    """What a search asks of the service: query, filters, order and number of rows are pushed down to it."""
    a = fixture(spark, _ASKED, "id int, query string, author string, number string, exact boolean, y0 int, y1 int, all_types boolean, n int")
    text = F.col("query")
    q = F.when(F.col("number").isNotNull(), F.concat(F.lit('title_t:"'), "number", F.lit('"'))).when(F.col("author").isNotNull(), F.concat(F.lit("authLastName_t:"), "author")).when(F.col("exact"), F.concat(F.lit('title_t:"'), text, F.lit('"'))).otherwise(F.concat(F.lit("(title_t:("), text, F.lit(") OR abstract_t:("), text, F.lit(") OR keyword_t:("), text, F.lit("))")))
    years = F.when(F.col("y0").isNotNull() | F.col("y1").isNotNull(), F.concat(F.lit("producedDateY_i:["), F.coalesce("y0", F.lit(1900)).cast("string"), F.lit(" TO "), F.coalesce("y1", F.lit(2030)).cast("string"), F.lit("]")))
    filters = F.concat_ws(" AND ", F.lit("domain_s:shs.droit"), F.when(~F.col("all_types"), f"docType_s:{TYPES}"), years)
    return a.select("id", q.alias("q"), filters.alias("filters"), F.lit("producedDate_tdate desc").alias("sort"), F.col("n").alias("rows"))


_ANSWERS = [("a", 120, [(429, None), (503, None), (200, None)]), ("b", 10, [(429, 7), (200, None)]), ("c", 50, [(500, None), (502, None), (503, None)]), ("d", 0, [(401, None)]), ("e", 30, [(200, None)])]
#: Tries of a request, seconds before the second, greatest page.
TRIES, BACKOFF, PAGE = 3, 2.0, 50
_TRY_ROWS = [(k, size, n, code, after) for k, size, tries in _ANSWERS for n, (code, after) in enumerate(tries, 1)]


@query(f"WITH t AS {values(_TRY_ROWS, 'id, size, n, code, after')} SELECT id, CAST(least(greatest(max(size), 1), {PAGE}) AS INTEGER) AS page_size, CAST(count(*) AS INTEGER) AS tries, CAST(sum(CASE WHEN (code = 429 OR code >= 500) AND n < {TRIES} THEN coalesce(after, {BACKOFF} * power(2, n - 1)) ELSE 0 END) AS DOUBLE) AS waited, CASE WHEN arg_max(code, n) = 200 THEN 'ok' WHEN arg_max(code, n) IN (401, 403) THEN 'refused' ELSE 'gave up' END AS outcome FROM t WHERE n <= {TRIES} GROUP BY id")
def s22_retry_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Requests to a service: page size held to its limit, tries, seconds waited (doubling, or as told), and how each ended."""
    t = fixture(spark, _TRY_ROWS, "id string, size int, n int, code int, after int").where(F.col("n") <= TRIES)
    again = ((F.col("code") == 429) | (F.col("code") >= 500)) & (F.col("n") < TRIES)
    wait = F.when(again, F.coalesce(F.col("after").cast("double"), F.lit(BACKOFF) * F.pow(F.lit(2.0), F.col("n") - 1))).otherwise(0.0)
    last = F.max_by("code", "n")
    return t.groupBy("id").agg(F.least(F.greatest(F.max("size"), F.lit(1)), F.lit(PAGE)).alias("page_size"), F.count(F.lit(1)).cast("int").alias("tries"), F.sum(wait).alias("waited"), F.when(last == 200, "ok").when(last.isin(401, 403), "refused").otherwise("gave up").alias("outcome"))


_SOURCES = [(1, "https://example.org/a/tool.git"), (2, "git@example.org:a/tool.git"), (3, "/srv/tool"), (4, "https://example.org/page"), (5, "./here")]


@query(f"SELECT id, CASE WHEN regexp_matches(source, '^(https?://|git@).*[.]git$') THEN 'clone' WHEN regexp_matches(source, '^https?://') THEN 'unsupported' ELSE 'path' END AS kind, CASE WHEN ends_with(source, '.git') THEN regexp_extract(source, '([^/:]+)[.]git$', 1) END AS name FROM {values(_SOURCES, 'id, source')}")
def s19_source_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether a source is a repository to be cloned beforehand, with one commit of history, or a path that is read."""
    s = F.col("source")
    kind = F.when(s.rlike("^(https?://|git@).*[.]git$"), "clone").when(s.rlike("^https?://"), "unsupported").otherwise("path")
    return fixture(spark, _SOURCES, "id int, source string").select("id", kind.alias("kind"), F.when(s.endswith(".git"), F.regexp_extract(s, "([^/:]+)[.]git$", 1)).alias("name"))


# ---- diagrams, LaTeX, archives

# Classes of a diagram's nodes by the type of a party, with a variant for risk.
CLASSES = {"organisation": "orgNode", "person": "personNode"}


@query("WITH n AS (SELECT doc_id, party_id, CASE type WHEN 'organisation' THEN 'orgNode' WHEN 'person' THEN 'personNode' END || CASE WHEN role IS NULL THEN 'High' ELSE '' END AS class FROM (SELECT DISTINCT doc_id, party_id, type, role FROM parties WHERE doc_id IS NOT NULL)), g AS (SELECT doc_id, class, string_agg(DISTINCT 'P' || party_id, ',' ORDER BY 'P' || party_id) AS nodes FROM n WHERE class IS NOT NULL GROUP BY doc_id, class) SELECT doc_id, string_agg('class ' || nodes || ' ' || class, chr(10) ORDER BY class) AS lines FROM g GROUP BY doc_id")
def k7_diagram_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class lines of each document's diagram: nodes gathered by class, classes in order."""
    p = table(spark, d, "parties").where("doc_id IS NOT NULL").select("doc_id", "party_id", "type", "role").distinct()
    base = F.coalesce(*[F.when(F.col("type") == t, F.lit(c)) for t, c in CLASSES.items()])
    n = p.withColumn("class", F.concat(base, F.when(F.col("role").isNull(), "High").otherwise(""))).where("class IS NOT NULL")
    g = n.groupBy("doc_id", "class").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("P"), F.col("party_id").cast("string")))), ",").alias("nodes"))
    line = F.struct("class", F.concat(F.lit("class "), "nodes", F.lit(" "), "class").alias("line"))
    return g.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))


_TEX = lambda x: "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '\\', chr(1)), '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_'), '{{', '\\{{'), '}}', '\\}}'), '~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}'), chr(1), '\\textbackslash{{}}')".format(x)
_QUOTES_TEX = lambda x: f"replace(replace(replace(replace(replace({x}, '—', '---'), '–', '--'), '…', '\\ldots{{}}'), '“', '``'), '”', '''''')"


@query(f"SELECT doc_id, string_agg(CASE WHEN level = 1 THEN '\\section{{' ELSE '\\subsection{{' END || {_QUOTES_TEX(_TEX('t'))} || '}}', chr(10) ORDER BY idx) AS latex FROM (SELECT doc_id, idx, min(level) AS level, min(replace(text, chr(10), ' ')) AS t FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL GROUP BY doc_id, idx) GROUP BY doc_id")
def k8_latex_outline(spark: SparkSession, d: str) -> DataFrame:
    """A document's headings as the sections of a LaTeX report, every special character escaped."""
    h = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL").groupBy("doc_id", "idx").agg(F.min("level").alias("level"), F.min(F.replace("text", F.lit("\n"), F.lit(" "))).alias("t"))
    t = T.escape(F.col("t"), "latex")
    for a, b in (("—", "---"), ("–", "--"), ("…", "\\ldots{}"), ("“", "``"), ("”", "''")):
        t = F.replace(t, F.lit(a), F.lit(b))
    line = F.struct("idx", F.concat(F.when(F.col("level") == 1, "\\section{").otherwise("\\subsection{"), t, F.lit("}")).alias("line"))
    return h.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("latex"))


@query("SELECT r_regionkey AS pack, count(*) AS files, CAST(sum(length(n_name)) AS BIGINT) AS chars FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def k13_archives(spark: SparkSession, d: str) -> DataFrame:
    """Files packed into one archive for each region, and what is found in it when it is opened again."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("pack"), F.concat("n_name", F.lit(".txt")).alias("file"), F.col("n_name").alias("text"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(pdf["file"], pdf["text"])):
                z.writestr(name, text)
        return pd.DataFrame({"pack": [int(pdf["pack"].iloc[0])], "content": [buffer.getvalue()]})

    @F.pandas_udf("files long, chars long")
    def opened(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                rows.append((len(z.namelist()), sum(len(z.read(x).decode()) for x in z.namelist())))
        return pd.DataFrame(rows, columns=["files", "chars"])

    packed = n.groupBy("pack").applyInPandas(pack, "pack int, content binary")
    return packed.select("pack", opened("content").alias("x")).select("pack", "x.*")


# Width and height of pages in inches.
_SIZES = [(1, 8.5, 11.0), (2, 11.0, 17.0), (3, 24.0, 36.0), (4, 0.0, 11.0)]


@query(f"SELECT id, CAST(CASE WHEN least(w, h) <= 0 THEN NULL ELSE greatest(least(floor(2000 / greatest(w, h)), 300), 72) END AS INTEGER) AS dpi FROM {values(_SIZES, 'id, w, h')}")
def k16_page_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Dots an inch at which a page's longer side has about two thousand, within bounds; the drawing is the renderer's."""
    p = fixture(spark, _SIZES, "id int, w double, h double")
    dpi = F.greatest(F.least(F.floor(F.lit(2000.0) / F.greatest("w", "h")), F.lit(300)), F.lit(72))
    return p.select("id", F.when(F.least("w", "h") > 0, dpi).cast("int").alias("dpi"))
