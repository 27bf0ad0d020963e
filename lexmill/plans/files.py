"""Named queries over sources, sinks and streams."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexmill.functions import dates as D
from lexmill.operators.ordered import idle_sessions
from lexmill.plans.common import fixture, values
from lexmill.session import scratch, table
from lexmill.sources import files as S, sinks as K
from lexmill.streaming.sessions import run_once, stream_sessions

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _put(spark: SparkSession, lines: list[str]) -> str:
    """A small text file in the shared folder."""
    path = scratch(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


_CSV_LINES = ["id;name;hours", '1;"a;b";3', '2;"";x', "3;plain;4"]


@query(f"SELECT regexp_extract(line, '^([^;]*);', 1) AS id, regexp_extract(line, '^[^;]*;(?:\"([^\"]*)\"|([^;]*));', 1) || regexp_extract(line, '^[^;]*;(?:\"([^\"]*)\"|([^;]*));', 2) AS name, regexp_extract(line, ';([^;]*)$', 1) AS hours FROM {values([(x,) for x in _CSV_LINES[1:]], 'line')}")
def s1_delimited(spark: SparkSession, d: str) -> DataFrame:
    df = S.read_delimited(spark, _put(spark, _CSV_LINES))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


_RECORDS = '{"records": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}], "total": 2}'


@query(f"SELECT CAST(json_extract_string(r, '$.id') AS INTEGER) AS id, json_extract_string(r, '$.name') AS name FROM (SELECT unnest(json_extract({values([(_RECORDS,)], 'x').replace('SELECT *', 'SELECT x')}, '$.records[*]')) AS r)")
def s2_json_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.read_json_rows(spark, _put(spark, [_RECORDS])).select(F.col("id").cast("int").alias("id"), "name")


_ENTRIES = ['{"ref": "r1", "tool": "hal", "supports": true}', "not json", "", '{"ref": "r2", "tool": "openalex"}']


@query(f"SELECT json_extract_string(x, '$.ref') AS ref, json_extract_string(x, '$.tool') AS tool, CAST(json_extract_string(x, '$.supports') AS BOOLEAN) AS supports FROM {values([(x,) for x in _ENTRIES], 'x')} WHERE json_valid(x)")
def s26_journal(spark: SparkSession, d: str) -> DataFrame:
    """Broken and blank lines are left out; a missing answer stays unknown."""
    return S.read_journal(spark, _put(spark, _ENTRIES), "ref string, tool string, supports boolean")


_MD = "# One\n\nWrapped\nline here.\n\n- first\n- second\n\n## Two\n| A | B |\n|---|---|\n| 1 | 2 |\n```\n# no heading\n```\nEnd.\n"
_MD_ROWS = [(0, "heading", 1, "One", ""), (1, "paragraph", None, "Wrapped line here.", "One"), (2, "list_item", None, "first", "One"), (3, "list_item", None, "second", "One"), (4, "heading", 2, "Two", "One"), (5, "table_row", None, "A | B", "One/Two"), (6, "table_row", None, "1 | 2", "One/Two"), (7, "paragraph", None, "End.", "One/Two")]


def _blocks(spark: SparkSession, name: str, content: bytes) -> DataFrame:
    return S.parse_documents(spark.createDataFrame([(name, bytearray(content))], "path string, content binary")).select("idx", "block_type", "level", "text", F.array_join("heading_path", "/").alias("above"))


@query(f"SELECT * FROM {values(_MD_ROWS, 'idx, block_type, level, text, above')}")
def s8_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, "a.md", _MD.encode())


@query(f"SELECT * FROM {values([(0, 'heading', 1, 'TERMS', ''), (1, 'paragraph', None, 'Some text on two lines.', 'TERMS'), (2, 'heading', 1, 'Notices', ''), (3, 'paragraph', None, 'Send them.', 'Notices')], 'idx, block_type, level, text, above')}")
def s9_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, "a.txt", b"TERMS\n\nSome text\non two lines.\n\nNotices:\n\nSend them.\n")


_WS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


@query(rf"""WITH p AS (SELECT doc_id, generate_subscripts(s, 1) AS k, trim(regexp_replace(unnest(s), '{_WS}+', ' ', 'g')) AS one FROM (SELECT doc_id, string_split_regex(text, '\n{_WS}*\n') AS s FROM documents WHERE length(text) > 0)), q AS (SELECT doc_id, one, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, length(one) <= 80 AND (ends_with(one, ':') OR upper(one) = one AND lower(one) <> one) AS head FROM p WHERE one <> ''),
 r AS (SELECT *, CASE WHEN head THEN rtrim(one, ':') ELSE one END AS text FROM q)
 SELECT doc_id, CAST(idx AS INTEGER) AS idx, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS block_type, text, CASE WHEN head THEN '' ELSE coalesce(last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx), '') END AS above FROM r""")
def s9_plain_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents read as plain text files: paragraphs between blank lines, short ones in capitals or with a colon as headings."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    b = S.parse_documents(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content")))
    return b.where("text IS NOT NULL").select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), "idx", "block_type", "text", F.array_join("heading_path", "/").alias("above"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def _zip(parts: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


def docx_fixture() -> bytes:
    p = lambda t, style="", num=False: f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{"<w:numPr/>" if num else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = p("Scope", "Heading1") + p("It applies.") + p("item", num=True) + "<w:tbl>" + row("A", "B") + row("1", "2") + "</w:tbl>"
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/footnotes.xml": f'<w:footnotes {_W}><w:footnote w:id="1">{p("A note.")}</w:footnote></w:footnotes>'})


def pptx_fixture() -> bytes:
    shape = lambda t, title: f'<p:sp><p:nvSpPr><p:nvPr>{"<p:ph type=" + chr(34) + "title" + chr(34) + "/>" if title else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    return _zip({f"ppt/slides/slide{k}.xml": f"<p:sld {_A}>{shape(f'Title {k}', True)}{shape(f'Body {k}', False)}</p:sld>" for k in (1, 2)})


@query(f"SELECT * FROM {values([(0, 'heading', 1, 'Scope', ''), (1, 'paragraph', None, 'It applies.', 'Scope'), (2, 'list_item', None, 'item', 'Scope'), (3, 'table_row', None, 'A | B', 'Scope'), (4, 'table_row', None, '1 | 2', 'Scope'), (5, 'paragraph', None, 'A note.', 'Scope')], 'idx, block_type, level, text, above')}")
def s10_docx(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, "a.docx", docx_fixture())


@query("SELECT CAST(2 * k - 2 + t AS INTEGER) AS idx, CASE t WHEN 0 THEN 'heading' ELSE 'paragraph' END AS block_type, CASE t WHEN 0 THEN 1 END AS level, CASE t WHEN 0 THEN 'Title ' ELSE 'Body ' END || k AS text, CASE t WHEN 0 THEN '' ELSE 'Title ' || k END AS above FROM range(1, 3) r(k), range(0, 2) s(t)")
def s15_pptx(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, "a.pptx", pptx_fixture())


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def k1_workbook_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The nations written as a workbook and read back by its header row."""
    n = table(spark, d, "nation").select(F.lit("nation").alias("k"), F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")
    rows = S.read_workbook_rows(K.workbooks(n, "k", ["n_nationkey", "n_name"]))
    cells = S.with_header(rows, ["n_nationkey", "n_name"])
    return cells.select(F.col("cells")["n_nationkey"].alias("n_nationkey"), F.col("cells")["n_name"].alias("n_name"))


@query("SELECT matter_id, '| ' || matter_id || ' | ' || replace(coalesce(matter, ''), '|', '\\|') || ' | ' || coalesce(nullif(attorney, ''), 'matter ' || matter_id) || ' |' AS line FROM matters".replace("\\\\", "\\"))
def k2_markdown_log(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "matters")
    who = F.coalesce(F.nullif("attorney", F.lit("")), F.concat_ws(" ", F.lit("matter"), F.col("matter_id").cast("string")))
    return m.select("matter_id", K.markdown_row(F.col("matter_id"), F.col("matter"), who).alias("line"))


@query(r"""SELECT matter_id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || left(sha256(CAST(matter_id AS VARCHAR) || '|' || strftime(opened_at, '%Y-%m-%d')), 24) || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(opened_at, '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(opened_at + INTERVAL 1 DAY, '%Y%m%d') || chr(13) || chr(10)
 || 'SUMMARY:' || replace(replace(replace(coalesce(left(matter, 40), ''), '\', '\\'), ';', '\;'), ',', '\,') || chr(13) || chr(10) || 'END:VEVENT' AS event FROM matters WHERE opened_at IS NOT NULL""")
def k5_calendar(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "matters").where("opened_at IS NOT NULL").withColumn("day", F.to_date("opened_at"))
    event = K.calendar_events(D.uid(F.col("matter_id").cast("string"), F.col("day").cast("string")), F.col("day"), F.date_add("day", 1), F.coalesce(F.substring("matter", 1, 40), F.lit("")))
    return K.fold_calendar(m.select("matter_id", event.alias("event")), "event")


@query("SELECT r_regionkey, '| ' || rpad(CAST(r_regionkey AS VARCHAR), CAST((SELECT max(length(CAST(r_regionkey AS VARCHAR))) FROM region) AS INTEGER), ' ') || ' | ' || rpad(r_name, CAST((SELECT max(length(r_name)) FROM region) AS INTEGER), ' ') || ' |' AS line FROM region")
def k12_aligned_table(spark: SparkSession, d: str) -> DataFrame:
    return K.aligned_rows(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey", "r_name"]).select("r_regionkey", "line")


_JOURNAL = [(1, "r1", "s1", True), (2, "r2", "s2", False), (3, "r3", "s3", None)]


@query(f"SELECT CAST(row_number() OVER (ORDER BY n) AS INTEGER) AS no, ref, CASE WHEN supports IS NULL THEN 'to check' WHEN supports THEN 'yes' ELSE 'no' END AS verdict FROM {values(_JOURNAL, 'n, ref, source, supports')}")
def k10_verification_table(spark: SparkSession, d: str) -> DataFrame:
    """A report of one journal, numbered in order: a page a person reads, so one task writes it."""
    j = fixture(spark, _JOURNAL, "n int, ref string, source string, supports boolean")
    verdict = F.when(F.col("supports").isNull(), "to check").when(F.col("supports"), "yes").otherwise("no")
    return j.select(F.row_number().over(Window.orderBy("n")).alias("no"), "ref", verdict.alias("verdict"))


_SESSIONS = """(SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
 SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, n)"""


@query(f"SELECT * FROM {_SESSIONS} WHERE ended + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def r4_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the events read as a stream; those the watermark has not passed are still open."""
    folder = scratch(spark)
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    e.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in")
    run_once(stream_sessions(stream, "user_id", "ts", 60), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    return out.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")


@query(f"SELECT user_id, count(*) AS sessions FROM {_SESSIONS} GROUP BY user_id")
def r4_batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = idle_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 60)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
