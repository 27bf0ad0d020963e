"""Named queries over predicates, aggregations, order, sets and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexmill.functions import dates as D, text as T
from lexmill.operators import ordered, tabular
from lexmill.plans.common import fixture, sql_fold, values
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


# ---- predicates and projections


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_mktsegment), 'build') AND contains(lower(o_orderpriority), 'urgent') AND contains(lower(n_name), 'n')")
def pred1_contains_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.where(tabular.contains_all({"c_mktsegment": "BUILD", "o_orderpriority": "Urgent", "n_name": "N"})).select("o_orderkey", "c_name", "n_name")


@query("SELECT ref_id FROM (SELECT DISTINCT ref_id, title, container, doi FROM refs) WHERE container = 'Rev. mar. law' OR contains(lower(title), 'franchise')")
def pred2_case_match(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").select("ref_id", "title", "container", "doi").distinct()
    return r.where(F.col("container").eqNullSafe("Rev. mar. law") | F.lower("title").contains("franchise")).select("ref_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'st') OR contains(lower(p_brand), 'st') OR contains(lower(p_type), 'st')")
def pred3_any_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(tabular.any_contains(["p_name", "p_brand", "p_type"], "ST")).select("p_partkey")


@query("SELECT DISTINCT ref_id, year FROM refs WHERE year BETWEEN 2001 AND 2010")
def pred4_year_range(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").withColumn("y", F.col("year").cast("string"))
    return r.where(tabular.in_years(F.col("y"), "2001-2010")).select("ref_id", "year").distinct()


@query("SELECT DISTINCT party_id, role FROM parties WHERE role <> ''")
def pred5_filled_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parties").where(F.col("role") != "").select("party_id", "role").distinct()


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def pred6_projection(spark: SparkSession, d: str) -> DataFrame:
    return tabular.project(table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_acctbal"])


_HEADERS = [(1, "Invoice_No", "A1"), (1, " invoice   number ", "A2"), (1, "Foo", "x"), (2, "TIMEKEEPER", "kim"), (2, "Hours", ""), (2, "Bar", ""), (3, "Description", "call"), (3, "Zed", "9"), (3, "Alpha", "b")]
# Headers and the canonical field each stands for.
ALIASES = {"invoice no": "invoice_number", "invoice number": "invoice_number", "timekeeper": "timekeeper_name", "hours": "hours", "description": "narrative"}
_NORM = r"trim(regexp_replace(replace(lower(header), '_', ' '), ' +', ' ', 'g'))"


@query(f"""WITH r AS (SELECT row_number() OVER () AS pos, * FROM {values(_HEADERS, 'id, header, value')}), m AS (SELECT r.*, a.field FROM (SELECT *, {_NORM} AS h FROM r) r LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ALIASES.items())}) a(h, field) ON r.h = a.h)
 SELECT id, arg_max(value, pos) FILTER (field = 'invoice_number') AS invoice_number, arg_max(value, pos) FILTER (field = 'timekeeper_name') AS timekeeper_name, arg_max(value, pos) FILTER (field = 'hours') AS hours,
 concat_ws(' | ', arg_max(value, pos) FILTER (field = 'narrative'), string_agg(header || '=' || value, ' | ' ORDER BY pos) FILTER (field IS NULL AND value <> '')) AS narrative FROM m GROUP BY id""")
def pred8_header_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = fixture(spark, [(k, *r) for k, r in enumerate(_HEADERS)], "pos int, id int, header string, value string")
    return tabular.canonical_rows(cells, ALIASES, ["invoice_number", "timekeeper_name", "hours", "narrative"])


_TARIFF = [(1, "0101", 0, "Live horses"), (2, "0101.21", 1, "Pure-bred"), (3, "", 1, "Other"), (4, "0101.29", 2, "For slaughter"), (5, "0102", 0, "Bovine"), (6, "0102.21", 1, "Pure-bred"), (7, "0103", 0, "Swine"), (8, "0101.90", 0, "late")]


@query(f"SELECT idx, code, indent FROM {values(_TARIFF, 'idx, code, indent, name')} t WHERE idx >= (SELECT min(idx) FROM {values(_TARIFF, 'idx, code, indent, name')} WHERE starts_with(code, '0101')) AND idx < coalesce((SELECT min(idx) FROM {values(_TARIFF, 'idx, code, indent, name')} WHERE code <> '' AND NOT starts_with(code, '0101') AND idx > (SELECT min(idx) FROM {values(_TARIFF, 'idx, code, indent, name')} WHERE starts_with(code, '0101'))), 1000)")
def pred9_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return tabular.heading_rows(fixture(spark, _TARIFF, "idx int, code string, indent int, name string"), "0101").select("idx", "code", "indent")


_FILES = ["a/b.py", "Makefile", "requirements.txt", "x/package.json", ".github/workflows/ci.yml", "README.md", "logo.png", "lib.so", "notes", "src/App.TS"]


@query(f"""SELECT path, CASE WHEN regexp_matches(lower(path), '[.](png|jpg|so|exe|dll|zip)$') THEN 'binary' WHEN regexp_matches(lower(path), '(^|/)(requirements[.]txt|package[.]json|pyproject[.]toml|go[.]mod)$') THEN 'dependency' WHEN contains(path, '.github/workflows/') THEN 'workflow'
 WHEN regexp_matches(lower(path), '[.](py|js|ts|sh|rb|go)$') THEN 'code' WHEN regexp_matches(lower(path), '[.]md$') THEN 'markdown' ELSE 'other' END AS kind FROM {values([(f,) for f in _FILES], 'path')}""")
def pred13_file_kind(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, [(f,) for f in _FILES], "path string").select("path", tabular.file_kind(F.col("path")).alias("kind"))


@query("SELECT matter_id, CASE WHEN nullif(trim(attorney), '') IS NULL THEN false ELSE true END AS has_attorney, coalesce(nullif(trim(attorney), ''), nullif(trim(matter), ''), '?') AS shown FROM matters")
def pred17_first_present(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "matters")
    return m.select("matter_id", F.nullif(F.trim("attorney"), F.lit("")).isNotNull().alias("has_attorney"), F.coalesce(T.first_present(F.col("attorney"), F.col("matter")), F.lit("?")).alias("shown"))


@query("""SELECT DISTINCT party_id, array_to_string(list_filter([CASE WHEN coalesce(name, '') = '' THEN 'name' END, CASE WHEN coalesce(role, '') = '' THEN 'role' END, CASE WHEN coalesce(type, '') = '' THEN 'type' END], lambda x: x IS NOT NULL), ',') AS missing FROM parties WHERE coalesce(name, '') = '' OR coalesce(role, '') = '' OR coalesce(type, '') = ''""")
def pred18_missing_required(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parties").withColumn("m", tabular.missing(["name", "role", "type"]))
    return p.where(F.size("m") > 0).select("party_id", F.array_join("m", ",").alias("missing")).distinct()


# ---- aggregations


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word")
def a1_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return tabular.value_counts(table(spark, d, "part"), "p_type", " ", "word")


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders")
def a2_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))


@query("SELECT doc_id, count(*) FILTER (block_type = 'heading') AS headings, count(*) FILTER (block_type = 'paragraph') AS paragraphs, count(*) FILTER (block_type = 'list_item') AS items, count(*) FILTER (block_type = 'table_row') AS table_rows FROM (SELECT DISTINCT doc_id, idx, block_type FROM blocks) GROUP BY doc_id")
def a9_block_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select("doc_id", "idx", "block_type").distinct()
    of = lambda k: F.count_if(F.col("block_type") == k)
    return b.groupBy("doc_id").agg(of("heading").alias("headings"), of("paragraph").alias("paragraphs"), of("list_item").alias("items"), of("table_row").alias("table_rows"))


@query("SELECT block_type, lang, max(length(text)) AS longest FROM blocks GROUP BY ROLLUP (block_type, lang)")
def a10_rollup_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").rollup("block_type", "lang").agg(F.max(F.length("text")).cast("long").alias("longest"))


@query("""WITH b AS (SELECT DISTINCT doc_id, idx, coalesce(lang, 'und') AS lang, length(text) AS n FROM blocks WHERE text IS NOT NULL AND length(text) > 0), l AS (SELECT doc_id, lang, sum(n) AS chars FROM b GROUP BY doc_id, lang)
 SELECT doc_id, arg_max(lang, {'c': chars, 'l': lang}) AS dominant, CAST(count(*) AS BIGINT) AS languages, CAST(sum(chars) AS BIGINT) AS chars, CAST(max(chars) AS DOUBLE) / CAST(sum(chars) AS DOUBLE) AS share FROM l GROUP BY doc_id""")
def a11_language_shares(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where(F.length("text") > 0).select("doc_id", "idx", F.coalesce("lang", F.lit("und")).alias("lang"), F.length("text").alias("n")).distinct()
    per = b.groupBy("doc_id", "lang").agg(F.sum("n").alias("chars"))
    return per.groupBy("doc_id").agg(F.max_by("lang", F.struct("chars", "lang")).alias("dominant"), F.count(F.lit(1)).alias("languages"), F.sum("chars").alias("chars"), (F.max("chars") / F.sum("chars")).alias("share"))


# Terms of each profile.
PROFILES = {"contract": ("Agreement", "clause", "Schedule"), "litigation": ("Court", "Tribunal", "judg"), "corporate": ("shares", "share register", "board")}


@query("SELECT doc_id, profile, score, score >= 0.34 AS active FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS profile, least(round_even(({' + '.join(f'CAST(contains(text, {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in ws)}) / 3.0, 2), 1.0) AS score FROM documents WHERE text IS NOT NULL" for p, ws in PROFILES.items()) + ") WHERE score > 0")
def a12_profile_score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    score = lambda ws: F.least(F.bround(reduce(lambda a, b: a + b, [F.col("text").contains(w).cast("int") for w in ws]) / 3.0, 2), F.lit(1.0))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), score(ws).alias("score")) for p, ws in PROFILES.items()]))
    return docs.select("doc_id", each.alias("x")).select("doc_id", "x.*").where("score > 0").withColumn("active", F.col("score") >= 0.34)


@query("""SELECT section, pos, ref_id, title FROM (SELECT section, ref_id, title, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 1 THEN -year END, lower(title), ref_id) AS pos FROM (
 SELECT CASE WHEN doc_type = 'THESE' THEN 1 WHEN doc_type = 'OUV' THEN 2 ELSE 3 END AS section, ref_id, title, year FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY ref_id) AS k FROM (SELECT DISTINCT ref_id, title, year, doc_type FROM refs WHERE title IS NOT NULL AND year IS NOT NULL)) WHERE k = 1))""")
def a13_bibliography(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").where("title IS NOT NULL AND year IS NOT NULL").select("ref_id", "title", "year", "doc_type").distinct()
    one = r.groupBy(F.lower("title").alias("k")).agg(F.min_by(F.struct("ref_id", "title", "year", "doc_type"), "ref_id").alias("r")).select("r.*")
    s = one.withColumn("section", F.when(F.col("doc_type") == "THESE", 1).when(F.col("doc_type") == "OUV", 2).otherwise(3))
    # Theses stand by year, then title; numbers come from counts of portions, so no section is one task.
    portion = F.struct(F.when(F.col("section") == 1, -F.col("year")).alias("y"), F.substring("k", 1, 2).alias("a"))
    rows = s.withColumn("k", F.lower("title")).withColumn("neg", F.when(F.col("section") == 1, -F.col("year")))
    return ordered.running_number(rows, "section", ["neg", "k", "ref_id"], portion, "pos").select("section", F.col("pos").cast("int").alias("pos"), "ref_id", "title")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS occurrences, array_to_string(list_sort(list_distinct(list(user_id)))[1:3], ',') AS examples FROM events GROUP BY event_type")
def a14_groups_with_examples(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and the three smallest distinct examples, found without gathering a group."""
    e = table(spark, d, "events")
    seen = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    first = seen.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))).where("k <= 3").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("user_id")), ",").alias("examples"))
    return seen.groupBy("event_type").agg(F.sum("n").alias("occurrences")).join(first, "event_type")


@query("SELECT d.source, doc_id, n_chars FROM documents d JOIN (SELECT source, median(n_chars) AS m, count(*) AS k FROM documents WHERE text IS NOT NULL GROUP BY source) s USING (source) WHERE text IS NOT NULL AND k >= 3 AND n_chars < 0.5 * m")
def a15_short_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Texts of less than half their source's median length. The median is exact: lengths are counted, and the counts summed in portions."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("source", "doc_id", "n_chars")
    counts = docs.where("n_chars IS NOT NULL").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    upto = ordered.running_sum(counts, "source", ["n_chars"], F.floor(F.col("n_chars") / 256), F.col("n"), "upto")
    size = docs.groupBy("source").agg(F.count(F.lit(1)).alias("k"), F.count("n_chars").alias("filled")).where("k >= 3").withColumnRenamed("source", "s")
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("n_chars")))
    m = upto.join(size, F.col("source") == F.col("s")).groupBy("source").agg(((at(F.floor((F.col("filled") + 1) / 2)) + at(F.floor(F.col("filled") / 2) + 1)) / 2).alias("m"))
    return docs.join(m, "source").where("n_chars < 0.5 * m").select("source", "doc_id", "n_chars")


@query("SELECT doc_id, arg_max(level, {'n': n, 'f': -first}) AS level FROM (SELECT doc_id, level, count(*) AS n, min(idx) AS first FROM (SELECT DISTINCT doc_id, idx, level FROM blocks WHERE block_type = 'heading') GROUP BY doc_id, level) GROUP BY doc_id")
def a16_modal_level(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "blocks").where("block_type = 'heading'").select("doc_id", "idx", "level").distinct()
    per = h.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return per.groupBy("doc_id").agg(F.max_by("level", F.struct("n", -F.col("first"))).alias("level"))


@query("SELECT lang, arg_max(source_format, {'n': n, 'f': source_format}) AS usual FROM (SELECT lang, source_format, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source_format IS NOT NULL GROUP BY lang, source_format) GROUP BY lang")
def a17_most_used(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("lang IS NOT NULL AND source_format IS NOT NULL").groupBy("lang", "source_format").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang").agg(F.max_by("source_format", F.struct("n", "source_format")).alias("usual"))


@query("SELECT source, count(*) AS docs, count(*) FILTER (doc_date IS NULL) AS no_date, count(*) FILTER (matter_id IS NULL) AS no_matter, bool_and(doc_date IS NOT NULL AND matter_id IS NOT NULL) AS ready FROM documents GROUP BY source")
def a20_completeness(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.count_if(F.col(c).isNull())
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), none("doc_date").alias("no_date"), none("matter_id").alias("no_matter"), F.bool_and(F.col("doc_date").isNotNull() & F.col("matter_id").isNotNull()).alias("ready"))


@query("""SELECT 'duplicate' AS finding, ref_id AS n FROM refs GROUP BY ref_id HAVING count(*) > 1 UNION ALL SELECT 'missing', r.n FROM (SELECT unnest(range(1, (SELECT max(ref_id) + 3 FROM refs))) AS n) r ANTI JOIN refs ON refs.ref_id = r.n""")
def a21_range_findings(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an expected range that are missing or stand twice; the range is made by the cluster, not the driver."""
    r = table(spark, d, "refs").select(F.col("ref_id").alias("n"))
    most = r.agg(F.max("n")).first()[0] or 0
    twice = r.groupBy("n").count().where("count > 1").select(F.lit("duplicate").alias("finding"), "n")
    gone = spark.range(1, most + 3).withColumnRenamed("id", "n").join(r, "n", "left_anti").select(F.lit("missing").alias("finding"), "n")
    return twice.unionByName(gone)


@query("SELECT doc_id, count(*) = max(idx) + 1 AND min(idx) = 0 AS in_order, CAST(count(*) AS BIGINT) AS blocks FROM (SELECT DISTINCT doc_id, idx FROM blocks) GROUP BY doc_id")
def a22_sequence_complete(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select("doc_id", "idx").distinct()
    return b.groupBy("doc_id").agg(((F.count(F.lit(1)) == F.max("idx") + 1) & (F.min("idx") == 0)).alias("in_order"), F.count(F.lit(1)).alias("blocks"))


@query("SELECT matter_id, bool_or(doc_date IS NOT NULL) AND NOT bool_and(doc_date IS NOT NULL) AS inconsistent, count(*) FILTER (doc_date IS NULL) AS undated FROM documents WHERE matter_id IS NOT NULL GROUP BY matter_id")
def a24_series_consistency(spark: SparkSession, d: str) -> DataFrame:
    has = F.col("doc_date").isNotNull()
    return table(spark, d, "documents").where("matter_id IS NOT NULL").groupBy("matter_id").agg((F.bool_or(has) & ~F.bool_and(has)).alias("inconsistent"), F.count_if(~has).alias("undated"))


# ---- order


@query("SELECT source, doc_id, upper(left(source, 1)) || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY received_at, doc_id) AS VARCHAR), 6, '0') AS code FROM documents WHERE source IS NOT NULL")
def w1_running_ids(spark: SparkSession, d: str) -> DataFrame:
    """A running number per source; numbers come from counts of hash-ordered portions, so a hot source is many tasks."""
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("source", "doc_id", "received_at")
    return ordered.running_number(docs, "source", ["received_at", "doc_id"], ordered.by_day("received_at"), "n").select("source", "doc_id", F.concat(F.upper(F.substring("source", 1, 1)), F.lpad(F.col("n").cast("string"), 6, "0")).alias("code"))


@query("SELECT doc_id, idx, greatest(idx - 1, 0) AS before, idx + 1 AS after FROM (SELECT DISTINCT doc_id, idx FROM blocks)")
def w4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").select("doc_id", "idx").distinct().select("doc_id", "idx", F.greatest(F.col("idx") - 1, F.lit(0)).alias("before"), (F.col("idx") + 1).alias("after"))


_MD = [("a", 1, "# T"), ("a", 2, "```py"), ("a", 3, "x = 1"), ("a", 4, "```"), ("a", 5, "end"), ("b", 1, "  ```"), ("b", 2, "open"), ("c", 1, "none")]


@query(f"SELECT file, line_no, (sum(CAST(starts_with(trim(line), '```') AS INTEGER)) OVER (PARTITION BY file ORDER BY line_no) % 2 = 1) OR starts_with(trim(line), '```') AS fenced FROM {values(_MD, 'file, line_no, line')}")
def w5_fence_mask(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.operators.rules import in_fence

    return in_fence(fixture(spark, _MD, "file string, line_no int, line string"), "file").select("file", "line_no", "fenced")


@query("SELECT doc_id, idx, last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS heading FROM (SELECT doc_id, idx, any_value(block_type) AS block_type, any_value(text) AS text FROM blocks GROUP BY doc_id, idx)")
def w6_heading_carry_down(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").groupBy("doc_id", "idx").agg(F.any_value("block_type").alias("block_type"), F.any_value("text").alias("text"))
    return ordered.carry_down(b, "doc_id", "idx", F.when(F.col("block_type") == "heading", F.col("text")), "heading").select("doc_id", "idx", "heading")


@query(f"SELECT a.idx, max(b.idx) AS parent FROM {values(_TARIFF, 'idx, code, indent, name')} a LEFT JOIN {values(_TARIFF, 'idx, code, indent, name')} b ON b.idx < a.idx AND b.indent < a.indent GROUP BY a.idx")
def w7_indent_parent(spark: SparkSession, d: str) -> DataFrame:
    t = fixture(spark, _TARIFF, "idx int, code string, indent int, name string").withColumn("tree", F.lit(1))
    return ordered.nearest_smaller(t, "tree", "idx", "indent", "parent").select("idx", "parent")


_PIECES = [(1, 1, "ins", "ab"), (1, 2, "del", "ac"), (1, 3, "regular", "two words"), (1, 4, "ins", "x"), (1, 5, "regular", "y"), (2, 1, "ins", "q"), (2, 2, "ins", "r"), (3, 1, "del", "long text here"), (3, 2, "ins", "z"), (3, 3, "del", "w")]


@query(f"""WITH s AS (SELECT *, contains(part, ' ') OR length(part) > 60 AS brk FROM {values(_PIECES, 'para, seg, kind, part')}), g AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY para ORDER BY seg) AS grp FROM s)
 SELECT para, min(seg) AS first_seg, max(seg) AS last_seg, string_agg(part, '' ORDER BY seg) AS joined FROM g WHERE NOT brk GROUP BY para, grp HAVING count(*) FILTER (kind = 'ins') >= 1 AND count(*) FILTER (kind = 'del') >= 1""")
def w9_fragment_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = fixture(spark, _PIECES, "para int, seg int, kind string, part string").withColumn("brk", F.col("part").contains(" ") | (F.length("part") > 60))
    g = ordered.islands(s, "para", "seg", F.col("brk"), "grp").where("NOT brk").groupBy("para", "grp")
    out = g.agg(F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part"))), lambda x: x["part"]), "").alias("joined"), F.count_if(F.col("kind") == "ins").alias("i"), F.count_if(F.col("kind") == "del").alias("x"))
    return out.where("i >= 1 AND x >= 1").select("para", "first_seg", "last_seg", "joined")


@query(r"SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) AS run FROM (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE text IS NOT NULL)) GROUP BY run")
def w11_capital_runs(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("text IS NOT NULL").select("doc_id", "idx", "text").distinct()
    return b.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), 0)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, count(DISTINCT doc_id) AS docs, bool_or(coalesce(role, '') <> '') AS has_role, min(party_id) AS first_id FROM parties WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT doc_id) >= 2")
def w12_mention_frequency(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parties").where("name IS NOT NULL").groupBy("name").agg(F.count_distinct("doc_id").alias("docs"), F.bool_or(F.coalesce("role", F.lit("")) != "").alias("has_role"), F.min("party_id").alias("first_id"))
    return p.where("docs >= 2")


@query(r"SELECT doc_id, max(TRY_CAST(x AS DATE)) AS latest, count(TRY_CAST(x AS DATE)) AS dates FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS x FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def w13_latest_date(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), 0), lambda x: F.try_to_date(x, "yyyy-MM-dd")).alias("x")).where("size(x) > 0")
    return found.select("doc_id", F.array_max("x").alias("latest"), F.size(F.filter("x", lambda x: x.isNotNull())).cast("long").alias("dates"))


@query("SELECT container, ref_id FROM (SELECT container, ref_id, row_number() OVER (PARTITION BY container ORDER BY CASE WHEN doi IS NOT NULL AND year IS NOT NULL THEN 1 WHEN doi IS NOT NULL THEN 2 WHEN year IS NOT NULL THEN 3 ELSE 4 END, year DESC NULLS LAST, ref_id) AS k FROM (SELECT DISTINCT container, ref_id, doi, year FROM refs WHERE container IS NOT NULL)) WHERE k = 1")
def w14_latest_by_tier(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").where("container IS NOT NULL")
    level = F.when(F.col("doi").isNotNull() & F.col("year").isNotNull(), 1).when(F.col("doi").isNotNull(), 2).when(F.col("year").isNotNull(), 3).otherwise(4)
    return r.groupBy("container").agg(F.min_by("ref_id", F.struct(level.alias("t"), (-F.coalesce("year", F.lit(-9999))).alias("y"), "ref_id")).alias("ref_id"))


@query("""SELECT user_id, CAST(n AS BIGINT) AS session, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
 SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, n""")
def w16_idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ordered.idle_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 60)


@query("SELECT user_id, ts, next_ts FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events) WHERE next_ts - ts > INTERVAL 24 HOUR")
def w18_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = ordered.next_time(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", "next_ts")
    return e.where("next_ts - ts > INTERVAL '24' HOUR").select("user_id", "ts", "next_ts")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY received_at DESC NULLS LAST, doc_id) AS k FROM documents WHERE source IS NOT NULL) WHERE k <= 5")
def l5_newest_per_source(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.col("received_at").desc_nulls_last(), "doc_id")
    return table(spark, d, "documents").where("source IS NOT NULL").withColumn("k", F.row_number().over(w)).where("k <= 5").select("source", "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL) WHERE k <= CASE WHEN n <= 5 THEN n ELSE 5 + ceil(n * 0.1) END")
def l6_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of each source five rows and a tenth, all of small ones; the same rows in every run."""
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("source", "doc_id")
    size = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    hashed = docs.withColumn("h", F.md5(F.col("doc_id").cast("string")))
    numbered = ordered.running_number(hashed, "source", ["h", "doc_id"], F.substring("h", 1, 2), "k")
    return numbered.join(size, "source").where(F.col("k") <= F.when(F.col("n") <= 5, F.col("n")).otherwise(5 + F.ceil(F.col("n") * 0.1))).select("source", "doc_id")


@query("SELECT container, round(sum(n) FILTER (k <= 3) * 1.0 / sum(n), 6) AS top3_share FROM (SELECT container, year, count(*) AS n, row_number() OVER (PARTITION BY container ORDER BY count(*) DESC, year) AS k FROM (SELECT DISTINCT container, year, ref_id FROM refs WHERE container IS NOT NULL AND year IS NOT NULL) GROUP BY container, year) GROUP BY container")
def l7_top_concentration(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "refs").where("container IS NOT NULL AND year IS NOT NULL").select("container", "year", "ref_id").distinct().groupBy("container", "year").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("container").orderBy(F.col("n").desc(), "year")))
    return c.groupBy("container").agg(F.round(F.sum(F.when(F.col("k") <= 3, F.col("n"))) / F.sum("n"), 6).alias("top3_share"))


# ---- sets and joins


@query(r"""WITH r AS (SELECT ref_id, any_value(title) AS title, any_value(doi) AS doi, any_value(open_access_url) AS url, any_value(sources) AS sources FROM refs GROUP BY ref_id), k AS (SELECT *, lower(doi) AS key FROM r WHERE regexp_matches(lower(doi), '^10[.][0-9]{4,9}/[^ ]+$'))
 SELECT key, arg_min(title, ref_id) FILTER (title IS NOT NULL) AS title, arg_min(url, ref_id) FILTER (url IS NOT NULL) AS url, array_to_string(list_sort(list_distinct(flatten(list(coalesce(sources, []))))), ',') AS sources FROM k GROUP BY key""")
def u1_merge_sources(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").groupBy("ref_id").agg(F.any_value("title").alias("title"), F.any_value("doi").alias("doi"), F.any_value("open_access_url").alias("url"), F.any_value("sources").alias("sources"))
    k = r.where(F.lower("doi").rlike(r"^10[.][0-9]{4,9}/[^ ]+$")).withColumn("key", F.lower("doi"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ref_id")))
    scalar = k.groupBy("key").agg(first("title").alias("title"), first("url").alias("url"))
    joined = k.select("key", F.explode_outer("sources").alias("s")).distinct().groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("sources"))
    return scalar.join(joined, "key")


@query("SELECT matter_id, 'no documents' AS finding FROM matters ANTI JOIN documents USING (matter_id) UNION ALL SELECT DISTINCT matter_id, 'unknown matter' FROM documents ANTI JOIN matters USING (matter_id) WHERE matter_id IS NOT NULL")
def u2_set_differences(spark: SparkSession, d: str) -> DataFrame:
    m, docs = table(spark, d, "matters").select("matter_id"), table(spark, d, "documents").where("matter_id IS NOT NULL").select("matter_id").distinct()
    return m.join(docs, "matter_id", "left_anti").select("matter_id", F.lit("no documents").alias("finding")).unionByName(docs.join(F.broadcast(m), "matter_id", "left_anti").select("matter_id", F.lit("unknown matter").alias("finding")))


_OPS = [(1, "off", 2, 5), (2, "on", 3, 3), (3, "off", 9, 9), (4, "on", 5, 6)]


@query(f"SELECT n FROM (SELECT n, arg_max(what, step) AS what FROM (SELECT step, what, unnest(range(first, last + 1)) AS n FROM {values(_OPS, 'step, what, first, last')}) GROUP BY n) WHERE what = 'off'")
def u4_toggle_sets(spark: SparkSession, d: str) -> DataFrame:
    """Numbers switched off after all range commands, the last command on a number standing."""
    o = fixture(spark, _OPS, "step int, what string, first int, last int")
    n = o.select("step", "what", F.explode(F.sequence("first", "last")).alias("n")).groupBy("n").agg(F.max_by("what", "step").alias("what"))
    return n.where("what = 'off'").select(F.col("n").cast("long").alias("n"))


@query("SELECT m.matter_id, count(*) AS documents FROM matters m JOIN documents d ON m.matter_id = d.matter_id GROUP BY m.matter_id")
def j1_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("matter_id IS NOT NULL").groupBy("matter_id").agg(F.count(F.lit(1)).alias("documents"))
    return docs.join(F.broadcast(table(spark, d, "matters").select("matter_id")), "matter_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM parties)")
def j2_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "parties").select("doc_id"), "doc_id", "left_semi")


@query("SELECT party_id, doc_id FROM (SELECT DISTINCT party_id, doc_id FROM parties) ANTI JOIN (SELECT DISTINCT doc_id FROM blocks) b USING (doc_id)")
def j4_unresolved(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parties").select("party_id", "doc_id").distinct()
    return p.join(table(spark, d, "blocks").select("doc_id").distinct(), "doc_id", "left_anti").select("party_id", "doc_id")


@query(f"SELECT DISTINCT p.party_id FROM parties p JOIN (SELECT unnest(authors) AS a FROM refs) r ON lower({sql_fold('p.name')}) = lower({sql_fold('r.a')})")
def j6_corroborated(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.lower(T.fold(F.col(c)))
    p = table(spark, d, "parties").where("name IS NOT NULL").select("party_id", key("name").alias("k")).distinct()
    a = table(spark, d, "refs").select(F.explode("authors").alias("a")).where("a IS NOT NULL").select(key("a").alias("k"))
    return p.join(a.distinct(), "k", "left_semi").select("party_id")


_SUBJECTS = [(1, "Acme Holdings"), (2, "Holdings"), (3, "the Acme Holdings"), (4, "Beta"), (5, "Alpha Beta Gamma"), (6, "Gamma")]


@query(f"SELECT a.id, b.id AS other FROM {values(_SUBJECTS, 'id, name')} a JOIN {values(_SUBJECTS, 'id, name')} b ON a.id <> b.id AND (a.name = b.name OR ends_with(a.name, ' ' || b.name) OR ends_with(b.name, ' ' || a.name))")
def j8_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    """Names of which one is the other's end; every end of a name is a key, so the join is an equi-join."""
    return tabular.suffix_pairs(fixture(spark, _SUBJECTS, "id int, name string"))


@query("SELECT e.event_id, CAST(count(p.event_id) AS BIGINT) AS earlier FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'signup' AND (p.ts, p.event_id) < (e.ts, e.event_id) GROUP BY e.event_id")
def j9_earlier_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many sign-ups of the user came before each event: an as-of count by one running sum, not a range join."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    hit = F.coalesce((F.col("event_type") == "signup").cast("long"), F.lit(0))
    return ordered.running_sum(e, "user_id", ["ts", "event_id"], ordered.by_day("ts"), hit, "earlier", own=False).select("event_id", "earlier")


# Aliases of instruments with their hint words.
ALIAS_ROWS = (("gdpr", "General Data Protection Regulation", ("data", "personal")), ("rome1", "Rome I", ("contract", "law")), ("cisg", "CISG", ("sale", "goods")))


@query("SELECT DISTINCT doc_id, alias, score FROM (SELECT doc_id, alias, 10 * CAST(contains(lower(text), lower(name)) AS INTEGER) + " + "CAST(contains(lower(text), h1) AS INTEGER) + CAST(contains(lower(text), h2) AS INTEGER) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY 10 * CAST(contains(lower(text), lower(name)) AS INTEGER) + CAST(contains(lower(text), h1) AS INTEGER) + CAST(contains(lower(text), h2) AS INTEGER) DESC, alias) AS k FROM documents, (VALUES " + ", ".join(f"('{a}', '{n}', '{h[0]}', '{h[1]}')" for a, n, h in ALIAS_ROWS) + ") x(alias, name, h1, h2) WHERE text IS NOT NULL) WHERE k = 1 AND score > 0")
def j10_alias_ranking(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    scored = [F.struct((10 * low.contains(n.lower()).cast("int") + sum((low.contains(w).cast("int") for w in h), F.lit(0))).alias("score"), F.lit(a).alias("alias")) for a, n, h in ALIAS_ROWS]
    best = F.sort_array(F.array(*[F.struct((-s["score"]).alias("neg"), s["alias"].alias("alias")) for s in scored])).getItem(0)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", best["alias"].alias("alias"), (-best["neg"]).alias("score")).where("score > 0")


#: Reference ids in one posting of the index at most.
POSTING = 1024


@query(f"SELECT source, CAST(floor(ref_id / {POSTING}.0) AS BIGINT) AS bucket, array_to_string(list_sort(list(DISTINCT ref_id)), ',') AS refs FROM (SELECT ref_id, unnest(sources) AS source FROM refs WHERE ref_id IS NOT NULL) GROUP BY source, bucket")
def j11_postings(spark: SparkSession, d: str) -> DataFrame:
    """The index over all rows: a source's references in ranges of POSTING ids, so a hot source is many short lists."""
    r = table(spark, d, "refs").where("ref_id IS NOT NULL").select("ref_id", F.explode("sources").alias("source")).distinct().withColumn("bucket", F.floor(F.col("ref_id") / POSTING))
    return r.groupBy("source", "bucket").agg(F.array_join(F.array_sort(F.collect_list("ref_id")), ",").alias("refs"))


_ACTS = [("K.C.",), ("kc",), ("ksh",), ("k.s.h.",), ("xx",)]


@query(f"SELECT raw, CASE rtrim(replace(lower(raw), '.', ''), '.') WHEN 'kc' THEN 'civil code' WHEN 'ksh' THEN 'companies code' END AS act FROM {values(_ACTS, 'raw')}")
def j15_act_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = fixture(spark, [("kc", "civil code"), ("ksh", "companies code")], "code string, act string")
    a = fixture(spark, _ACTS, "raw string").withColumn("code", F.replace(F.lower("raw"), F.lit("."), F.lit("")))
    return a.join(F.broadcast(codes), "code", "left").select("raw", "act")


@query("SELECT d.doc_id, sha256(coalesce(d.text, '')) AS actual FROM documents d")
def d14_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("actual"))


_ROUTES = [("/work", "m0"), ("/work/acme", "m1"), ("/work/acme/spa", "m2"), ("/home", "m3")]
_PATHS = [(1, "/work/acme/spa/draft"), (2, "/work/acme"), (3, "/work/zeta"), (4, "/tmp"), (5, "/home")]


@query(f"SELECT id, arg_max(matter, length(prefix)) AS matter FROM {values(_PATHS, 'id, cwd')} LEFT JOIN {values(_ROUTES, 'prefix, matter')} ON cwd = prefix OR starts_with(cwd, prefix || '/') GROUP BY id")
def j19_prefix_routing(spark: SparkSession, d: str) -> DataFrame:
    """The longest matching prefix; every prefix of a path is a key, so the join is an equi-join."""
    return tabular.longest_prefix(fixture(spark, _PATHS, "id int, cwd string"), "cwd", fixture(spark, _ROUTES, "prefix string, matter string"), "prefix").select("id", "matter")


# ---- dates and identifiers


_DATES = [(1, "2024-02-29"), (2, "31.02.2028"), (3, "5.3.2021"), (4, "07/11/2019"), (5, "3 maja 2020 r."), (6, "1er janvier 2022"), (7, "March 9, 2023"), (8, "12 October 2024"), (9, "soon"), (10, None)]
_MONTHS_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in D.MONTHS.items()) + "}"


def _rx(p: str, k: int) -> str:
    return f"regexp_extract(trim(x), '{p}', {k})"


_ISO, _DOT, _SLASH = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
_DAYF, _MONF = r"^([0-9]{1,2})(?:er)? (\p{L}+) ([0-9]{4})(?: r\.)?$", r"^(\p{L}+) ([0-9]{1,2}), ([0-9]{4})$"


@query(f"""SELECT id, TRY_CAST(CASE WHEN regexp_matches(trim(x), '{_ISO}') THEN {_rx(_ISO, 1)} || '-' || lpad({_rx(_ISO, 2)}, 2, '0') || '-' || lpad({_rx(_ISO, 3)}, 2, '0') WHEN regexp_matches(trim(x), '{_DOT}') THEN {_rx(_DOT, 3)} || '-' || lpad({_rx(_DOT, 2)}, 2, '0') || '-' || lpad({_rx(_DOT, 1)}, 2, '0')
 WHEN regexp_matches(trim(x), '{_SLASH}') THEN {_rx(_SLASH, 3)} || '-' || lpad({_rx(_SLASH, 2)}, 2, '0') || '-' || lpad({_rx(_SLASH, 1)}, 2, '0') WHEN regexp_matches(trim(x), '{_DAYF}') THEN {_rx(_DAYF, 3)} || '-' || lpad(CAST({_MONTHS_SQL}[lower({_rx(_DAYF, 2)})] AS VARCHAR), 2, '0') || '-' || lpad({_rx(_DAYF, 1)}, 2, '0')
 WHEN regexp_matches(trim(x), '{_MONF}') THEN {_rx(_MONF, 3)} || '-' || lpad(CAST({_MONTHS_SQL}[lower({_rx(_MONF, 1)})] AS VARCHAR), 2, '0') || '-' || lpad({_rx(_MONF, 2)}, 2, '0') END AS DATE) AS day FROM {values(_DATES, 'id, x')}""")
def d1_normalise_dates(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, _DATES, "id int, x string").select("id", D.normalise_date(F.col("x")).alias("day"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list(day))), ',') AS days FROM (SELECT doc_id, CAST(TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS VARCHAR) AS day FROM (SELECT doc_id, regexp_extract(x, '([0-9]{4})$', 1) AS y, list_position(['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'], regexp_extract(x, ' (\p{L}+) ', 1)) AS m, regexp_extract(x, '^([0-9]+)', 1) AS dd FROM (
 SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,2}(?:er)? (?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre) [0-9]{4}')) AS x FROM documents WHERE text IS NOT NULL))) WHERE day IS NOT NULL GROUP BY doc_id""")
def d2_french_dates(spark: SparkSession, d: str) -> DataFrame:
    names = "|".join(D.FR_MONTHS)
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[0-9]{{1,2}}(?:er)? (?:{names}) [0-9]{{4}}"), 0)).alias("x"))
    day = docs.select("doc_id", D.normalise_date(F.col("x")).cast("string").alias("day")).where("day IS NOT NULL").distinct()
    return day.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("day")), ",").alias("days"))


@query("SELECT doc_id, (CASE WHEN day(doc_date) = 1 THEN '1er' ELSE CAST(day(doc_date) AS VARCHAR) END) || ' ' || ['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'][month(doc_date)] || ' ' || CAST(year(doc_date) AS VARCHAR) AS written FROM documents WHERE doc_date IS NOT NULL")
def d6_french_written(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_date IS NOT NULL").select("doc_id", D.french_date(F.col("doc_date")).alias("written"))


@query("SELECT DISTINCT ref_id, date_diff('day', CAST(retrieved_at AS DATE), DATE '2026-01-01') > 90 AS stale FROM refs WHERE retrieved_at IS NOT NULL")
def d7_staleness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").where("retrieved_at IS NOT NULL").select("ref_id", D.stale(F.to_date("retrieved_at"), F.lit("2026-01-01").cast("date")).alias("stale")).distinct()


@query("""SELECT day, (SELECT x FROM (SELECT x, row_number() OVER (ORDER BY x) AS k FROM (SELECT CAST(unnest(range(day + INTERVAL 1 DAY, day + INTERVAL 40 DAY, INTERVAL 1 DAY)) AS DATE) AS x) WHERE isodow(x) < 6) WHERE k = 10) AS due, CASE isodow(day) WHEN 6 THEN day + 2 WHEN 7 THEN day + 1 ELSE day END AS rolled FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""")
def d8_business_days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", D.add_business_days(F.col("day"), 10).alias("due"), D.roll_forward(F.col("day")).alias("rolled"))


@query("SELECT o_orderkey, days, CAST(CAST(o_orderdate AS DATE) - days AS DATE) AS due FROM orders, (VALUES (49), (63), (91), (98), (126)) t(days)")
def d10_backward_deadlines(spark: SparkSession, d: str) -> DataFrame:
    days = F.explode(F.array(*[F.lit(k) for k in (49, 63, 91, 98, 126)]))
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), days.alias("days")).select("o_orderkey", "days", F.date_sub("day", F.col("days")).alias("due"))


@query("SELECT event_id, left(sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), CAST(CAST(ts AS DATE) AS VARCHAR))), 24) AS uid, left(sha256(event_type || chr(0) || CAST(user_id AS VARCHAR)), 16) AS fingerprint FROM events")
def d12_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", D.uid(F.col("event_type"), F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("uid"), D.fingerprint(F.col("event_type"), F.col("user_id").cast("string")).alias("fingerprint"))


@query(r"SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE TRY_CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) > 50")
def s26_json_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k > 50")


_UNITS = [(1, '{"units": ["kg", "No."], "addiitionalDuties": "5%"}'), (2, '{"units": "kg", "additionalDuties": "3%"}'), (3, "{}"), (4, "broken")]


@query(f"SELECT id, CASE WHEN json_valid(x) THEN CASE json_type(x, '$.units') WHEN 'ARRAY' THEN array_to_string(CAST(json_extract_string(x, '$.units[*]') AS VARCHAR[]), ',') ELSE json_extract_string(x, '$.units') END END AS units, CASE WHEN json_valid(x) THEN coalesce(json_extract_string(x, '$.additionalDuties'), json_extract_string(x, '$.addiitionalDuties')) END AS duties FROM {values(_UNITS, 'id, x')}")
def x4_list_or_scalar(spark: SparkSession, d: str) -> DataFrame:
    u = fixture(spark, _UNITS, "id int, x string")
    raw = F.get_json_object("x", "$.units")
    listed = F.array_join(F.from_json(raw, "array<string>"), ",")
    return u.select("id", F.when(raw.startswith("["), listed).otherwise(raw).alias("units"), F.coalesce(F.get_json_object("x", "$.additionalDuties"), F.get_json_object("x", "$.addiitionalDuties")).alias("duties"))
