"""Named queries of operators in their full width: citation kinds, name variants, headers, detectors, office files, streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexmill.functions import dates as D, text as T
from lexmill.operators.ordered import running_number
from lexmill.plans import harvest as H
from lexmill.plans.common import fixture, sql_fold, values
from lexmill.plans.files import _W, _zip
from lexmill.session import put_file, scratch, table
from lexmill.sources import files as S, sinks as K
from lexmill.streaming.sessions import append_new, new_lines, run_once

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


def _list(xs) -> str:
    return ", ".join(map(_q, xs))


# ---- office files

_RUNS = [
    (1, 1, '<w:r><w:rPr><w:b/></w:rPr><w:t>The </w:t></w:r>'), (1, 2, '<w:del w:id="1" w:author="Kim"><w:r><w:delText>seller</w:delText></w:r></w:del>'), (1, 3, '<w:ins w:id="2" w:author="Lee"><w:r><w:t>buyer</w:t></w:r></w:ins>'), (1, 4, "<w:r><w:t> pays.</w:t></w:r>"), (2, 1, '<w:ins w:id="3" w:author="Kim"><w:r><w:t>New.</w:t></w:r></w:ins>'), (3, 1, "<w:r><w:t>Same.</w:t></w:r>"),
]


def _tracked_docx() -> bytes:
    paras = "".join("<w:p>" + "".join(x for p, _, x in _RUNS if p == k) + "</w:p>" for k in sorted({p for p, _, _ in _RUNS}))
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{paras}</w:body></w:document>"})


@query(f"SELECT para, seg, CASE WHEN starts_with(xml, '<w:ins') THEN 'ins' WHEN starts_with(xml, '<w:del') THEN 'del' ELSE 'regular' END AS kind, nullif(regexp_extract(xml, 'w:author=\"([^\"]*)\"', 1), '') AS author, contains(xml, '<w:b/>') AS bold, regexp_extract(xml, '<w:(?:t|delText)>([^<]*)<', 1) AS text FROM {values(_RUNS, 'para, seg, xml')}")
def s12_tracked_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a word-processor file with their formatting, and who inserted or deleted them."""
    return S.read_tracked(spark.createDataFrame([("a.docx", bytearray(_tracked_docx()))], "path string, content binary")).drop("path")


_NOTES = [(0, "It applies.", None), (1, "A note.", "1"), (2, "Another <note>", "2")]


@query(f"SELECT CASE WHEN note IS NULL THEN text ELSE '[NOTE ' || note || '] ' || text END AS text FROM {values(_NOTES, 'idx, text, note')}")
def s11_tagged_notes(spark: SparkSession, d: str) -> DataFrame:
    """Text with footnotes after it, each tagged by its number."""
    esc = lambda t: t.replace("<", "&lt;").replace(">", "&gt;")
    p = lambda t: f"<w:p><w:r><w:t>{esc(t)}</w:t></w:r></w:p>"
    notes = "".join(f'<w:footnote w:id="{n}">{p(t)}</w:footnote>' for _, t, n in _NOTES if n)
    content = _zip({"word/document.xml": f"<w:document {_W}><w:body>{''.join(p(t) for _, t, n in _NOTES if not n)}</w:body></w:document>", "word/footnotes.xml": f"<w:footnotes {_W}>{notes}</w:footnotes>"})
    b = S.parse_documents(spark.createDataFrame([("a.docx", bytearray(content))], "path string, content binary"))
    return b.select(F.when(F.col("anchor").startswith("note "), F.concat(F.lit("[NOTE "), F.substring("anchor", 6, 9), F.lit("] "), "text")).otherwise(F.col("text")).alias("text"))


_EDITS = {"seller": "vendor", "pays": "shall pay"}
_PARAS = ["The seller pays.", "Nothing here.", "Each seller & buyer pays <now>."]


@query("SELECT CAST(idx AS INTEGER) AS idx, replace(replace(text, 'seller', 'vendor'), 'pays', 'shall pay') AS text FROM " + values(list(enumerate(_PARAS)), "idx, text"))
def k9_rewritten_docx(spark: SparkSession, d: str) -> DataFrame:
    """A word-processor file with edits applied to its text parts and packed again, read back."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    content = _zip({"word/document.xml": f"<w:document {_W}><w:body>{''.join(f'<w:p><w:r><w:t>{esc(t)}</w:t></w:r></w:p>' for t in _PARAS)}</w:body></w:document>", "word/other.xml": "<x/>"})
    files = spark.createDataFrame([("a.docx", bytearray(content))], "path string, content binary")
    return S.parse_documents(K.rewrite_docx(files, _EDITS)).select("idx", "text")


@query("SELECT 'csv' AS format, CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier UNION ALL SELECT 'json', CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def k1_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers written as delimited text and as JSON, and read back by the readers that tell the format."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name")
    path = scratch(spark)
    K.write_delimited(s, f"{path}/csv", ";")
    K.write_json(s, f"{path}/json")
    got = S.read_delimited(spark, f"{path}/csv").withColumn("format", F.lit("csv")).unionByName(spark.read.schema(s.schema).json(f"{path}/json").withColumn("format", F.lit("json")))
    return got.select("format", "s_suppkey", "s_name")


#: Most sheets, rows of a sheet and cells of a sheet before a code is set.
SHEETS, ROWS, CELLS = 2, 3, 7
_SHEET_ROWS = [(s, r, ["x"] * c) for s, rows in ((1, (2, 2, 2, 2)), (2, (4, 4)), (3, (1,))) for r, c in enumerate(rows, 1)]


@query(f"SELECT sheet, row_no, concat_ws(',', CASE WHEN sheet > {SHEETS} THEN 'SHEETS_TRUNCATED' END, CASE WHEN row_no > {ROWS} THEN 'ROWS_TRUNCATED' END, CASE WHEN sum(len(cells)) OVER (PARTITION BY sheet ORDER BY row_no) > {CELLS} THEN 'CELLS_TRUNCATED' END) AS codes FROM {values(_SHEET_ROWS, 'sheet, row_no, cells')}")
def s5_sheet_caps(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a workbook with the codes of the limits they lie beyond; they stay, for who wants them."""
    r = fixture(spark, _SHEET_ROWS, "sheet int, row_no int, cells array<string>").withColumn("upto", F.sum(F.size("cells")).over(Window.partitionBy("sheet").orderBy("row_no")))
    return r.select("sheet", "row_no", F.concat_ws(",", F.when(F.col("sheet") > SHEETS, "SHEETS_TRUNCATED"), F.when(F.col("row_no") > ROWS, "ROWS_TRUNCATED"), F.when(F.col("upto") > CELLS, "CELLS_TRUNCATED")).alias("codes"))


# ---- reports

@query("""SELECT l_orderkey, l_linenumber, '| ' || concat_ws(' | ', l_orderkey, l_linenumber, coalesce(nullif(CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'M|' || (l_orderkey % 10) END, ''), 'matter ' || l_orderkey % 10), l_partkey, l_returnflag, 'discount ' || CAST(CAST(l_discount AS DECIMAL(5,2)) AS VARCHAR), 'R1', 'line', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_tax AS DECIMAL(5,2)) AS VARCHAR), 'high', 'review', l_linestatus) || ' |' AS raw FROM lineitem""".replace("'M|'", "'M\\|'"))
def k2_issue_log(spark: SparkSession, d: str) -> DataFrame:
    """An issue log's thirteen columns as a Markdown row; a matter without a name goes by its number."""
    matter = F.coalesce(F.nullif(F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("M|"), (F.col("l_orderkey") % 10).cast("string"))), F.lit("")), F.concat(F.lit("matter "), (F.col("l_orderkey") % 10).cast("string")))
    money = lambda c, p: F.col(c).cast(f"decimal({p},2)")
    row = K.markdown_row(F.col("l_orderkey"), F.col("l_linenumber"), matter, F.col("l_partkey"), F.col("l_returnflag"), F.concat(F.lit("discount "), money("l_discount", 5).cast("string")), F.lit("R1"), F.lit("line"), money("l_extendedprice", 18), money("l_tax", 5), F.lit("high"), F.lit("review"), F.col("l_linestatus"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", row.alias("raw"))


_XML = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


@query(f"""WITH h AS (SELECT doc_id, idx, min(level) AS level, min(replace(text, chr(10), ' ')) AS t FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL AND level <= 2 GROUP BY doc_id, idx)
 SELECT doc_id, string_agg(repeat('#', level) || ' ' || t, chr(10) ORDER BY idx) AS markdown, '<ul>' || string_agg('<li>' || {_XML('t')} || '</li>', '' ORDER BY idx) || '</ul>' AS html, string_agg(CASE WHEN level = 1 THEN 'Slide: ' || t ELSE '- ' || t END, chr(10) ORDER BY idx) AS outline FROM h GROUP BY doc_id""")
def k3_exec_pack(spark: SparkSession, d: str) -> DataFrame:
    """A document's upper headings as Markdown, HTML and an outline of slides."""
    h = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL AND level <= 2").groupBy("doc_id", "idx").agg(F.min("level").alias("level"), F.min(F.replace("text", F.lit("\n"), F.lit(" "))).alias("t"))
    g = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "level", "t"))).alias("all"))
    each = lambda f, sep: F.array_join(F.transform("all", f), sep)
    return g.select("doc_id", each(lambda x: F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["t"]), "\n").alias("markdown"), F.concat(F.lit("<ul>"), each(lambda x: F.concat(F.lit("<li>"), T.escape(x["t"], "xml"), F.lit("</li>")), ""), F.lit("</ul>")).alias("html"), each(lambda x: F.when(x["level"] == 1, F.concat(F.lit("Slide: "), x["t"])).otherwise(F.concat(F.lit("- "), x["t"])), "\n").alias("outline"))


# ---- text

_FR_MONEY = r"([0-9]{1,3}(?:[ \x{A0}\x{202F}][0-9]{3})*(?:,[0-9]+)?[ \x{A0}\x{202F}]?M?)[ \x{A0}\x{202F}]?\$"
_FR_FIX = [(-1, "Le prix est de 1 250 000,50 $ et 3,5 M$ de plus."), (-2, "Il paie 40 $."), (-3, "rien")]


@query(rf"SELECT doc_id, CAST(sum(a) AS DOUBLE) AS total, count(*) AS amounts FROM (SELECT doc_id, CAST(replace(regexp_replace(x, '[^0-9,]', '', 'g'), ',', '.') AS DECIMAL(18,4)) * CASE WHEN ends_with(x, 'M') THEN 1000000 ELSE 1 END AS a FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_q(_FR_MONEY)}, 1)) AS x FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM {values(_FR_FIX, 'doc_id, text')}))) GROUP BY doc_id")
def t12_french_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written the French way, millions by their letter."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").unionByName(fixture(spark, _FR_FIX, "doc_id long, text string"))
    x = t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_FR_MONEY), 1)).alias("x"))
    a = F.replace(F.regexp_replace("x", "[^0-9,]", ""), F.lit(","), F.lit(".")).cast("decimal(18,4)") * F.when(F.col("x").endswith("M"), 1000000).otherwise(1)
    return x.groupBy("doc_id").agg(F.sum(a).cast("double").alias("total"), F.count(F.lit(1)).alias("amounts"))


_NOTIFIES = r"(?:^|[^\p{L}])([A-Z][A-Za-z .&']+?) (?:shall |must |will )?(?:notify|give notice to|send notice to) (?:the )?([A-Z][A-Za-z&']+(?: [A-Z][A-Za-z&']+)*)"
_METHODS = ("email", "overnight courier", "certified mail", "personal delivery")


@query(f"WITH {H._SENTENCES_SQL} SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, {H._clean_sql(f'regexp_extract(sent, {_q(_NOTIFIES)}, 1)')} AS sender, {H._clean_sql(f'regexp_extract(sent, {_q(_NOTIFIES)}, 2)')} AS recipient, nullif(regexp_extract(low, '({'|'.join(_METHODS)})', 1), '') AS method FROM s WHERE regexp_matches(sent, {_q(_NOTIFIES)})")
def t14_notice_parties(spark: SparkSession, d: str) -> DataFrame:
    s = H.sentences(spark, d).where(F.col("sent").rlike(_NOTIFIES))
    part = lambda k: H.clean_party(F.regexp_extract("sent", _NOTIFIES, k))
    return s.select("doc_id", "idx", "pos", part(1).alias("sender"), part(2).alias("recipient"), F.nullif(F.regexp_extract("low", f"({'|'.join(_METHODS)})", 1), F.lit("")).alias("method"))


_WORDS = ("first", "second", "third", "fourth", "fifth")
_RANK = r"(?:^|[^\p{L}\p{N}_])(first|second|third|fourth|fifth)(?:$|[^\p{L}\p{N}_])"


@query(f"WITH {H._SENTENCES_SQL} SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, CAST(coalesce(list_position([{_list(_WORDS)}], nullif(regexp_extract(low, {_q(_RANK)}, 1), '')), TRY_CAST(nullif(regexp_extract(low, '(?:^|[^0-9])([0-9]{{1,4}})[.)]', 1), '') AS INTEGER), 1) AS INTEGER) AS rank FROM s WHERE regexp_matches(low, {_q(_RANK)}) OR regexp_matches(low, '[0-9][.)]')")
def t16_text_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The rank a sentence names, as a word or a number before a stop or bracket."""
    s = H.sentences(spark, d).where(F.col("low").rlike(_RANK) | F.col("low").rlike("[0-9][.)]"))
    word = F.nullif(F.array_position(F.array(*map(F.lit, _WORDS)), F.regexp_extract("low", _RANK, 1)), F.lit(0))
    number = F.nullif(F.regexp_extract("low", "(?:^|[^0-9])([0-9]{1,4})[.)]", 1), F.lit("")).try_cast("int")
    return s.select("doc_id", "idx", "pos", F.coalesce(word, number, F.lit(1)).cast("int").alias("rank"))


_PLACED = [(-1, "page 12"), (-2, "p.7#2"), (-3, "slide 3"), (-4, "sheet Fees 2024!B2"), (-5, "§4.2"), (-6, "")]


@query(f"SELECT * FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(lower(anchor), '^(?:page |p[.]?)([0-9]+)', 1), '') AS INTEGER) AS page, TRY_CAST(nullif(regexp_extract(lower(anchor), '^slide ?([0-9]+)', 1), '') AS INTEGER) AS slide, nullif(regexp_extract(anchor, '^sheet ([^!]+)', 1), '') AS sheet FROM (SELECT DISTINCT doc_id, anchor FROM blocks WHERE anchor IS NOT NULL UNION SELECT * FROM {values(_PLACED, 'doc_id, anchor')})) WHERE page IS NOT NULL OR slide IS NOT NULL OR sheet IS NOT NULL")
def t18_anchor_places(spark: SparkSession, d: str) -> DataFrame:
    """Page, slide or sheet that an anchor names."""
    a = table(spark, d, "blocks").where("anchor IS NOT NULL").select("doc_id", "anchor").unionByName(fixture(spark, _PLACED, "doc_id long, anchor string")).distinct()
    low = F.lower("anchor")
    number = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("int")
    out = a.select("doc_id", number("^(?:page |p[.]?)([0-9]+)").alias("page"), number("^slide ?([0-9]+)").alias("slide"), F.nullif(F.regexp_extract("anchor", "^sheet ([^!]+)", 1), F.lit("")).alias("sheet"))
    return out.where("page IS NOT NULL OR slide IS NOT NULL OR sheet IS NOT NULL")


# Quotation marks with the words from which a quoted phrase must be kept.
QUOTES = (("angle", "«([^«»]+)»", 2), ("curly", "“([^“”]+)”", 5), ("plain", '"([^"]+)"', 5))


@query("WITH b AS (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE text IS NOT NULL UNION ALL SELECT * FROM " + values([(-1, 0, 'He said "one two three four five" and “Buyer” («the Buyer»), «two words».')], "doc_id, idx, text") + ") SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, idx, '{n}' AS style, trim(p) AS phrase FROM (SELECT doc_id, idx, unnest(regexp_extract_all(text, {_q(p)}, 1)) AS p FROM b) WHERE len(string_split(trim(p), ' ')) >= {k} AND NOT regexp_matches(trim(p), '^(the |le |la )?[A-Z][a-z]+$')" for n, p, k in QUOTES) + ")")
def t30_kept_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Quoted phrases that a translation has to keep: of two words or five by the marks, but for defined terms."""
    b = table(spark, d, "blocks").where("text IS NOT NULL").select("doc_id", "idx", "text").unionByName(fixture(spark, [(-1, 0, 'He said "one two three four five" and “Buyer” («the Buyer»), «two words».')], "doc_id long, idx int, text string"))

    def styled(name: str, pattern: str, least: int):
        long = F.filter(F.regexp_extract_all("text", F.lit(pattern), 1), lambda x: F.size(F.split(F.trim(x), " ")) >= least)
        return F.transform(long, lambda x: F.struct(F.lit(name).alias("style"), F.trim(x).alias("phrase")))

    found = F.concat(*[styled(*q) for q in QUOTES])
    return b.select("doc_id", "idx", F.explode(found).alias("x")).select("doc_id", "idx", "x.*").where(~F.col("phrase").rlike("^(the |le |la )?[A-Z][a-z]+$")).distinct()


# Citation formats; a part in braces is a field, one in brackets stands only if its field is filled.
CITED = {
    "juris_cass": "Cass. {chambre}, {date}, n° {numero}", "juris_ce": "CE[, {formation}], {date}, n° {numero}[, {nom}]", "juris_const": "Cons. const., {date}, n° {numero}[, {nom}]", "juris_ca": "CA {ville}[, {chambre}], {date}, n° RG {numero}", "juris_tj": "TJ {ville}, {date}, n° RG {numero}", "code_article": "Art. {numero} {code}",
    "loi": "Loi n° {numero} du {date}[ {titre}]", "decret": "Décr. n° {numero} du {date}", "ordonnance": "Ord. n° {numero} du {date}", "doctrine_article": "{auteur}, « {titre} », {revue} {annee}[, p. {page}]", "doctrine_ouvrage": "{auteur}, {titre}, {editeur}, {annee}[, {edition}]", "doctrine_these": "{auteur}, {titre}, thèse {universite}, {annee}",
}
_FIELDS = ("chambre", "date", "numero", "formation", "nom", "ville", "code", "titre", "auteur", "revue", "annee", "page", "editeur", "edition", "universite")


def _citations() -> list[tuple]:
    full = dict(zip(_FIELDS, ("1re civ.", "2020-03-01", "19-12.345", "ass.", "Arrêt X", "Lyon", "C. civ.", "Du droit", "DURAND P.", "RTD", "2019", "12", "Puf", "3e éd.", "Lyon III")))
    out = []
    for k, kind in enumerate(CITED):
        out.append((2 * k, kind, *[full[f] for f in _FIELDS]))
        out.append((2 * k + 1, kind, *[None if f in ("formation", "nom", "page", "edition", "chambre", "titre") else full[f] for f in _FIELDS]))
    return out


_CITATIONS = _citations()


def _pieces(fmt: str) -> list[tuple[str, bool]]:
    import re

    return [(a or b, bool(a)) for a, b in re.findall(r"\[([^\]]*)\]|([^\[\]]+)", fmt)]


def _piece_sql(text: str, optional: bool) -> str:
    import re

    parts = [f"coalesce(nullif({'written' if p == 'date' else p}, ''), '[{p}]')" if k % 2 else _q(p) for k, p in enumerate(re.split(r"\{(\w+)\}", text)) if p]
    made = " || ".join(parts)
    field = re.search(r"\{(\w+)\}", text)
    return f"CASE WHEN coalesce({field.group(1)}, '') <> '' THEN {made} ELSE '' END" if optional and field else made


_WRITTEN_SQL = f"CASE WHEN date IS NOT NULL THEN (CASE WHEN day(CAST(date AS DATE)) = 1 THEN '1er' ELSE CAST(day(CAST(date AS DATE)) AS VARCHAR) END) || ' ' || [{_list(D.FR_SHORT)}][month(CAST(date AS DATE))] || ' ' || year(CAST(date AS DATE)) END"


@query(f"SELECT id, kind, CASE kind {' '.join(f'WHEN {_q(k)} THEN ' + ' || '.join(_piece_sql(*p) for p in _pieces(f)) for k, f in CITED.items())} END AS citation FROM (SELECT *, {_WRITTEN_SQL} AS written FROM {values(_CITATIONS, 'id, kind, ' + ', '.join(_FIELDS))})")
def t36_citation_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Twelve kinds of citation by their formats; a missing field shows its name, a missing addition nothing."""
    import re

    c = fixture(spark, _CITATIONS, "id int, kind string, " + ", ".join(f"{f} string" for f in _FIELDS)).withColumn("written", D.french_date(F.col("date").cast("date"), short=True))

    def piece(text: str, optional: bool):
        shown = lambda p: F.coalesce(F.nullif(F.col("written" if p == "date" else p), F.lit("")), F.lit(f"[{p}]"))
        made = F.concat(*[shown(p) if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w+)\}", text)) if p])
        field = re.search(r"\{(\w+)\}", text)
        return F.when(F.coalesce(F.col(field.group(1)), F.lit("")) != "", made).otherwise("") if optional and field else made

    out = F.lit(None).cast("string")
    for kind, fmt in CITED.items():
        out = F.when(F.col("kind") == kind, F.concat(*[piece(*p) for p in _pieces(fmt)])).otherwise(out)
    return c.select("id", "kind", out.alias("citation"))


_SOUND = ("ph", "f"), ("w", "v"), ("y", "i"), ("ck", "k")
_CYR = ("abcdefghijklmnoprstuvz", "абцдефгхийклмнопрстувз")


def _modes_sql() -> str:
    w = "string_split(name, ' ')"
    sound = "lower(name)"
    for a, b in _SOUND:
        sound = f"replace({sound}, '{a}', '{b}')"
    modes = {
        "transposition": (f"{w}[-1] || ' ' || array_to_string({w}[:-2], ' ')", "moderate"), "comma": (f"{w}[-1] || ', ' || array_to_string({w}[:-2], ' ')", "moderate"), "initials": (f"left(name, 1) || '. ' || {w}[-1]", "strong"), "hyphen": ("replace(name, ' ', '-')", "strong"), "joined": ("replace(name, ' ', '')", "strong"), "double_space": ("replace(name, ' ', '  ')", "strong"),
        "stripped": (sql_fold("name"), "strong"), "transliteration": (sound, "moderate"), "script": (f"translate(lower({sql_fold('name')}), '{_CYR[0]}', '{_CYR[1]}')", "weak"), "typo": ("left(name, 1) || substr(name, 3, 1) || substr(name, 2, 1) || substr(name, 4)", "strong"), "honorific": ("'Dr. ' || name", "moderate"), "truncation": (f"{w}[-1]", "weak"), "published": ("name", "exact"),
    }
    rows = ", ".join(f"{{'mode': '{m}', 'variant': {v}, 'strength': '{s}'}}" for m, (v, s) in modes.items())
    return f"SELECT DISTINCT party_id, x.mode, x.variant, x.strength FROM (SELECT party_id, unnest([{rows}]) AS x, name FROM parties WHERE type = 'person' AND regexp_matches(name, '^\\p{{Lu}}\\p{{Ll}}{{2,}}( \\p{{Lu}}\\p{{Ll}}+)+$')) WHERE x.variant <> name OR x.mode = 'published'"


@query(_modes_sql())
def t41_variation_modes(spark: SparkSession, d: str) -> DataFrame:
    """Variants of people's names by mode, each with how surely a search should find it."""
    p = table(spark, d, "parties").where("type = 'person'").where(F.col("name").rlike(r"^\p{Lu}\p{Ll}{2,}( \p{Lu}\p{Ll}+)+$"))
    n, w = F.col("name"), F.split("name", " ")
    last, front = F.element_at(w, -1), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ")
    sound = F.lower(n)
    for a, b in _SOUND:
        sound = F.replace(sound, F.lit(a), F.lit(b))
    modes = {
        "transposition": (F.concat_ws(" ", last, front), "moderate"), "comma": (F.concat_ws(", ", last, front), "moderate"), "initials": (F.concat(F.substring(n, 1, 1), F.lit(". "), last), "strong"), "hyphen": (F.replace(n, F.lit(" "), F.lit("-")), "strong"), "joined": (F.replace(n, F.lit(" "), F.lit("")), "strong"), "double_space": (F.replace(n, F.lit(" "), F.lit("  ")), "strong"),
        "stripped": (T.fold(n), "strong"), "transliteration": (sound, "moderate"), "script": (F.translate(F.lower(T.fold(n)), *_CYR), "weak"), "typo": (F.concat(F.substring(n, 1, 1), F.substring(n, 3, 1), F.substring(n, 2, 1), F.substring(n, 4, 1 << 20)), "strong"), "honorific": (F.concat(F.lit("Dr. "), n), "moderate"), "truncation": (last, "weak"), "published": (n, "exact"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("variant"), F.lit(s).alias("strength")) for m, (v, s) in modes.items()]))
    return p.select("party_id", "name", each.alias("x")).where("x.variant <> name OR x.mode = 'published'").select("party_id", "x.*").distinct()


# Marker words and characters of each language.
MARKS = {"german": ("der", "die", "das", "und", "nicht", "gemäß"), "french": ("le", "la", "les", "des", "selon"), "spanish": ("el", "los", "las", "del", "según"), "portuguese": ("o", "os", "da", "em", "por", "para", "conforme"), "polish": ("w", "na", "z", "do", "że", "i", "się", "oraz"), "finnish": ("että", "ja", "sekä"), "hungarian": ("és", "az", "hogy", "valamint"), "chinese": ("的", "是", "本", "各方"), "japanese": ("の", "は", "に", "を")}


@query("WITH w AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) < 9) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, arg_max(lang, {'n': n, 'l': lang}) AS lang, max(n) AS hits FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS lang, " + (" + ".join(f"(length(text) - length(replace(text, '{x}', ''))) // length('{x}')" for x in w) if k in ("chinese", "japanese") else f"len(list_filter(t, lambda x: x IN ({_list(w)})))") + " AS n FROM w" for k, w in MARKS.items()) + ") GROUP BY doc_id HAVING max(n) >= 5")
def t33_markers_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The language with most marker words, from five on."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("t"))
    count = lambda k, w: sum((F.regexp_count("text", F.lit(x)) for x in w), F.lit(0)) if k in ("chinese", "japanese") else F.size(F.filter("t", lambda x: x.isin(*w)))
    best = F.array_max(F.array(*[F.struct(count(k, w).cast("long").alias("n"), F.lit(k).alias("lang")) for k, w in MARKS.items()]))
    return t.select("doc_id", best.alias("b")).select("doc_id", "b.lang", F.col("b.n").alias("hits")).where("hits >= 5")


_STEPS = (H._D, r"within [0-9]+ (?:business )?days? (?:after|of)", r"(?:within )?[0-9]+ (?:business |calendar )?days?'? (?:after|before|of|from|prior to)[^,;:.]{0,60}", r"[0-9]+-(?:business|calendar)-days?[^,;:.]{0,50}", r"[0-9]+ (?:weeks?|months?) (?:after|before|following|prior to)[^,;:.]{0,60}", r"(?:no later than|not later than|on or before|prior to|cure period)[^,;:]{0,80}")


@query(f"WITH {H._SENTENCES_SQL} SELECT * FROM (SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, coalesce({', '.join(f'nullif(trim(regexp_extract(low, {_q(p)}, 0)), {chr(39) * 2})' for p in _STEPS)}) AS timing FROM s) WHERE timing IS NOT NULL")
def d5_timing_steps(spark: SparkSession, d: str) -> DataFrame:
    """The timing of a deadline, by six kinds of phrase in order: date, days after, days around, hyphened days, weeks and months, clause."""
    pick = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("low", p, 0)), F.lit("")) for p in _STEPS])
    return H.sentences(spark, d).select("doc_id", "idx", "pos", pick.alias("timing")).where("timing IS NOT NULL")


@query(f"""WITH {H._SENTENCES_SQL}, x AS (SELECT doc_id, idx, pos, lang, regexp_extract(sent, '((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS en, regexp_extract(low, '(1er|[0-9]{{1,2}}) ({'|'.join(D.FR_MONTHS)}) ([0-9]{{4}})', 0) AS fr FROM s)
 SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, CASE WHEN lang = 'en' THEN en ELSE CAST(TRY_CAST(split_part(fr, ' ', 3) || '-' || lpad(CAST(list_position([{_list(D.FR_MONTHS)}], split_part(fr, ' ', 2)) AS VARCHAR), 2, '0') || '-' || lpad(replace(split_part(fr, ' ', 1), 'er', ''), 2, '0') AS DATE) AS VARCHAR) END AS day FROM x WHERE (lang = 'en' AND en <> '') OR (lang = 'fr' AND fr <> '')""")
def d4_dates_by_language(spark: SparkSession, d: str) -> DataFrame:
    """English dates as they stand, French ones as ISO dates."""
    s = H.sentences(spark, d)
    en = F.regexp_extract("sent", "((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2},? [0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    fr = F.regexp_extract("low", f"(1er|[0-9]{{1,2}}) ({'|'.join(D.FR_MONTHS)}) ([0-9]{{4}})", 0)
    x = s.select("doc_id", "idx", "pos", "lang", en.alias("en"), fr.alias("fr")).where("(lang = 'en' AND en <> '') OR (lang = 'fr' AND fr <> '')")
    return x.select("doc_id", "idx", "pos", F.when(F.col("lang") == "en", F.col("en")).otherwise(D.normalise_date(F.col("fr")).cast("string")).alias("day"))


# ---- candidates

# Headers of tables and the field each speaks of.
HEADERS = {
    "party": "party entity obligor borrower seller buyer owner partie entité débiteur emprunteur vendeur acheteur propriétaire", "obligation": "obligation action requirement covenant task deliverable exigence engagement tâche livrable", "deadline": "deadline timing date échéance délai", "status": "status completed pending resolved statut état", "risk": "risk issue concern exception finding risque enjeu",
    "control": "control approver reviewer verification contrôle approbateur réviseur vérification", "document": "document agreement certificate notice filing convention entente certificat avis annexe", "amount": "amount price payment fee expense montant prix paiement frais dépense",
}
_HEADER_ROWS = [(w, f) for f, ws in HEADERS.items() for w in ws.split()] + [("responsible party", "party"), ("due date", "deadline"), ("date limite", "deadline")]
_TABLES = [(1, 0, ["Responsible Party", "Obligation", "Due Date", "Colour"]), (1, 1, ["Buyer Ltd", "pay the price", "2026-01-05", "red"]), (1, 2, ["Company", "deliver", "", ""]), (2, 0, ["Partie", "Montant", "Statut"]), (2, 1, ["Vendeur Inc", "5 000 $", "en cours"])]
# Field, frame and score of each kind of cell.
CELLS_TO = {"party": ("parties", 86), "obligation": ("obligations", 86), "deadline": ("deadlines", 84), "control": ("controls", 82), "document": ("documents", 80), "amount": ("transfers", 78), "risk": ("risk_items", 74)}


@query(f"""WITH t AS {values(_TABLES, 'tbl, row_no, cells')}, h AS (SELECT tbl, unnest(range(1, len(cells) + 1)) AS k, unnest(cells) AS head FROM t WHERE row_no = 0), m AS (SELECT tbl, k, field FROM h JOIN {values(_HEADER_ROWS, 'word, field')} ON lower(trim(head)) = word),
 c AS (SELECT t.tbl, row_no, m.field, trim(cells[k]) AS value FROM t JOIN m ON m.tbl = t.tbl WHERE row_no > 0)
 SELECT tbl, row_no, target, value, score FROM c JOIN {values([(f, *v) for f, v in CELLS_TO.items()], 'f, target, score')} ON f = c.field WHERE value <> '' AND NOT (c.field = 'party' AND lower(value) IN ('company', 'vendor', 'party'))""")
def h19_cells_by_header(spark: SparkSession, d: str) -> DataFrame:
    """Cells of tables as candidates of the field their header speaks of; a bare role is no party."""
    t = fixture(spark, _TABLES, "tbl int, row_no int, cells array<string>")
    words = fixture(spark, _HEADER_ROWS, "word string, field string")
    h = t.where("row_no = 0").select("tbl", F.posexplode("cells").alias("k", "head")).select("tbl", "k", F.lower(F.trim("head")).alias("word")).join(F.broadcast(words), "word").select("tbl", "k", "field")
    c = t.where("row_no > 0").select("tbl", "row_no", F.posexplode("cells").alias("k", "value")).join(h, ["tbl", "k"]).withColumn("value", F.trim("value"))
    to = fixture(spark, [(f, *v) for f, v in CELLS_TO.items()], "field string, target string, score int")
    return c.where("value <> '' AND NOT (field = 'party' AND lower(value) IN ('company', 'vendor', 'party'))").join(F.broadcast(to), "field").select("tbl", "row_no", "target", "value", "score")


_IDS = {"obligations": "OBL", "deadlines": "DL", "transfers": "TR", "claim_classes": "CC"}
_SOME = [f for f in H.FRAMES if f.op in ("h4", "h7", "h10")]


def _some(spark: SparkSession, d: str) -> DataFrame:
    return H.candidates(H.sentences(spark, d), _SOME)


@query(f"SELECT doc_id, idx, pos, frame, field, CASE field {' '.join(f'WHEN {_q(f)} THEN {_q(p)}' for f, p in _IDS.items())} END || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY idx, pos, frame) AS VARCHAR), 4, '0') AS id FROM ({H._frames_sql(_SOME)})")
def w2_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a document's entities by field, in the order of the text."""
    c = _some(spark, d).withColumn("g", F.concat_ws("|", F.col("doc_id").cast("string"), "field"))
    numbered = running_number(c, "g", ["idx", "pos", "frame"], F.floor(F.col("idx") / 1024), "n")
    prefix = F.coalesce(*[F.when(F.col("field") == f, F.lit(p)) for f, p in _IDS.items()])
    return numbered.select("doc_id", "idx", "pos", "frame", "field", F.concat(prefix, F.lit("-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("id"))


@query(f"SELECT doc_id, idx, pos, frame, field, 'C' || lpad(CAST(n AS VARCHAR), 4, '0') AS candidate, 'E' || lpad(CAST(n AS VARCHAR), 4, '0') AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, pos, field, frame) - 1 AS n FROM ({H._frames_sql(_SOME)}))")
def w3_candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    numbered = running_number(_some(spark, d), "doc_id", ["idx", "pos", "field", "frame"], F.floor(F.col("idx") / 1024), "n")
    code = lambda c: F.concat(F.lit(c), F.lpad((F.col("n") - 1).cast("string"), 4, "0"))
    return numbered.select("doc_id", "idx", "pos", "frame", "field", code("C").alias("candidate"), code("E").alias("evidence"))


# What an entity of each field must have, and what it has by default.
BUILDERS = {
    "obligations": ("party", "status=open"), "deadlines": ("timing", "party=unspecified"), "transfers": ("amount", "to_party=unspecified"), "claim_classes": ("", "claim_type=waterfall"), "conditions": ("", "responsible_party=unspecified"), "communications": ("party", "comm_type=notice"), "controls": ("", "owner=unspecified"), "decision_points": ("", "yes_path=permitted/approved"),
    "documents": ("", "type=deliverable"), "relationships": ("party", "to_entity=unspecified"), "events": ("timing", "actor=unspecified"), "concepts": ("", "concept_type=representation"),
}
_SUBJECT_SQL = H._clean_sql(f"regexp_extract(sent, {_q(H._SUBJECT)}, 1)")
_KEEP_SQL = f", {_SUBJECT_SQL} AS party, regexp_extract(low, {_q(H.MONEY['en'])}, 0) AS amount, coalesce({', '.join(f'nullif(trim(regexp_extract(low, {_q(p)}, 0)), {chr(39) * 2})' for p in _STEPS)}, '') AS timing"


@query(f"SELECT doc_id, idx, pos, field, frame, score, CASE WHEN score < 65 THEN 'hint' WHEN CASE need WHEN 'party' THEN party WHEN 'timing' THEN timing WHEN 'amount' THEN amount ELSE 'x' END = '' THEN 'hint' ELSE 'entity' END AS state, need AS required, CASE WHEN party = '' THEN 'unspecified' ELSE party END AS party, defaults FROM ({H._frames_sql(H.FRAMES, _KEEP_SQL)}) JOIN {values([(f, *v) for f, v in BUILDERS.items()], 'f, need, defaults')} ON f = field")
def h24_builders(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as entities of their field with its defaults; one without what its field requires, or too weak, stays a hint."""
    s = H.sentences(spark, d)
    timing = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("low", p, 0)), F.lit("")) for p in _STEPS], F.lit(""))
    s = s.withColumn("party", H.clean_party(F.regexp_extract("sent", H._SUBJECT, 1))).withColumn("amount", F.regexp_extract("low", H.MONEY["en"], 0)).withColumn("timing", timing)
    c = H.candidates(s, H.FRAMES, ("party", "amount", "timing"))
    to = fixture(spark, [(f, *v) for f, v in BUILDERS.items()], "field string, required string, defaults string")
    c = c.join(F.broadcast(to), "field")
    value = F.when(F.col("required") == "party", F.col("party")).when(F.col("required") == "timing", F.col("timing")).when(F.col("required") == "amount", F.col("amount")).otherwise("x")
    state = F.when((F.col("score") < 65) | (value == ""), "hint").otherwise("entity")
    return c.select("doc_id", "idx", "pos", "field", "frame", "score", state.alias("state"), "required", F.when(F.col("party") == "", "unspecified").otherwise(F.col("party")).alias("party"), "defaults")


@query(f"WITH {H._SENTENCES_SQL} SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, {_SUBJECT_SQL} AS subject FROM s WHERE regexp_matches(sent, {_q(H._SUBJECT)})")
def t10_clause_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Who a clause is about: what stands before its verb of duty, cleaned."""
    s = H.sentences(spark, d).where(F.col("sent").rlike(H._SUBJECT))
    return s.select("doc_id", "idx", "pos", H.clean_party(F.regexp_extract("sent", H._SUBJECT, 1)).alias("subject"))


_LAWS = [
    (1, "Przepis stanowi: Art. 5. Zmieniony tekst. Art. 5. 1. Pierwszy ustęp. 2. Drugi ustęp. Art. 6. Dalej.", "5", ""), (2, "Wstęp, który jest na tyle długi, że cytat nie sięga do niego wcale, bo ma on mieć ponad sto dwadzieścia znaków aż do końca tego zdania. Art. 5. 1. Pierwszy ustęp. 2. Drugi ustęp. Art. 6. Dalej.", "5", "2"), (3, "Art. 1. Jeden. § 2. Dwa.", "1", ""), (4, "Art. 1. Jeden.", "9", ""), (5, "W „ Art. 3. cytat ” i dalej bez końca", "3", ""), (6, "Art. 7. 1. Tylko jeden.", "7", "4"),
]
_QUOTED = r"""[„"']|stanowi[ąa][ :„"']"""


@query(f"""WITH l AS (SELECT *, 'Art. ' || art || '.' AS sep FROM {values(_LAWS, 'id, x, art, part')}), p AS (SELECT *, string_split(x, sep) AS s FROM l), k AS (SELECT *, list_filter(range(1, len(s)), lambda k: NOT regexp_matches(right(replace(array_to_string(s[1:k], chr(1)), chr(1), sep), 120), {_q(_QUOTED)}))[1] AS at FROM p),
 b AS (SELECT id, part, CASE WHEN k.at IS NOT NULL THEN sep || regexp_extract(replace(array_to_string(s[k.at + 1:], chr(1)), chr(1), sep) || ' § 0', '(?s)^(.*?)(?:Art[.] [0-9]|§ ?[0-9])', 1) END AS body FROM k)
 SELECT id, CASE WHEN part = '' THEN trim(body) ELSE nullif(trim(regexp_extract(substr(body, 8) || ' 0. ', '(?s)(?:^|[^0-9])(' || part || '[.] .*?)[0-9]+[.] ', 1)), '') END AS article FROM b""")
def h35_article_parts(spark: SparkSession, d: str) -> DataFrame:
    """An article up to the next, or a part of it; a heading with a quotation in the 120 characters before it is another act's."""
    l = fixture(spark, _LAWS, "id int, x string, art string, part string").withColumn("sep", F.concat(F.lit("Art. "), "art", F.lit("."))).withColumn("s", F.expr("split(x, concat('Art[.] ', art, '[.]'))"))  # noqa: E741
    before = lambda k: F.array_join(F.slice("s", F.lit(1), k), "\x00")
    # A heading is as long as its separator, so the last 120 characters are taken with it put back.
    k = F.get(F.filter(F.sequence(F.lit(1), F.size("s")), lambda k: (k < F.size("s")) & ~F.right(F.replace(before(k), F.lit("\x00"), F.col("sep")), F.lit(120)).rlike(_QUOTED)), F.lit(0))
    b = l.withColumn("k", k).withColumn("rest", F.replace(F.array_join(F.slice("s", F.col("k") + 1, F.greatest(F.size("s"), F.lit(1))), "\x00"), F.lit("\x00"), F.col("sep")))
    body = F.when(F.col("k").isNotNull(), F.concat("sep", F.regexp_extract(F.concat("rest", F.lit(" § 0")), r"(?s)^(.*?)(?:Art[.] [0-9]|§ ?[0-9])", 1)))
    b = b.withColumn("body", body)
    part = F.expr("regexp_extract(concat(substring(body, 8), ' 0. '), concat('(?s)(?:^|[^0-9])(', part, '[.] .*?)[0-9]+[.] '), 1)")
    return b.select("id", F.when(F.col("part") == "", F.trim("body")).otherwise(F.nullif(F.trim(part), F.lit(""))).alias("article"))


# Fields that a result has.
ALL_FIELDS = "parties obligations conditions deadlines transfers communications controls documents decision_points relationships ownership_links entities events legal_authorities concepts claim_classes risk_items data_flows process_steps ip_assets states transitions phases tasks negotiation_issues investigation_steps reference_points".split()
_ROWS_ALL = "SELECT field, max(score) AS best FROM (" + H._frames_sql(H.FRAMES) + ") GROUP BY field"


@query(f"WITH best AS ({_ROWS_ALL}) SELECT f AS field, CASE WHEN best >= 65 THEN 'populated' WHEN best IS NOT NULL THEN 'hint_only' ELSE 'absent' END AS coverage FROM (SELECT unnest([{_list(ALL_FIELDS)}]) AS f) LEFT JOIN best ON best.field = f")
def a25_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All fields of a result: with a candidate that may be promoted, with hints alone, or with none."""
    best = H.candidates(H.sentences(spark, d), H.FRAMES).groupBy("field").agg(F.max("score").alias("best"))
    fields = fixture(spark, [(f,) for f in ALL_FIELDS], "field string")
    return fields.join(best, "field", "left").select("field", F.when(F.col("best") >= 65, "populated").when(F.col("best").isNotNull(), "hint_only").otherwise("absent").alias("coverage"))


@query("SELECT doc_id, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT doc_id, 'SOURCE_UNPARSEABLE_OR_EMPTY' AS code FROM documents ANTI JOIN (SELECT DISTINCT doc_id FROM blocks) b USING (doc_id) UNION ALL SELECT doc_id, 'PDF_NO_TEXT_BLOCKS' FROM documents ANTI JOIN (SELECT DISTINCT doc_id FROM blocks) b USING (doc_id) WHERE source_format = 'pdf' UNION ALL SELECT doc_id, 'SOURCE_TRUNCATED' FROM (SELECT doc_id, count(DISTINCT idx) AS n FROM blocks GROUP BY doc_id) JOIN (SELECT doc_id FROM documents) USING (doc_id) WHERE n > 40 UNION ALL SELECT doc_id, 'NO_CANDIDATES' FROM documents ANTI JOIN (SELECT DISTINCT doc_id FROM (" + H._frames_sql(H.FRAMES) + ")) c USING (doc_id)) GROUP BY doc_id")
def h26_all_codes(spark: SparkSession, d: str) -> DataFrame:
    """Warning codes of each document: nothing read, a scanned file, cut at the limit, no candidate."""
    docs = table(spark, d, "documents").select("doc_id", "source_format")
    n = table(spark, d, "blocks").groupBy("doc_id").agg(F.count_distinct("idx").alias("n"))
    found = H.candidates(H.sentences(spark, d), H.FRAMES).select("doc_id").distinct().withColumn("found", F.lit(True))
    j = docs.join(n, "doc_id", "left").join(found, "doc_id", "left")
    none = F.col("n").isNull()
    codes = F.array_sort(F.filter(F.array(F.when(none, "SOURCE_UNPARSEABLE_OR_EMPTY"), F.when(none & (F.col("source_format") == "pdf"), "PDF_NO_TEXT_BLOCKS"), F.when(F.col("n") > 40, "SOURCE_TRUNCATED"), F.when(F.col("found").isNull(), "NO_CANDIDATES")), lambda x: x.isNotNull()))
    return j.select("doc_id", F.array_join(codes, ",").alias("codes")).where("codes <> ''")


# ---- detectors, frontmatter, labels, predicates

_REPORT = ["# Report", "#### Part (p. 3)", "(Statistics on pay)", "#### Thin", "short", "#### Container", "#### Full (p. 9)", "The board met 12 times in the year and every one of its members attended all of the meetings of 2023 as « stated ».", "- **1.1**: « cited »", "- **1.2**: not cited", "- **2.1**: none", "- **2.2**: none", "Available, voir le tableau en annexe, sur demande", "a « b"]
_REPORT_ROWS = [("r", k, x) for k, x in enumerate(_REPORT, 1)] + [("q", 1, "nothing « here »")]
_USEFUL = r"[\s\-*>|]"


@query(rf"""WITH l AS {values(_REPORT_ROWS, 'file, n, line')}, s AS (SELECT file, n, regexp_extract(line, '^\s*-\s*\*\*([0-9]+)\.[0-9]+\*\*\s*:', 1) AS grp, contains(line, '«') AS cited FROM l), g AS (SELECT file, grp FROM s WHERE grp <> '' GROUP BY file, grp HAVING count(*) >= 2 AND bool_or(cited) AND NOT bool_and(cited)),
 t AS (SELECT *, sum(CAST(regexp_matches(line, '^#+ ') AS INTEGER)) OVER (PARTITION BY file ORDER BY n) AS sec FROM l), b AS (SELECT file, sec, min(n) AS n, arg_min(line, n) AS head, string_agg(CASE WHEN NOT regexp_matches(line, '^#+ ') THEN line END, ' ' ORDER BY n) AS body, max(sec) OVER (PARTITION BY file) AS last FROM t WHERE sec > 0 GROUP BY file, sec),
 u AS (SELECT *, length(regexp_replace(coalesce(body, ''), '{_USEFUL}', '', 'g')) AS useful FROM b WHERE starts_with(head, '#### '))
 SELECT s.file, CAST(s.n AS INTEGER) AS n, 'D1' AS detector FROM s JOIN g ON g.file = s.file AND g.grp = s.grp WHERE NOT s.cited
 UNION ALL SELECT file, CAST(n AS INTEGER), 'D2' FROM u WHERE NOT (useful = 0 AND sec < last) AND NOT contains(coalesce(body, ''), '«') AND NOT regexp_matches(coalesce(body, ''), 'p\. ?[0-9]') AND useful < 60
 UNION ALL SELECT file, CAST(n AS INTEGER), 'D2b' FROM u WHERE regexp_matches(head, '\(?p\. ?[0-9]+') AND useful > 0 AND (regexp_matches(body, '^\( *[A-ZÉÀ]') OR NOT regexp_matches(body, '[0-9]') OR useful < 90)
 UNION ALL SELECT file, 0, 'D3' FROM l GROUP BY file HAVING sum(length(line) - length(replace(line, '«', ''))) <> sum(length(line) - length(replace(line, '»', '')))
 UNION ALL SELECT file, CAST(n AS INTEGER), 'D4' FROM l WHERE regexp_matches(lower(line), '(disponible sur demande|sur demande|figure (au|à la|en) p|voir (le )?(tableau|détail|annexe)|non (reproduit|restitué|détaillé))')""")
def h37_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Signs that a report left something out: half-cited series, empty sections, thin figures, open quotations, references instead of content."""
    lines = fixture(spark, _REPORT_ROWS, "file string, n int, line string")
    line = F.col("line")
    s = lines.select("file", "n", F.regexp_extract(line, r"^\s*-\s*\*\*([0-9]+)\.[0-9]+\*\*\s*:", 1).alias("grp"), line.contains("«").alias("cited")).where("grp <> ''")
    series = s.groupBy("file", "grp").agg(F.count(F.lit(1)).alias("k"), F.bool_or("cited").alias("any"), F.bool_and("cited").alias("all")).where("k >= 2 AND any AND NOT all").select("file", "grp")
    d1 = s.where("NOT cited").join(series, ["file", "grp"], "left_semi").select("file", "n", F.lit("D1").alias("detector"))
    head = line.rlike("^#+ ")
    t = lines.withColumn("sec", F.sum(head.cast("int")).over(Window.partitionBy("file").orderBy("n"))).where("sec > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("n", "line")))), lambda x: x["line"]), " ")
    b = t.groupBy("file", "sec").agg(F.min("n").alias("n"), F.min_by("line", "n").alias("head"), body.alias("body"))
    b = b.join(b.groupBy("file").agg(F.max("sec").alias("last")), "file").where("startswith(head, '#### ')").withColumn("useful", F.length(F.regexp_replace("body", _USEFUL, "")))
    text = F.col("body")
    skeleton = ~((F.col("useful") == 0) & (F.col("sec") < F.col("last"))) & ~text.contains("«") & ~text.rlike(r"p\. ?[0-9]") & (F.col("useful") < 60)
    thin = F.col("head").rlike(r"\(?p\. ?[0-9]+") & (F.col("useful") > 0) & (text.rlike(r"^\( *[A-ZÉÀ]") | ~text.rlike("[0-9]") | (F.col("useful") < 90))
    d2 = b.select("file", "n", F.explode(F.filter(F.array(F.when(skeleton, "D2"), F.when(thin, "D2b")), lambda x: x.isNotNull())).alias("detector"))
    mark = lambda c: F.sum(F.length("line") - F.length(F.replace("line", F.lit(c), F.lit(""))))
    d3 = lines.groupBy("file").agg((mark("«") != mark("»")).alias("open")).where("open").select("file", F.lit(0).alias("n"), F.lit("D3").alias("detector"))
    d4 = lines.where(F.lower(line).rlike("(disponible sur demande|sur demande|figure (au|à la|en) p|voir (le )?(tableau|détail|annexe)|non (reproduit|restitué|détaillé))")).select("file", "n", F.lit("D4").alias("detector"))
    return d1.unionByName(d2).unionByName(d3).unionByName(d4)


_FRONTS = [(1, "---\nname: my-tool\ndescription: Does it\n---\n"), (2, "no front"), (3, "---\nname: x\n"), (4, "---\nname: Bad\ndescription: d\n---\n"), (5, "---\nname: a--b\ndescription: d\n---\n"), (6, "---\nname: " + "a" * 65 + "\ndescription: d\n---\n"), (7, "---\nname: ok\ndescription: <b>\n---\n"), (8, "---\nname: ok\ndescription: " + "d" * 1025 + "\n---\n"), (9, "---\nname: ok\ndescription: d\ncolour: red\n---\n"), (10, "---\ndescription: d\n---\n"), (11, "---\nname: ok\n---\n")]
_ALLOWED_KEYS = ("name", "description", "license", "allowed-tools", "metadata")


@query(f"""WITH f AS (SELECT id, x, regexp_extract(x, '(?s)^---\\n(.*?)\\n---', 1) AS front FROM {values(_FRONTS, 'id, x')}), v AS (SELECT *, trim(regexp_extract(front, '(?m)^name: *(.*)$', 1)) AS name, trim(regexp_extract(front, '(?m)^description: *(.*)$', 1)) AS description, list_filter(regexp_extract_all(front, '(?m)^([a-z_-]+):', 1), lambda k: k NOT IN ({_list(_ALLOWED_KEYS)})) AS other FROM f)
 SELECT id, CASE WHEN NOT starts_with(x, '---') THEN 'no frontmatter' WHEN front = '' THEN 'invalid format' WHEN len(other) > 0 THEN 'unexpected key' WHEN NOT regexp_matches(front, '(?m)^name:') THEN 'no name' WHEN NOT regexp_matches(front, '(?m)^description:') THEN 'no description' WHEN name <> '' AND NOT regexp_matches(name, '^[a-z0-9-]+$') THEN 'not hyphen-case' WHEN starts_with(name, '-') OR ends_with(name, '-') OR contains(name, '--') THEN 'misplaced hyphen' WHEN length(name) > 64 THEN 'name too long' WHEN regexp_matches(description, '[<>]') THEN 'angle brackets' WHEN length(description) > 1024 THEN 'description too long' ELSE 'valid' END AS finding FROM v""")
def h43_frontmatter_limits(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    f = fixture(spark, _FRONTS, "id int, x string").withColumn("front", F.regexp_extract(x, r"(?s)^---\n(.*?)\n---", 1))
    field = lambda k: F.trim(F.regexp_extract("front", f"(?m)^{k}: *(.*)$", 1))
    v = f.withColumn("name", field("name")).withColumn("description", field("description"))
    other = F.exists(F.regexp_extract_all("front", F.lit(r"(?m)^([a-z_-]+):"), 1), lambda k: ~k.isin(*_ALLOWED_KEYS))
    n = F.col("name")
    finding = (
        F.when(~x.startswith("---"), "no frontmatter").when(F.col("front") == "", "invalid format").when(other, "unexpected key").when(~F.col("front").rlike("(?m)^name:"), "no name").when(~F.col("front").rlike("(?m)^description:"), "no description").when((n != "") & ~n.rlike("^[a-z0-9-]+$"), "not hyphen-case")
        .when(n.startswith("-") | n.endswith("-") | n.contains("--"), "misplaced hyphen").when(F.length(n) > 64, "name too long").when(F.col("description").rlike("[<>]"), "angle brackets").when(F.length("description") > 1024, "description too long").otherwise("valid")
    )
    return v.select("id", finding.alias("finding"))


@query("SELECT doc_id || ':' || idx AS id, label, array_to_string(list_append(path, label), ' > ') AS full_label FROM (SELECT doc_id, idx, min(text) AS label, coalesce(min(heading_path), []) AS path FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL GROUP BY doc_id, idx)")
def j12_label_map(spark: SparkSession, d: str) -> DataFrame:
    """Each heading's id with its label and the labels above it."""
    h = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL").groupBy("doc_id", "idx").agg(F.min("text").alias("label"), F.coalesce(F.min("heading_path"), F.array().cast("array<string>")).alias("path"))
    return h.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("id"), "label", F.array_join(F.array_append("path", F.col("label")), " > ").alias("full_label"))


_MATCHES = [(1, '{"type": "person", "role": "buyer"}'), (2, '{"type": "organisation"}'), (3, '{"role": null}')]


@query("SELECT id, count(DISTINCT party_id) AS parties FROM parties, " + values(_MATCHES, "id, m") + " WHERE (json_extract_string(m, '$.type') IS NULL OR type = json_extract_string(m, '$.type')) AND (NOT contains(m, 'role') OR role IS NOT DISTINCT FROM json_extract_string(m, '$.role')) GROUP BY id")
def pred14_all_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many parties equal each pattern in every field it names, null among them; the patterns are unrolled."""
    import json

    p = table(spark, d, "parties").select("party_id", "type", "role").distinct()
    test = lambda m: [F.col(k).eqNullSafe(F.lit(v)) for k, v in json.loads(m).items()]
    hits = [F.when(H._all(test(m)), F.lit(k)) for k, m in _MATCHES]
    return p.select("party_id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("id")).groupBy("id").agg(F.count_distinct("party_id").alias("parties"))


# Stems of words that tell kinds of documents.
_BEGINS = r"(?:^|[^\p{L}])"
STEMS = {"privacy": "personal data|personal information|data subject|controller|processor|consent|retention|safeguard|disclosure", "litigation": "plaintiff|defendant|appellant|respondent|court|tribunal|judgment|motion", "governance": "board|shareholder|director|resolution|quorum", "risk_assessment": "risk|likelihood|severity|mitigat|control gap"}


@query("WITH l AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS profile, round_even(least(({' + '.join(f'CAST(regexp_matches(t, {_q(_BEGINS + w)}) AS INTEGER)' for w in ws.split('|'))}) / 3.0, 1.0), 2) AS score FROM l" for k, ws in STEMS.items()) + ") WHERE score >= 0.34")
def a12_active_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of documents by distinct stems at the beginning of words; three make a whole score."""
    low = F.lower("text")
    score = lambda ws: F.bround(F.least(sum((low.rlike(_BEGINS + w).cast("int") for w in ws.split("|")), F.lit(0)) / 3.0, F.lit(1.0)), 2)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("profile"), score(ws).alias("score")) for k, ws in STEMS.items()]))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", each.alias("x")).select("doc_id", "x.*").where("score >= 0.34")


#: Paragraphs that one run of the validation takes.
BATCH = 35


@query(f"SELECT matter_id, doc_id FROM (SELECT matter_id, doc_id, row_number() OVER (PARTITION BY matter_id ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL AND matter_id IS NOT NULL AND doc_id % 4 <> 0) WHERE k <= {BATCH}")
def w15_next_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next documents of each matter that no earlier run, here that of every fourth, has worked through, in batches of a set size."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND matter_id IS NOT NULL").select("matter_id", "doc_id")
    new = docs.join(docs.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "left_anti")
    return running_number(new, "matter_id", ["doc_id"], F.floor(F.col("doc_id") / 4096), "k").where(F.col("k") <= BATCH).select("matter_id", "doc_id")


# ---- files and streams

@query("SELECT * FROM " + values([("one.txt", "text", None), ("two.md", "# T", None), ("big.txt", None, "FILE_TOO_LARGE")], "name, text, code"))
def s18_file_tree(spark: SparkSession, d: str) -> DataFrame:
    """Files of a tree but for folders to skip; one over the cap keeps its row and gets a code."""
    path = scratch(spark)
    for name, text in (("a/one.txt", "text"), ("a/.git/config", "no"), ("b/two.md", "# T"), ("b/big.txt", "x" * 64)):
        put_file(spark, f"{path}/{name}", text.encode())
    t = S.read_tree(spark, path, most=32)
    return t.select(F.substring_index("path", "/", -1).alias("name"), F.decode("content", "utf-8").alias("text"), "code")


@query("SELECT * FROM " + values([("close", 1), ("open", 2)], "command, files"))
def r1_command_folder(spark: SparkSession, d: str) -> DataFrame:
    """New command files of a folder as a stream, each taken once."""
    path = scratch(spark)
    for k, command in enumerate(("open", "close", "open")):
        put_file(spark, f"{path}/in/{k}.json", f'{{"command": "{command}"}}\n'.encode())
    run_once(new_lines(spark, f"{path}/in", "command string"), f"{path}/out", f"{path}/state")
    return spark.read.schema("command string").parquet(f"{path}/out").groupBy("command").agg(F.count(F.lit(1)).cast("int").alias("files"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def r2_journal_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events written as an append-only journal of JSON lines, read as a stream; a broken line is passed over."""
    path = scratch(spark)
    table(spark, d, "events").select("user_id", "event_id").write.json(f"{path}/in")
    put_file(spark, f"{path}/in/broken.json", b"not json\n")
    run_once(new_lines(spark, f"{path}/in", "user_id long, event_id long"), f"{path}/out", f"{path}/state")
    return spark.read.schema("user_id long, event_id long").parquet(f"{path}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT ref_id FROM refs WHERE ref_id IS NOT NULL")
def r3_state_table(spark: SparkSession, d: str) -> DataFrame:
    """Batches appended to a state table, each key once however often it comes."""
    path = scratch(spark)
    r = table(spark, d, "refs").where("ref_id IS NOT NULL").select("ref_id")
    for batch in (r.where("ref_id % 2 = 0"), r.where("ref_id % 3 = 0"), r):
        append_new(batch, path, "ref_id").write.mode("append").parquet(path)
    return spark.read.schema("ref_id long").parquet(path)
