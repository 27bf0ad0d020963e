"""Named queries of the remaining surveyed operators: patches as rows, graph and date rules, tracked changes, small sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexmill.functions import text as T
from lexmill.operators.ordered import running_number
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


# ---- patches: the gate's rules over exploded operations

_DOC = '{"matter_type": null, "obligations": [{"description": "pay", "risk_level": null}], "parties": [{"name": "A"}], "hierarchy": [{"id": "n1", "source": "deterministic", "depth": 1}]}'
_TYPED = _DOC.replace('"matter_type": null', '"matter_type": "contract"')
_PATCHES = [
    (1, _DOC, '[{"op": "add", "path": "/parties/-", "value": {"name": "B", "evidence_id": "E1", "source_ref": "p1"}}]'), (2, _DOC, '{"op": "add"}'), (3, _DOC, '[{"op": "move", "path": "/x"}, {"op": "add", "path": "/parties/-"}, {"op": "remove"}]'),
    (4, _DOC, '[{"op": "add", "path": "/parties/-", "value": {"name": "C"}}]'), (5, _DOC, '[{"op": "add", "path": "/parties/-", "value": {"name": "C", "evidence_id": "E9", "source_ref": "p"}}]'), (6, _DOC, '[{"op": "add", "path": "/secrets/-", "value": {"name": "C", "evidence_id": "E1", "source_ref": "p"}}]'),
    (7, _DOC, '[{"op": "replace", "path": "/parties/0", "value": {"name": "Z", "evidence_id": "E1", "source_ref": "p"}}]'), (8, _TYPED, '[{"op": "replace", "path": "/matter_type", "value": "litigation"}]'), (9, _DOC, '[{"op": "replace", "path": "/matter_type", "value": "litigation"}]'),
    (10, _DOC, '[{"op": "remove", "path": "/parties/0"}]'), (11, _DOC, '[{"op": "remove", "path": "/hierarchy/0"}]'), (12, _DOC, '[{"op": "add", "path": "/hierarchy/-", "value": {"id": "n2", "source": "human", "depth": 4}}]'), (13, _DOC, '[{"op": "add", "path": "/hierarchy/-", "value": {"id": "n2", "source": "llm", "depth": 2, "parent": "n9"}}]'),
    (14, _DOC, '[{"op": "add", "path": "/hierarchy/-", "value": {"id": "n2", "source": "llm", "depth": 2, "parent": "n1"}}]'), (15, _DOC, '[{"op": "replace", "path": "/obligations/7/risk_level", "value": "high"}]'), (16, _DOC, '[{"op": "replace", "path": "/parties/0/name", "value": "A"}]'), (17, _DOC, '[{"op": "replace", "path": "/obligations/0/risk_level", "value": "high"}]'), (18, _DOC, "broken"),
]
# Operations, fields that hold entities, fields a patch may touch, evidence at hand, greatest depth of a hierarchy.
OPS, ENTITIES, ALLOWED, EVIDENCE, DEPTH = ("add", "replace", "remove"), ("obligations", "parties"), ("obligations", "parties", "hierarchy", "matter_type"), ("E1", "E2"), 2
_LIST = lambda xs: ", ".join(map(_q, xs))


@query(f"""WITH p AS (SELECT * FROM {values(_PATCHES, 'id, doc, patch')}),
 o AS (SELECT id, doc, k AS no, json_extract_string(x, '$.op') AS op, json_extract_string(x, '$.path') AS path, json_extract_string(x, '$.value') AS value, string_split(coalesce(json_extract_string(x, '$.path'), ''), '/') AS t FROM (SELECT id, doc, unnest(CAST(patch AS JSON[])) AS x, generate_subscripts(CAST(patch AS JSON[]), 1) AS k FROM p WHERE json_valid(patch) AND json_type(patch) = 'ARRAY')),
 v1 AS (SELECT id, 'V1' AS rule, 0 AS no FROM p WHERE NOT json_valid(patch) OR json_type(patch) <> 'ARRAY' UNION SELECT id, 'V1', no FROM o WHERE op IS NULL OR op NOT IN ({_LIST(OPS)}) OR path IS NULL OR (op IN ('add', 'replace') AND value IS NULL)),
 g AS (SELECT *, t[2] AS top, TRY_CAST(t[3] AS INTEGER) AS ix, t[4] AS sub, len(t) - 1 AS depth, starts_with(value, '{{') AS whole, CASE WHEN starts_with(value, '{{') THEN value END AS obj FROM o WHERE id NOT IN (SELECT id FROM v1)),
 h AS (SELECT id, no, op, path, top, ix, sub, depth, value, obj, whole, doc, coalesce(json_array_length(doc, '$.' || top), 0) AS have, json_extract_string(doc, '$.' || top || '[' || ix || ']' || CASE WHEN sub IS NULL THEN '' ELSE '.' || sub END) AS was FROM g),
 n AS (SELECT id, no, json_extract_string(obj, '$.id') AS node, json_extract_string(obj, '$.source') AS source, TRY_CAST(json_extract_string(obj, '$.depth') AS INTEGER) AS deep, json_extract_string(obj, '$.parent') AS parent FROM g WHERE op = 'add' AND top = 'hierarchy' AND whole)
 SELECT id, rule, CAST(no AS INTEGER) AS no FROM v1
 UNION SELECT id, 'V2', no FROM h WHERE op IN ('add', 'replace') AND top IN ({_LIST(ENTITIES)}) AND depth < 3 AND whole AND (json_extract_string(obj, '$.evidence_id') IS NULL OR json_extract_string(obj, '$.source_ref') IS NULL)
 UNION SELECT id, 'V3', no FROM h WHERE op IN ('add', 'replace') AND whole AND json_extract_string(obj, '$.evidence_id') NOT IN ({_LIST(EVIDENCE)})
 UNION SELECT id, 'V4', no FROM h WHERE top NOT IN ({_LIST(ALLOWED)})
 UNION SELECT id, 'V5', no FROM h WHERE op = 'replace' AND ((top = 'matter_type' AND coalesce(json_extract_string(doc, '$.matter_type'), '') <> '') OR (top IN ({_LIST(ENTITIES)}) AND depth = 2 AND ix < have))
 UNION SELECT id, 'V6', no FROM h WHERE op = 'remove' AND top <> 'hierarchy'
 UNION SELECT id, 'V7', no FROM n WHERE source IS NULL OR source NOT IN ('deterministic', 'llm') OR deep > {DEPTH} OR (source = 'llm' AND parent <> '' AND parent NOT IN ('n1') AND parent NOT IN (SELECT node FROM n m WHERE m.id = n.id))
 UNION SELECT id, 'V8', no FROM h WHERE op IN ('replace', 'remove') AND top IN ({_LIST(ENTITIES + ('hierarchy',))}) AND (ix IS NULL OR ix >= have)
 UNION SELECT id, 'V9', no FROM h WHERE op = 'replace' AND was = value""")
def h28_gate_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules V1 to V9 over the operations of each patch; an error of form (V1) keeps the others from running."""
    p = fixture(spark, _PATCHES, "id int, doc string, patch string").withColumn("ops", F.from_json("patch", "array<struct<op string, path string, value string>>"))
    listed = F.coalesce(F.trim("patch").startswith("["), F.lit(False)) & F.col("ops").isNotNull()
    o = p.where(listed).select("id", "doc", F.posexplode("ops").alias("no", "o")).select("id", "doc", (F.col("no") + 1).alias("no"), "o.*")
    bad = F.col("op").isNull() | ~F.col("op").isin(*OPS) | F.col("path").isNull() | F.col("op").isin("add", "replace") & F.col("value").isNull()
    v1 = p.where(~listed).select("id", F.lit(0).alias("no")).unionByName(o.where(bad).select("id", "no")).withColumn("rule", F.lit("V1"))
    t = F.split("path", "/")
    g = o.join(v1.select("id").distinct(), "id", "left_anti")
    j = lambda c, path: F.get_json_object(c, path)
    g = g.select("*", F.get(t, F.lit(1)).alias("top"), F.get(t, F.lit(2)).try_cast("int").alias("at"), F.get(t, F.lit(3)).alias("sub"), (F.size(t) - 1).alias("depth"), F.col("value").startswith("{").alias("whole"))
    g = g.withColumn("have", F.coalesce(*[F.when(F.col("top") == f, F.size(F.from_json(j("doc", f"$.{f}"), "array<string>"))) for f in (*ENTITIES, "hierarchy")], F.lit(0)))
    was = F.try_element_at(F.from_json(F.get(F.from_json(F.try_element_at(F.from_json("doc", "map<string,string>"), F.col("top")), "array<string>"), F.col("at")), "map<string,string>"), F.col("sub"))
    entity = F.col("top").isin(*ENTITIES)
    write = F.col("op").isin("add", "replace")
    # Nodes that one patch adds are a handful; their ids travel with the patch.
    added = g.where("op = 'add' AND top = 'hierarchy' AND whole").groupBy("id").agg(F.collect_set(j("value", "$.id")).alias("nodes"))
    g = g.join(added, "id", "left").withColumn("nodes", F.concat(F.from_json(j("doc", "$.hierarchy[*].id"), "array<string>"), F.coalesce("nodes", F.array().cast("array<string>"))))
    g = g.withColumn("nodes", F.coalesce("nodes", F.array(j("doc", "$.hierarchy[0].id"))))
    node = (F.col("op") == "add") & (F.col("top") == "hierarchy") & F.col("whole")
    source, parent = j("value", "$.source"), j("value", "$.parent")
    rules = {
        "V2": write & entity & (F.col("depth") < 3) & F.col("whole") & (j("value", "$.evidence_id").isNull() | j("value", "$.source_ref").isNull()), "V3": write & F.col("whole") & ~j("value", "$.evidence_id").isin(*EVIDENCE), "V4": ~F.col("top").isin(*ALLOWED),
        "V5": (F.col("op") == "replace") & ((F.col("top") == "matter_type") & (F.coalesce(j("doc", "$.matter_type"), F.lit("")) != "") | entity & (F.col("depth") == 2) & (F.col("at") < F.col("have"))), "V6": (F.col("op") == "remove") & (F.col("top") != "hierarchy"),
        "V7": node & (source.isNull() | ~source.isin("deterministic", "llm") | F.coalesce(j("value", "$.depth").try_cast("int") > DEPTH, F.lit(False)) | (source == "llm") & F.coalesce((parent != "") & ~F.array_contains("nodes", parent), F.lit(False))),
        "V8": F.col("op").isin("replace", "remove") & F.col("top").isin(*ENTITIES, "hierarchy") & (F.col("at").isNull() | (F.col("at") >= F.col("have"))), "V9": (F.col("op") == "replace") & (was == F.col("value")),
    }
    hits = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())
    return g.select("id", "no", F.explode(hits).alias("rule")).unionByName(v1).select("id", "rule", "no").distinct()


_FROZEN = '{"parties": [{"name": "A", "role": "buyer"}], "obligations": [{"description": "pay", "risk_level": null}], "matter_type": ""}'
_ENRICHED = '{"parties": [{"name": "A", "role": "buyer"}, {"name": "B", "role": "seller"}], "obligations": [{"description": "pay", "risk_level": "high"}], "matter_type": "contract-7"}'
_EXPECT = [
    ("f1", "x1", "required", "field_filled", "$.matter_type", None, None), ("f1", "x2", "required", "value_equals", "$.obligations[0].risk_level", "high", None), ("f1", "x3", "bonus", "value_one_of", "$.parties[1].role", "seller|buyer", None), ("f1", "x4", "required", "value_regex", "$.matter_type", "[a-z]+-[0-9]", None), ("f1", "x5", "required", "entity_added", "parties", "B", None),
    ("f1", "x6", "bonus", "entity_added", "parties", "A", None), ("f1", "x7", "required", "unchanged", "$.parties[0].name", None, None), ("f1", "x8", "required", "unchanged", "$.matter_type", None, None), ("f1", "x9", "bonus", "field_filled", "$.nothing", None, None), ("f1", "n1", "forbidden", "no_entity_added", "parties", "B", None), ("f1", "n2", "forbidden", "path_untouched", "$.parties[0].name", None, None),
]
_NEW_SQL = f"len(list_filter(json_extract_string({_q(_ENRICHED)}, '$.parties[*].name'), lambda x: x = want)) > len(list_filter(json_extract_string({_q(_FROZEN)}, '$.parties[*].name'), lambda x: x = want))"
_GRADED_SQL = f"""graded AS (SELECT fixture, id, credit, coalesce(CASE kind WHEN 'field_filled' THEN now IS NOT NULL AND now <> '' WHEN 'value_equals' THEN now = want WHEN 'value_one_of' THEN list_contains(string_split(want, '|'), now) WHEN 'value_regex' THEN regexp_full_match(now, want) WHEN 'entity_added' THEN {_NEW_SQL} WHEN 'unchanged' THEN now IS NOT DISTINCT FROM was WHEN 'no_entity_added' THEN {_NEW_SQL} WHEN 'path_untouched' THEN now IS DISTINCT FROM was END, false) AS ok
 FROM (SELECT *, CASE WHEN starts_with(path, '$') THEN json_extract_string({_q(_ENRICHED)}, path) END AS now, CASE WHEN starts_with(path, '$') THEN json_extract_string({_q(_FROZEN)}, path) END AS was FROM {values(_EXPECT, 'fixture, id, credit, kind, path, want, x')}))"""


def _graded(spark: SparkSession) -> DataFrame:
    """Each expectation of a label set against the result before and after a patch; a forbidden one is ok if it was broken."""
    e = fixture(spark, _EXPECT, "fixture string, id string, credit string, kind string, path string, want string, x string").withColumn("before", F.lit(_FROZEN)).withColumn("after", F.lit(_ENRICHED))
    at = lambda c: F.expr(f"get_json_object({c}, path)")
    now, was = at("after"), at("before")
    names = lambda c: F.size(F.filter(F.from_json(F.get_json_object(c, "$.parties"), "array<struct<name string>>")["name"], lambda x: x == F.col("want")))
    new = names("after") > names("before")
    kind = F.col("kind")
    ok = (
        F.when(kind == "field_filled", now.isNotNull() & (now != "")).when(kind == "value_equals", now == F.col("want")).when(kind == "value_one_of", F.array_contains(F.split("want", "[|]"), now)).when(kind == "value_regex", F.expr("get_json_object(after, path) RLIKE concat('^(?:', want, ')$')"))
        .when(kind.isin("entity_added", "no_entity_added"), new).when(kind == "unchanged", now.eqNullSafe(was)).when(kind == "path_untouched", ~now.eqNullSafe(was))
    )
    return e.select("fixture", "id", "credit", F.coalesce(ok, F.lit(False)).alias("ok"))


@query(f"WITH {_GRADED_SQL} SELECT * FROM graded")
def h29_patch_grading(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark)


@query(f"WITH {_GRADED_SQL} SELECT fixture, count(*) FILTER (credit = 'required' AND ok) AS required_pass, count(*) FILTER (credit = 'required') AS required_total, count(*) FILTER (credit = 'bonus' AND ok) AS bonus_pass, count(*) FILTER (credit = 'bonus') AS bonus_total, count(*) FILTER (credit = 'forbidden' AND ok) AS violations FROM graded GROUP BY fixture")
def a19_grading_score(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c, extra=F.lit(True): F.count_if((F.col("credit") == c) & extra)
    return _graded(spark).groupBy("fixture").agg(of("required", F.col("ok")).alias("required_pass"), of("required").alias("required_total"), of("bonus", F.col("ok")).alias("bonus_pass"), of("bonus").alias("bonus_total"), of("forbidden", F.col("ok")).alias("violations"))


# ---- graph and date rules

@query("""WITH n AS (SELECT doc_id, count(*) FILTER (block_type = 'list_item') AS salient, count(*) FILTER (block_type = 'list_item' AND contains(lower(text), 'shall')) AS high FROM (SELECT DISTINCT doc_id, idx, block_type, text FROM blocks) GROUP BY doc_id), b AS (SELECT * FROM (VALUES ('comprehensive', 0.85, 0.95), ('detailed', 0.60, 0.75), ('overview', 0.30, 0.45)) t(band, low, up))
 SELECT doc_id, band, salient, high AS floor, least(greatest(CAST(round_even(CAST(salient * low AS DOUBLE), 0) AS BIGINT), high), salient) AS target_low, CAST(round_even(CAST(salient * up AS DOUBLE), 0) AS BIGINT) AS target_high FROM n, b WHERE salient > 0""")
def d21_density_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many of a document's items a diagram of each band shows; items of high risk set a floor."""
    n = table(spark, d, "blocks").select("doc_id", "idx", "block_type", "text").distinct().groupBy("doc_id").agg(F.count_if(F.col("block_type") == "list_item").alias("salient"), F.count_if((F.col("block_type") == "list_item") & F.lower("text").contains("shall")).alias("floor")).where("salient > 0")
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, lo, hi in (("comprehensive", 0.85, 0.95), ("detailed", 0.60, 0.75), ("overview", 0.30, 0.45))]))
    r = n.select("*", bands.alias("b"))
    share = lambda c: F.bround(F.col("salient") * F.col(c), 0).cast("long")
    return r.select("doc_id", "b.band", "salient", "floor", F.least(F.greatest(share("b.lo"), "floor"), "salient").alias("target_low"), share("b.hi").alias("target_high"))


@query("""WITH e AS (SELECT DISTINCT doc_id, lower(trim(parent)) AS p, lower(trim(child)) AS c FROM ownership_links WHERE doc_id IS NOT NULL AND trim(parent) <> '' AND trim(child) <> ''), o AS (SELECT doc_id, p, count(*) AS n FROM e GROUP BY doc_id, p), n AS (SELECT doc_id, count(DISTINCT x) AS nodes FROM (SELECT doc_id, p AS x FROM e UNION ALL SELECT doc_id, c FROM e) GROUP BY doc_id), l AS (SELECT doc_id, count(*) AS edges FROM e GROUP BY doc_id)
 SELECT doc_id, nodes, edges, max(n) AS out_degree, CASE WHEN max(n) >= 8 THEN 'split' WHEN max(n) >= 7 THEN 'warn' ELSE 'green' END AS flowchart, CASE WHEN nodes >= 21 THEN 'split' WHEN nodes >= 13 OR edges > 2.5 * nodes THEN 'warn' ELSE 'green' END AS entities, CASE WHEN nodes >= 13 THEN 'split' WHEN nodes >= 9 THEN 'warn' ELSE 'green' END AS participants, CASE WHEN max(n) >= 16 THEN 'split' WHEN max(n) >= 9 THEN 'warn' ELSE 'green' END AS siblings
 FROM o JOIN n USING (doc_id) JOIN l USING (doc_id) GROUP BY doc_id, nodes, edges""")
def d22_geometry_bands(spark: SparkSession, d: str) -> DataFrame:
    """Width and size of each document's ownership graph against the bands of each kind of diagram."""
    low = lambda c: F.lower(F.trim(c))
    e = table(spark, d, "ownership_links").where("doc_id IS NOT NULL AND trim(parent) <> '' AND trim(child) <> ''").select("doc_id", low("parent").alias("p"), low("child").alias("c")).distinct()
    out = e.groupBy("doc_id", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("out_degree"), F.sum("n").alias("edges"))
    nodes = e.select("doc_id", F.explode(F.array("p", "c")).alias("x")).groupBy("doc_id").agg(F.count_distinct("x").alias("nodes"))
    band = lambda c, warn, split, extra=F.lit(False): F.when(F.col(c) >= split, "split").when((F.col(c) >= warn) | extra, "warn").otherwise("green")
    r = nodes.join(out, "doc_id")
    return r.select("doc_id", "nodes", "edges", "out_degree", band("out_degree", 7, 8).alias("flowchart"), band("nodes", 13, 21, F.col("edges") > 2.5 * F.col("nodes")).alias("entities"), band("nodes", 9, 13).alias("participants"), band("out_degree", 9, 16).alias("siblings"))


# Days that service adds, by jurisdiction and method, calendar days but for court days; parameters, as sources differ on some.
SERVICE = [("Colorado", "electronic", 0, "calendar"), ("Colorado", "mail", 3, "calendar"), ("Federal", "electronic", 0, "calendar"), ("Federal", "mail", 3, "calendar"), ("California", "electronic", 2, "court"), ("California", "mail", 5, "calendar"), ("California", "mail_out_of_state", 10, "calendar"), ("New York", "electronic", 5, "calendar"), ("New York", "mail", 5, "calendar"), ("New York", "mail_out_of_state", 6, "calendar"), ("Florida", "electronic", 0, "calendar"), ("Florida", "mail", 5, "calendar"), ("Georgia", "electronic", 3, "calendar"), ("Georgia", "mail", 3, "calendar"), ("Texas", "electronic", 0, "calendar"), ("Texas", "mail", 3, "calendar")]
_PLACES = sorted({p for p, *_ in SERVICE})
#: Days of holiday of the calendar that court days skip.
HOLIDAYS = ["1995-01-02", "1995-07-04", "1996-01-01", "1996-07-04", "1996-12-25", "1997-01-01", "1997-07-04", "1997-12-25"]


def _court_days(start: Column, n: Column, holidays: Column) -> Column:
    """The n-th day after ``start`` that is no weekend and no holiday; looks at twice the days and a month more, in which it lies."""
    days = F.filter(F.sequence(F.date_add(start, 1), F.date_add(start, n * 2 + 31)), lambda x: (F.weekday(x) < 5) & ~F.array_contains(holidays, x))
    return F.when(n <= 0, start).otherwise(F.get(days, n - 1))


def _roll(day: Column, holidays: Column) -> Column:
    """The day itself, or the next that is no weekend and no holiday."""
    return F.get(F.filter(F.sequence(day, F.date_add(day, 31)), lambda x: (F.weekday(x) < 5) & ~F.array_contains(holidays, x)), F.lit(0))


_HOL_SQL = "[" + ", ".join(f"DATE '{x}'" for x in HOLIDAYS) + "]"
_BUSY_SQL = lambda x: f"isodow({x}) < 6 AND NOT list_contains({_HOL_SQL}, {x})"
_DAYS_SQL = lambda a, n: f"list_transform(range(0, {n}), lambda k: CAST({a} + CAST(k AS INTEGER) AS DATE))"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 21 AS INTEGER) AS n FROM orders)
 SELECT o_orderkey, n, CASE WHEN n < 11 THEN CASE WHEN n = 0 THEN list_filter({_DAYS_SQL('day', 32)}, lambda x: {_BUSY_SQL('x')})[1] ELSE list_filter({_DAYS_SQL('day + 1', '2 * n + 31')}, lambda x: {_BUSY_SQL('x')})[n] END ELSE list_filter({_DAYS_SQL('day + n', 32)}, lambda x: {_BUSY_SQL('x')})[1] END AS due FROM o""")
def d8_court_days(spark: SparkSession, d: str) -> DataFrame:
    """Periods of under eleven days skip weekends and holidays; longer ones count every day and roll forward from a day off."""
    off = F.array(*[F.lit(x).cast("date") for x in HOLIDAYS])
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 21).cast("int").alias("n"))
    due = F.when(F.col("n") < 11, _roll(_court_days(F.col("day"), F.col("n"), off), off)).otherwise(_roll(F.date_add("day", F.col("n")), off))
    return o.select("o_orderkey", "n", due.alias("due"))


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, [{_LIST(_PLACES)}][1 + CAST(o_orderkey % {len(_PLACES)} AS INTEGER)] AS place, ['electronic', 'mail'][1 + CAST(o_orderkey % 2 AS INTEGER)] AS method FROM orders)
 SELECT o_orderkey, place, method, CASE WHEN unit = 'court' THEN list_filter({_DAYS_SQL('day + 30 + 1', 60)}, lambda x: {_BUSY_SQL('x')})[days] ELSE CAST(day + 30 + days AS DATE) END AS due FROM o JOIN {values(SERVICE, 'p, m, days, unit')} ON p = place AND m = method""")
def d9_service_days(spark: SparkSession, d: str) -> DataFrame:
    """Thirty days and what the method of service adds where the case is heard."""
    off = F.array(*[F.lit(x).cast("date") for x in HOLIDAYS])
    places = F.array(*map(F.lit, _PLACES))
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.get(places, (F.col("o_orderkey") % len(_PLACES)).cast("int")).alias("place"), F.when(F.col("o_orderkey") % 2 == 0, "electronic").otherwise("mail").alias("method"))
    s = fixture(spark, SERVICE, "place string, method string, days int, unit string")
    end = F.date_add("day", 30)
    due = F.when(F.col("unit") == "court", _court_days(end, F.col("days"), off)).otherwise(F.date_add(end, F.col("days")))
    return o.join(F.broadcast(s), ["place", "method"]).select("o_orderkey", "place", "method", due.alias("due"))


# ---- disputes, console, workbook rows

_CELLS = [
    ("Disclaimer", 1, ["Terms of use"]), ("Disclaimer", 2, ["Updated as of 31 December 2024"]), ("Cases", 1, ["Investment disputes"]), ("Cases", 2, ["NO.", "SHORT CASE NAME", "STATUS", "FO_STATUS", "DECISIONS"]),
    ("Cases", 3, ["1", "Alpha v. Betaland", "Pending", "", ""]), ("Cases", 4, ["2.0", "Gamma v. Deltaland", "Decided", "Pending", "Award dated 3 March 2019"]), ("Cases", 5, ["note", "not a case", "", "", ""]), ("Cases", 6, ["3", "Eps v. Zetaland", "Settled", "", "Award dated 9 May 2022; Order dated 31 February 2023"]), ("Cases", 7, ["4", "Old v. Land", "Decided", "", "Award dated 2 June 2001"]), ("Cases", 8, ["", "", "", "", ""]),
]
_MONTHS = "january february march april may june july august september october november december".split()
_DISPUTES_SQL = f"""c AS (SELECT * FROM {values(_CELLS, 'sheet, row_no, cells')} WHERE NOT contains(lower(sheet), 'disclaimer')), head AS (SELECT min(row_no) AS row_no FROM c WHERE list_contains(cells, 'NO.') AND list_contains(cells, 'SHORT CASE NAME')),
 r AS (SELECT CAST(TRY_CAST(cells[1] AS DOUBLE) AS INTEGER) AS no, cells[2] AS name, cells[3] AS status, cells[4] AS follow_on, cells[5] AS decisions FROM c, head WHERE c.row_no > head.row_no AND TRY_CAST(nullif(cells[1], '') AS DOUBLE) IS NOT NULL)"""
_LAST_SQL = f"list_max(list_filter(list_transform(regexp_extract_all(decisions, 'dated +([0-9]+ +[A-Za-z]+ +[0-9]{{4}})', 1), lambda x: TRY_CAST(split_part(x, ' ', 3) || '-' || lpad(CAST(list_position([{_LIST(_MONTHS)}], lower(split_part(x, ' ', 2))) AS VARCHAR), 2, '0') || '-' || lpad(split_part(x, ' ', 1), 2, '0') AS DATE)), lambda y: y IS NOT NULL))"


def dispute_rows(cells: DataFrame) -> DataFrame:
    """Rows under the header of the first sheet that is no disclaimer, with a number in the first column."""
    c = cells.where(~F.lower("sheet").contains("disclaimer"))
    head = c.where(F.array_contains("cells", "NO.") & F.array_contains("cells", "SHORT CASE NAME")).groupBy("sheet").agg(F.min("row_no").alias("head"))
    r = c.join(head, "sheet").where("row_no > head")
    at = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    return r.select(at(0).try_cast("double").cast("int").alias("no"), at(1).alias("name"), at(2).alias("status"), at(3).alias("follow_on"), at(4).alias("decisions")).where("no IS NOT NULL")


@query(f"WITH {_DISPUTES_SQL} SELECT no, name, status FROM r")
def s6_dispute_rows(spark: SparkSession, d: str) -> DataFrame:
    return dispute_rows(fixture(spark, _CELLS, "sheet string, row_no int, cells array<string>")).select("no", "name", "status")


_NAMES = [("a", "cases_31December2024.xlsx"), ("b", "plain.xlsx")]


@query(f"""WITH t AS (SELECT max(nullif(regexp_extract(x, 'Updated as of +(.+?) *$', 1), '')) AS told FROM (SELECT unnest(cells) AS x FROM {values(_CELLS, 'sheet, row_no, cells')} WHERE contains(lower(sheet), 'disclaimer')))
 SELECT 'sheet' AS file, coalesce(told, 'unknown') AS snapshot FROM t UNION ALL SELECT id, coalesce(nullif(regexp_extract(file, '[0-9]{{1,2}}[A-Za-z]+[0-9]{{4}}'), ''), 'unknown') FROM {values(_NAMES, 'id, file')}""")
def s7_snapshot_date(spark: SparkSession, d: str) -> DataFrame:
    """The date that the disclaimer states, else the one in the file's name, else unknown."""
    c = fixture(spark, _CELLS, "sheet string, row_no int, cells array<string>").where(F.lower("sheet").contains("disclaimer"))
    told = c.select(F.explode("cells").alias("x")).agg(F.max(F.nullif(F.regexp_extract("x", "Updated as of +(.+?) *$", 1), F.lit(""))).alias("told"))
    by_name = fixture(spark, _NAMES, "file string, name string").select("file", F.coalesce(F.nullif(F.regexp_extract("name", "[0-9]{1,2}[A-Za-z]+[0-9]{4}", 0), F.lit("")), F.lit("unknown")).alias("snapshot"))
    return told.select(F.lit("sheet").alias("file"), F.coalesce("told", F.lit("unknown")).alias("snapshot")).unionByName(by_name)


@query(f"WITH {_DISPUTES_SQL}, x AS (SELECT *, {_LAST_SQL} AS last FROM r) SELECT no, CAST(last AS VARCHAR) AS last_decision, concat_ws('; ', CASE WHEN contains(lower(status), 'pending') OR contains(lower(status), 'data not available') THEN 'pending' END, CASE WHEN contains(lower(follow_on), 'pending') THEN 'follow-on pending' END, CASE WHEN NOT contains(lower(status), 'pending') AND NOT contains(lower(status), 'data not available') AND NOT contains(lower(follow_on), 'pending') AND last >= DATE '2021-01-01' THEN 'recent ' || CAST(last AS VARCHAR) END) AS live_check FROM x")
def h45_live_check(spark: SparkSession, d: str) -> DataFrame:
    """Cases to look up again: pending, follow-on pending, else decided on or after 2021-01-01."""
    r = dispute_rows(fixture(spark, _CELLS, "sheet string, row_no int, cells array<string>"))
    months = F.array(*map(F.lit, _MONTHS))
    day = lambda x: F.try_to_date(F.concat_ws("-", F.split_part(x, F.lit(" "), F.lit(3)), F.lpad(F.array_position(months, F.lower(F.split_part(x, F.lit(" "), F.lit(2)))).cast("string"), 2, "0"), F.lpad(F.split_part(x, F.lit(" "), F.lit(1)), 2, "0")), "yyyy-MM-dd")
    last = F.array_max(F.transform(F.regexp_extract_all("decisions", F.lit("dated +([0-9]+ +[A-Za-z]+ +[0-9]{4})"), 1), day))
    r = r.withColumn("last", last)
    open_, follow = F.lower("status").contains("pending") | F.lower("status").contains("data not available"), F.lower("follow_on").contains("pending")
    recent = F.when(~open_ & ~follow & (F.col("last") >= "2021-01-01"), F.concat_ws(" ", F.lit("recent"), F.col("last").cast("string")))
    return r.select("no", F.col("last").cast("string").alias("last_decision"), F.concat_ws("; ", F.when(open_, "pending"), F.when(follow, "follow-on pending"), recent).alias("live_check"))


_CUT_SQL = lambda x, n: f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END"


@query(f"SELECT DISTINCT ref_id, concat_ws(' | ', CAST(ref_id AS VARCHAR), {_CUT_SQL('replace(coalesce(title, {0}), chr(10), {1})'.format(chr(39) * 2, chr(39) + ' / ' + chr(39)), 40)}, coalesce(container, '')) AS line FROM refs")
def k11_console_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per record with its cells cut at a width and line breaks shown as strokes."""
    cell = F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" / "))
    short = F.when(F.length(cell) > 40, F.concat(F.substring(cell, 1, 40), F.lit("…"))).otherwise(cell)
    return table(spark, d, "refs").select("ref_id", F.concat_ws(" | ", F.col("ref_id").cast("string"), short, F.coalesce("container", F.lit(""))).alias("line")).distinct()


# ---- tracked changes

_SEGS = [
    (1, 1, "regular", "pays the "), (1, 2, "ins", "a buyer"), (1, 3, "regular", "5"), (1, 4, "del", "euros now"), (2, 1, "regular", "signs in"), (2, 2, "ins", "to force"), (3, 1, "regular", "end "), (3, 2, "regular", " start"), (4, 1, "ins", "the"), (4, 2, "regular", " the the rule"), (5, 1, "del", "someText"), (5, 2, "regular", " section5 and"), (5, 3, "regular", " 10years later"), (6, 1, "regular", "well-"), (6, 2, "ins", "known 1st"), (7, 1, "regular", "because of "), (7, 2, "del", "rain"),
]
# Rules on neighbouring segments (which kinds, end of the one, beginning of the other) and on single ones.
_PAIR_RULES = {
    "binding_word": ("l.kind = 'regular' AND r.kind IN ('ins', 'del')", (r"(?i)(?:^|[\s(\[{\"“‘])(?:to|of|in|for|on|at|by|with|from|into|under|over|within|between|among|against|before|after|about)\s*$", r"\S")), "article_collision": ("l.kind = 'regular' AND r.kind IN ('ins', 'del')", (r"(?i)(?:^|[\s(\[{\"“‘])(?:the|a|an)\s*$", r"(?i)^\s*(?:the|a|an)(?:[^\p{L}]|$)")),
    "alpha_collision": ("true", (r"\p{L}$", r"^\p{L}")), "digit_at_boundary": ("(l.kind = 'regular') <> (r.kind = 'regular')", (r"[0-9]$", r"^\p{L}")), "digit_after_word": ("(l.kind = 'regular') <> (r.kind = 'regular')", (r"\p{L}$", r"^[0-9]")), "double_space": ("true", (r" $", r"^ ")),
}
_SEG_RULES = {"bare_article": (r"(?i)^\s*(?:the|a|an)\s*$", True), "double_article": (r"(?i)(?:^|[^\p{L}])(?:the|a|an)\s+(?:the|a|an)(?:[^\p{L}]|$)", False), "camel_case": (r"[a-z][A-Z]", False), "word_then_digit": (r"[a-z]{2,}[0-9]", False), "digit_then_word": (r"[0-9][a-z]{3,}", False)}


@query(f"WITH s AS {values(_SEGS, 'para, seg, kind, part')} " + " UNION ALL ".join([*[f"SELECT l.para, l.seg, '{n}' AS rule FROM s l JOIN s r ON l.para = r.para AND r.seg = l.seg + 1 WHERE {c} AND regexp_matches(l.part, {_q(a)}) AND regexp_matches(r.part, {_q(b)})" for n, (c, (a, b)) in _PAIR_RULES.items()], *[f"SELECT para, seg, '{n}' FROM s WHERE regexp_matches(part, {_q(p)})" + (" AND kind IN ('ins', 'del')" if tc else "") for n, (p, tc) in _SEG_RULES.items()]]))
def h38_segment_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Rules on neighbouring segments and on single ones; a paragraph's segments are ordered by one window."""
    w = Window.partitionBy("para").orderBy("seg")
    s = fixture(spark, _SEGS, "para int, seg int, kind string, part string").withColumn("nk", F.lead("kind").over(w)).withColumn("np", F.lead("part").over(w))
    change = {"l.kind = 'regular' AND r.kind IN ('ins', 'del')": (F.col("kind") == "regular") & F.col("nk").isin("ins", "del"), "true": F.lit(True), "(l.kind = 'regular') <> (r.kind = 'regular')": (F.col("kind") == "regular") != (F.col("nk") == "regular")}
    hits = [F.when(change[c] & F.col("part").rlike(a) & F.col("np").rlike(b), F.lit(n)) for n, (c, (a, b)) in _PAIR_RULES.items()]
    hits += [F.when(F.col("part").rlike(p) & (F.col("kind").isin("ins", "del") if tc else F.lit(True)), F.lit(n)) for n, (p, tc) in _SEG_RULES.items()]
    return s.select("para", "seg", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("rule"))


_NOOPS = [(1, ["i:a", "d:a", "r:x"]), (2, ["d:b", "i:a", "d:a", "i:b"]), (3, ["i:", "r:y", "d:"]), (4, ["i:new", "r:z"]), (5, ["d:a", "i:a", "d:a", "i:a", "i:c"]), (6, [])]


@query("WITH RECURSIVE t AS (SELECT id, '|' || coalesce(array_to_string(list_filter(segs, lambda x: x NOT IN ('i:', 'd:')), '||'), '') || '|' AS s, 0 AS k FROM " + values(_NOOPS, "id, segs") + r" UNION ALL SELECT id, n, k + 1 FROM (SELECT id, k, s, regexp_replace(s, '\|i:a\|\|d:a\||\|d:a\|\|i:a\||\|i:b\|\|d:b\||\|d:b\|\|i:b\|', '') AS n FROM t) WHERE n <> s) SELECT id, CASE arg_max(s, k) WHEN '' THEN '||' ELSE arg_max(s, k) END AS kept, CAST(max(k) AS INTEGER) AS pairs FROM t GROUP BY id")
def h39_noop_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Empty changes go, then neighbouring insertions and deletions of one text, again and again until none is left."""
    t = fixture(spark, _NOOPS, "id int, segs array<string>").withColumn("segs", F.filter("segs", lambda x: ~x.isin("i:", "d:")))
    # A stack: a change that undoes the one on top takes it away.
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("pairs"))
    undoes = lambda a, b: (F.substring(a, 1, 1).isin("i", "d")) & (F.substring(b, 1, 1).isin("i", "d")) & (F.substring(a, 1, 1) != F.substring(b, 1, 1)) & (F.substring(a, 3, 1 << 20) == F.substring(b, 3, 1 << 20))
    top = lambda acc: F.try_element_at(acc["stack"], F.lit(-1))
    step = lambda acc, x: F.when(F.coalesce(undoes(top(acc), x), F.lit(False)), F.struct(F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1).alias("stack"), (acc["pairs"] + 1).alias("pairs"))).otherwise(F.struct(F.array_append(acc["stack"], x).alias("stack"), acc["pairs"].alias("pairs")))
    out = t.select("id", F.aggregate("segs", start, step).alias("r"))
    return out.select("id", F.concat(F.lit("|"), F.array_join("r.stack", "||"), F.lit("|")).alias("kept"), F.col("r.pairs").alias("pairs"))


# Numbering formats, the first that fits being taken.
NUMBERING = ((r"^%([0-9]+)\. sz\. [Mm]elléklet$", r"Annex %$1"), (r"^[Aa]rt(?:icolo|ículo|igo|ykuł|ikel|icle) %([0-9]+)$", r"Article %$1"), (r"^§ *%([0-9]+)$", r"Section %$1"), (r"^[Aa]llegato %([0-9]+)$", r"Annex %$1"), (r"^[Aa]nlage %([0-9]+)$", r"Schedule %$1"), (r"^[Zz]ałącznik (?:nr )?%([0-9]+)$", r"Annex %$1"))
_FORMATS = [(1, "%1. sz. Melléklet"), (2, "Artikel %2"), (3, "§ %1"), (4, "%1.%2"), (5, "Załącznik nr %1"), (6, "")]


@query("SELECT id, CASE " + " ".join(f"WHEN regexp_matches(x, {_q(a)}) THEN regexp_replace(x, {_q(a)}, {_q(b.replace('$', chr(92)))})" for a, b in NUMBERING) + f" ELSE x END AS translated FROM {values(_FORMATS, 'id, x')}")
def t23_numbering(spark: SparkSession, d: str) -> DataFrame:
    out = F.col("x")
    for a, b in reversed(NUMBERING):
        out = F.when(F.col("x").rlike(a), F.regexp_replace("x", a, b)).otherwise(out)
    return fixture(spark, _FORMATS, "id int, x string").select("id", out.alias("translated"))


# Words that a translation from French should not hold, and contexts in which they may stand.
REMNANTS = W(r"ledit|ladite|ci-après|dommages-intérêts|nonobstant|société|préavis")
ALLOWED_AROUND = r"société générale|force majeure"
_REM = r"(?i)(.{0,30}(?:^|[^\p{L}\p{N}_])(?:ledit|ladite|ci-après|dommages-intérêts|nonobstant|société|préavis)(?:$|[^\p{L}\p{N}_]).{0,30})"
_REM_FIX = [(-1, 0, "The loan from Société Générale is due."), (-2, 0, "The party ci-après named pays."), (-3, 0, "No remnant.")]


@query(rf"SELECT DISTINCT doc_id, idx, around FROM (SELECT doc_id, idx, unnest(regexp_extract_all(replace(text, chr(10), ' '), {_q(_REM)}, 1)) AS around FROM (SELECT doc_id, idx, text FROM blocks WHERE text IS NOT NULL AND starts_with(lower(lang), 'en') UNION ALL SELECT * FROM {values(_REM_FIX, 'doc_id, idx, text')})) WHERE NOT regexp_matches(lower(around), '{ALLOWED_AROUND}')")
def t34_remnants(spark: SparkSession, d: str) -> DataFrame:
    """Words of the source language in English text with thirty characters around, but for allowed contexts."""
    b = table(spark, d, "blocks").where("text IS NOT NULL").where(F.lower("lang").startswith("en")).select("doc_id", "idx", "text").unionByName(fixture(spark, _REM_FIX, "doc_id long, idx int, text string"))
    return b.select("doc_id", "idx", F.explode(F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(_REM.replace("(?i)", "(?iu)")), 1)).alias("around")).where(~F.lower("around").rlike(ALLOWED_AROUND)).distinct()


# Sounds and the spelling each is brought to, in order.
SOUNDS = (("ph|gh", "f"), ("qu|ck|ch|q|k", "c"), ("ps|z", "s"), ("dg|dj", "j"), ("eigh|ai|ay|ei", "a"), ("oa|ow|oe", "o"), ("ee|ea|ie", "e"), ("oo|ew|ue|ou", "u"), ("y", "i"), ("e$", ""))


def _sound_sql(x: str) -> str:
    for a, b in SOUNDS:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    for c in "bcdfghjlmnprstvwx":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


@query(f"SELECT sound, count(DISTINCT word) AS words, min(word) AS first, max(word) AS last FROM (SELECT word, {_sound_sql('word')} AS sound FROM (SELECT DISTINCT lower(unnest(regexp_extract_all({sql_fold('name')}, '[A-Za-z]{{4,}}'))) AS word FROM parties WHERE name IS NOT NULL)) GROUP BY sound HAVING count(DISTINCT word) > 1")
def t40_sound_alikes(spark: SparkSession, d: str) -> DataFrame:
    """Words of names that come to one spelling by the table of sounds, doubled consonants as one."""
    w = table(spark, d, "parties").where("name IS NOT NULL").select(F.explode(F.regexp_extract_all(T.fold(F.col("name")), F.lit("([A-Za-z]{4,})"), 1)).alias("word")).select(F.lower("word").alias("word")).distinct()
    s = F.col("word")
    for a, b in SOUNDS:
        s = F.regexp_replace(s, a, b)
    s = F.regexp_replace(s, "([bcdfghjlmnprstvwx])\\1+", "$1")
    return w.withColumn("sound", s).groupBy("sound").agg(F.count_distinct("word").alias("words"), F.min("word").alias("first"), F.max("word").alias("last")).where("words > 1")


_COMMENTS = [(1, 0, "Prüfen", "Check"), (2, 1, "Streichen <b>", None), (3, 2, "", "Empty")]


@query(f"SELECT id, '<w:comment w:id=\"' || id || '\"><w:t>' || replace(replace(replace(coalesce(new, old), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</w:t></w:comment>' AS xml, new IS NOT NULL AS replaced FROM {values(_COMMENTS, 'id, pos, old, new')}")
def t44_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments with their text replaced by id; one without a translation keeps its own."""
    c = fixture(spark, _COMMENTS, "id int, pos int, old string, new string")
    return c.select("id", F.concat(F.lit('<w:comment w:id="'), F.col("id").cast("string"), F.lit('"><w:t>'), T.escape(F.coalesce("new", "old"), "xml"), F.lit("</w:t></w:comment>")).alias("xml"), F.col("new").isNotNull().alias("replaced"))


# ---- records

_LOOSE = [(1, '{"name": "A", "role": "buyer", "colour": "red"}'), (2, '{"role": null}'), (3, '{"name": {"first": "B"}}'), (4, "[]")]


@query(f"SELECT id, json_extract_string(x, '$.name') AS name, json_extract_string(x, '$.role') AS role FROM {values(_LOOSE, 'id, x')}")
def x5_known_fields(spark: SparkSession, d: str) -> DataFrame:
    """Records read into a fixed schema; fields it does not know are passed over."""
    r = F.from_json("x", "name string, role string")
    return fixture(spark, _LOOSE, "id int, x string").select("id", r.alias("r")).select("id", "r.name", "r.role")


_MULTI = [(1, '"plain"'), (2, '{"$": "dollar"}'), (3, '{"text": "t", "value": "v"}'), (4, '[{"x": 1}, {"$": ""}, {"value": "third"}]'), (5, "[]"), (6, "null")]


@query(f"""SELECT id, CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') WHEN 'OBJECT' THEN coalesce(nullif(json_extract_string(x, '$."$"'), ''), nullif(json_extract_string(x, '$.text'), ''), json_extract_string(x, '$.value')) WHEN 'ARRAY' THEN list_filter(list_transform(CAST(x AS JSON[]), lambda y: coalesce(nullif(json_extract_string(y, '$."$"'), ''), nullif(json_extract_string(y, '$.text'), ''), json_extract_string(y, '$.value'))), lambda z: z <> '')[1] END AS picked FROM {values(_MULTI, 'id, x')}""")
def x6_multilingual_pick(spark: SparkSession, d: str) -> DataFrame:
    """One text of a field that is a string, an object or a list of either."""
    of = lambda m: F.coalesce(F.nullif(F.try_element_at(m, F.lit("$")), F.lit("")), F.nullif(F.try_element_at(m, F.lit("text")), F.lit("")), F.try_element_at(m, F.lit("value")))
    x = F.col("x")
    listed = F.get(F.filter(F.transform(F.from_json(x, "array<map<string,string>>"), of), lambda z: z != ""), F.lit(0))
    picked = F.when(x.startswith('"'), F.from_json(F.concat(F.lit('{"v": '), x, F.lit("}")), "v string")["v"]).when(x.startswith("{"), of(F.from_json(x, "map<string,string>"))).when(x.startswith("["), listed)
    return fixture(spark, _MULTI, "id int, x string").select("id", picked.alias("picked"))


@query("""WITH f AS (SELECT doc_id, bool_or(contains(text, ' v. ')) AS cites, bool_or(regexp_matches(text, '% of the shares')) AS owns, bool_or(contains(lower(text), 'shall')) AS duties, bool_or(contains(lower(text), 'audit')) AS controls FROM blocks WHERE text IS NOT NULL GROUP BY doc_id), l AS (SELECT DISTINCT doc_id FROM ownership_links WHERE doc_id IS NOT NULL)
 SELECT f.doc_id, type, 30 AS score FROM f LEFT JOIN l ON l.doc_id = f.doc_id, (VALUES ('litigation'), ('corporate'), ('compliance')) t(type) WHERE CASE type WHEN 'litigation' THEN cites WHEN 'corporate' THEN owns OR l.doc_id IS NOT NULL ELSE duties AND controls END""")
def a26_matter_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of matter that a document's findings speak for: authorities, ownership, duties with controls."""
    t = F.col("text")
    f = table(spark, d, "blocks").where("text IS NOT NULL").groupBy("doc_id").agg(F.bool_or(t.contains(" v. ")).alias("cites"), F.bool_or(t.rlike("% of the shares")).alias("owns"), F.bool_or(F.lower(t).contains("shall")).alias("duties"), F.bool_or(F.lower(t).contains("audit")).alias("controls"))
    linked = table(spark, d, "ownership_links").where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("linked", F.lit(True))
    kinds = F.array(F.when(F.col("cites"), "litigation"), F.when(F.col("owns") | F.coalesce("linked", F.lit(False)), "corporate"), F.when(F.col("duties") & F.col("controls"), "compliance"))
    return f.join(linked, "doc_id", "left").select("doc_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("type"), F.lit(30).alias("score"))


_ROLES = ("claimant", "respondent", "buyer", "seller")


@query("SELECT doc_id, " + ", ".join(f"coalesce(min(name) FILTER (lower(role) = '{r}'), 'Not found') AS {r}" for r in _ROLES) + " FROM parties WHERE doc_id IS NOT NULL GROUP BY doc_id")
def a40_review_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Documents by roles, with the first name of each, or that none was found."""
    p = table(spark, d, "parties").where("doc_id IS NOT NULL").withColumn("r", F.lower("role"))
    wide = p.groupBy("doc_id").pivot("r", list(_ROLES)).agg(F.min("name"))
    return wide.select("doc_id", *[F.coalesce(r, F.lit("Not found")).alias(r) for r in _ROLES])


@query("""WITH p AS (SELECT DISTINCT party_id, doc_id, name, role, type FROM parties WHERE doc_id IS NOT NULL), s AS (SELECT doc_id, party_id, CASE WHEN role IS NOT NULL AND type IS NOT NULL THEN 90 WHEN role IS NOT NULL THEN 60 WHEN type IS NOT NULL THEN 50 ELSE 40 END AS score FROM p)
 SELECT doc_id, 'resolve_candidate' AS directive, string_agg(CAST(party_id AS VARCHAR), ',' ORDER BY party_id) AS targets, CASE WHEN score < 50 THEN 'snippet_plus_neighboring_block' ELSE 'snippet_only' END AS read_policy FROM s WHERE score < 85 GROUP BY doc_id, read_policy
 UNION ALL SELECT doc_id, 'null_field', string_agg(CAST(party_id AS VARCHAR), ',' ORDER BY party_id), '' FROM p WHERE role IS NULL GROUP BY doc_id UNION ALL SELECT doc_id, 'matter_type', '', '' FROM documents WHERE matter_id IS NULL""")
def h27_directives(spark: SparkSession, d: str) -> DataFrame:
    """What is left to be decided: candidates below promotion with how much to read, entities without a role, documents without a matter."""
    p = table(spark, d, "parties").where("doc_id IS NOT NULL").select("party_id", "doc_id", "name", "role", "type").distinct()
    score = F.when(F.col("role").isNotNull() & F.col("type").isNotNull(), 90).when(F.col("role").isNotNull(), 60).when(F.col("type").isNotNull(), 50).otherwise(40)
    low = p.withColumn("score", score).where("score < 85").withColumn("read_policy", F.when(F.col("score") < 50, "snippet_plus_neighboring_block").otherwise("snippet_only"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("party_id")), lambda x: x.cast("string")), ",").alias("targets")
    resolve = low.groupBy("doc_id", "read_policy").agg(ids).select("doc_id", F.lit("resolve_candidate").alias("directive"), "targets", "read_policy")
    null = p.where("role IS NULL").groupBy("doc_id").agg(ids).select("doc_id", F.lit("null_field").alias("directive"), "targets", F.lit("").alias("read_policy"))
    matter = table(spark, d, "documents").where("matter_id IS NULL").select("doc_id", F.lit("matter_type").alias("directive"), F.lit("").alias("targets"), F.lit("").alias("read_policy"))
    return resolve.unionByName(null).unionByName(matter)


_PEOPLE = [(1, "Maria Gonzalez Lopez", "hispanic"), (2, "Vladimir Vladimirovich Petrov", "russian"), (3, "Wang Wei", "east_asian"), (4, "John Robert Smith", "western"), (5, "Suharto", "western"), (6, "Ali Khan", "ambiguous"), (7, "", "western")]


@query(f"""SELECT id, CASE WHEN len(w) = 1 THEN w[1] WHEN convention = 'hispanic' AND len(w) >= 3 THEN w[len(w) - 1] WHEN convention = 'east_asian' THEN w[1] ELSE w[len(w)] END AS anchor, array_to_string(CASE WHEN len(w) = 1 THEN [] WHEN convention = 'hispanic' AND len(w) >= 3 THEN list_concat(w[:len(w) - 2], w[len(w):]) WHEN convention = 'east_asian' THEN w[2:] ELSE w[:len(w) - 1] END, ' ') AS other, CASE WHEN len(w) = 1 OR convention = 'ambiguous' THEN 'low' ELSE 'high' END AS confidence
 FROM (SELECT id, convention, string_split(name, ' ') AS w FROM {values(_PEOPLE, 'id, name, convention')} WHERE name <> '')""")
def h48_name_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The part of a name that tells whom it means, by naming convention, and the other parts."""
    p = fixture(spark, _PEOPLE, "id int, name string, convention string").where("name <> ''").withColumn("w", F.split("name", " "))
    w, n = F.col("w"), F.size("w")
    one, maternal, east = n == 1, (F.col("convention") == "hispanic") & (n >= 3), F.col("convention") == "east_asian"
    anchor = F.when(one | east, F.get(w, F.lit(0))).when(maternal, F.get(w, n - 2)).otherwise(F.get(w, n - 1))
    other = F.when(one, F.array().cast("array<string>")).when(maternal, F.concat(F.slice(w, F.lit(1), n - 2), F.slice(w, n, F.lit(1)))).when(east, F.slice(w, F.lit(2), n)).otherwise(F.slice(w, F.lit(1), n - 1))
    return p.select("id", anchor.alias("anchor"), F.array_join(other, " ").alias("other"), F.when(one | (F.col("convention") == "ambiguous"), "low").otherwise("high").alias("confidence"))


_TAG = "CASE WHEN count(DISTINCT source) >= 3 THEN 'key' WHEN count(DISTINCT source) = 2 THEN 'supporting' ELSE 'background' END"


@query(f"SELECT doc_date AS day, matter_id, count(*) AS documents, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, {_TAG} AS tag FROM documents WHERE doc_date IS NOT NULL AND matter_id IS NOT NULL AND source IS NOT NULL GROUP BY doc_date, matter_id")
def h49_chronology(spark: SparkSession, d: str) -> DataFrame:
    """One entry per matter and day with all sources that attest it, tagged by their number."""
    docs = table(spark, d, "documents").where("doc_date IS NOT NULL AND matter_id IS NOT NULL AND source IS NOT NULL").groupBy(F.col("doc_date").alias("day"), "matter_id", "source").agg(F.count(F.lit(1)).alias("n"))
    g = docs.groupBy("day", "matter_id").agg(F.sum("n").alias("documents"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"), F.count(F.lit(1)).alias("k"))
    return g.select("day", "matter_id", "documents", "sources", F.when(F.col("k") >= 3, "key").when(F.col("k") == 2, "supporting").otherwise("background").alias("tag"))


@query("WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE received_at < TIMESTAMP '2024-01-01' OR doc_id % 3 = 0), b AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 4 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def w18_incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """New, removed and modified documents between two states; hashes are joined, not texts. The states are made from one table."""
    docs = table(spark, d, "documents").select("doc_id", "received_at", F.coalesce("text", F.lit("")).alias("text"))
    a = docs.where("received_at < TIMESTAMP '2024-01-01' OR doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("h0"))
    b = docs.where("doc_id % 4 <> 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")), 256).alias("h1"))
    j = a.join(b, "doc_id", "full").where(~F.col("h0").eqNullSafe(F.col("h1")))
    return j.select("doc_id", F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "removed").otherwise("modified").alias("change"))


# ---- sinks and sources

@query("SELECT doc_id, '{\"schema_version\":1,\"doc_id\":' || doc_id || ',\"blocks\":' || n || ',\"headings\":' || h || ',\"languages\":[' || coalesce(l, '') || ']}' AS manifest FROM (SELECT doc_id, count(DISTINCT idx) AS n, count(DISTINCT idx) FILTER (block_type = 'heading') AS h FROM blocks GROUP BY doc_id) LEFT JOIN (SELECT doc_id, string_agg('\"' || lang || '\"', ',' ORDER BY lang) AS l FROM (SELECT DISTINCT doc_id, lang FROM blocks WHERE lang IS NOT NULL) GROUP BY doc_id) USING (doc_id)")
def k6_manifest_json(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks")
    g = b.groupBy("doc_id").agg(F.count_distinct("idx").alias("blocks"), F.count_distinct(F.when(F.col("block_type") == "heading", F.col("idx"))).alias("headings"), F.array_sort(F.collect_set("lang")).alias("languages"))
    return g.select("doc_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), "doc_id", "blocks", "headings", "languages")).alias("manifest"))


@query("SELECT coalesce(p_brand, 'Total') AS brand, count(*) AS parts, CAST(round(sum(CAST(p_retailprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS value, CASE WHEN p_brand IS NULL THEN 'bold' ELSE 'plain' END AS style FROM part GROUP BY ROLLUP (p_brand)")
def k15_styled_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sheet with their style, and a row of totals."""
    g = table(spark, d, "part").rollup("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return g.select(F.coalesce("p_brand", F.lit("Total")).alias("brand"), "parts", "value", F.when(F.col("p_brand").isNull(), "bold").otherwise("plain").alias("style"))


#: Bytes of a calendar line, the line break apart.
OCTETS = 75
_ICS_FIX = [(-1, "Ascii " + "abcdefghij" * 20), (-2, "Zażółć gęślą jaźń " * 9), (-3, "漢字" * 40), (-4, "short"), (-5, "a;b,c\\d")]
_ESC_SQL = r"replace(replace(replace(coalesce(matter, ''), '\', '\\'), ';', '\;'), ',', '\,')"


@query(rf"""WITH RECURSIVE m AS (SELECT matter_id, 'SUMMARY:' || {_ESC_SQL} AS s FROM matters UNION ALL SELECT matter_id, 'SUMMARY:' || {_ESC_SQL} FROM {values(_ICS_FIX, 'matter_id, matter')}),
 f AS (SELECT matter_id, '' AS done, s AS rest, 0 AS k FROM m UNION ALL SELECT matter_id, done || CASE WHEN k = 0 THEN '' ELSE chr(13) || chr(10) || ' ' END || left(rest, n), substr(rest, n + 1), k + 1 FROM (SELECT *, list_max(list_filter(range(1, {OCTETS + 1}), lambda i: octet_length(encode(left(rest, CAST(i AS INTEGER)))) <= {OCTETS} - CASE WHEN k = 0 THEN 0 ELSE 1 END)) AS n FROM f WHERE rest <> ''))
 SELECT matter_id, done AS line FROM f WHERE rest = ''""")
def k5_folded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole titles as calendar lines, folded at 75 octets and never within a character."""
    from lexmill.sources import sinks as K

    m = table(spark, d, "matters").select("matter_id", F.coalesce("matter", F.lit("")).alias("matter")).unionByName(fixture(spark, _ICS_FIX, "matter_id long, matter string"))
    return K.fold_calendar(m.select("matter_id", F.concat(F.lit("SUMMARY:"), T.escape(F.col("matter"), "ics")).alias("line")), "line")


@query("WITH m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN repeat('0', 64) ELSE sha256(coalesce(text, '')) END AS want FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT -1, repeat('0', 64)) SELECT coalesce(m.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unlisted' WHEN want = sha256(coalesce(d.text, '')) THEN 'ok' ELSE 'changed' END AS state FROM m FULL JOIN documents d ON d.doc_id = m.doc_id")
def j16_manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """Files against a manifest of hashes: right, changed, missing or unlisted. The manifest is made with each kind of fault in it."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("is"))
    m = docs.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("is")).alias("want")).unionByName(fixture(spark, [(-1, "0" * 64)], "doc_id long, want string"))
    j = m.join(docs, "doc_id", "full")
    return j.select("doc_id", F.when(F.col("is").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.col("is"), "ok").otherwise("changed").alias("state"))


_ORPHANS = [(-1, "A", None), (-1, "B", "A"), (-1, "C", "Gone"), (-2, "D", "A")]


@query("WITH h AS (SELECT DISTINCT doc_id, text, heading_path[-1] AS parent FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL UNION SELECT * FROM " + values(_ORPHANS, "doc_id, text, parent") + "), n AS (SELECT DISTINCT doc_id, text FROM h) SELECT DISTINCT h.doc_id, h.text AS node, h.parent FROM h WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = h.doc_id AND n.text = h.parent)")
def j5_unknown_parents(spark: SparkSession, d: str) -> DataFrame:
    """Headings whose named parent is no heading of their document."""
    h = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL").select("doc_id", F.col("text").alias("node"), F.try_element_at("heading_path", F.lit(-1)).alias("parent")).unionByName(fixture(spark, _ORPHANS, "doc_id long, node string, parent string")).distinct()
    known = h.select("doc_id", F.col("node").alias("parent")).distinct()
    return h.where("parent IS NOT NULL").join(known, ["doc_id", "parent"], "left_anti").select("doc_id", "node", "parent")


@query("SELECT DISTINCT ref_id, stale FROM (SELECT ref_id, CASE WHEN date_diff('day', CAST(retrieved_at AS DATE), DATE '2026-01-01') > 90 THEN 'STALE' ELSE '' END AS stale FROM refs) WHERE stale <> ''")
def pred5_stale_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose flag of staleness is set."""
    flag = F.when(F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("retrieved_at")) > 90, "STALE").otherwise("")
    return table(spark, d, "refs").select("ref_id", flag.alias("stale")).where("stale <> ''").distinct()


_REVISED = [("a.docx", '<w:ins w:author="Kim"/><w:del w:author="Lee"/><w:ins w:author="Kim"/>'), ("b.docx", '<w:del w:author=""/>'), ("c.docx", "<w:p/>")]


@query(f"SELECT file, CAST(len(regexp_extract_all(xml, '<w:(?:ins|del) ')) AS INTEGER) AS revisions, array_to_string(list_sort(list_distinct(regexp_extract_all(xml, 'w:author=\"([^\"]*)\"', 1))), ',') AS authors FROM {values(_REVISED, 'file, xml')}")
def a27_revision_authors(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of a file and who made them."""
    return fixture(spark, _REVISED, "file string, xml string").select("file", F.regexp_count("xml", F.lit("<w:(?:ins|del) ")).alias("revisions"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("xml", F.lit('w:author="([^"]*)"'), 1))), ",").alias("authors"))


_CACHED = [("a", "2025-12-31 12:00:00", None), ("b", "2025-12-30 23:59:59", None), ("c", None, 1000), ("d", None, 40), ("e", None, 30), ("f", None, 29)]


@query(f"SELECT key, CASE WHEN seen IS NOT NULL THEN TIMESTAMP '2026-01-01 00:00:00' - CAST(seen AS TIMESTAMP) < INTERVAL 24 HOUR ELSE left_s - 30 > 0 END AS usable FROM {values(_CACHED, 'key, seen, left_s')}")
def r5_cache_age(spark: SparkSession, d: str) -> DataFrame:
    """Entries younger than a day, and tokens that outlive half a minute more."""
    c = fixture(spark, _CACHED, "key string, seen string, left_s int")
    young = F.lit("2026-01-01 00:00:00").cast("timestamp") - F.col("seen").cast("timestamp") < F.expr("INTERVAL '24' HOUR")
    return c.select("key", F.when(F.col("seen").isNotNull(), young).otherwise(F.col("left_s") - 30 > 0).alias("usable"))


_MAIL = [("m1", '{"id": "m1", "subject": "Notice", "receivedDateTime": "2025-03-01", "isRead": false, "hasAttachments": true}'), ("m2", '{"id": "m2", "subject": "Other", "receivedDateTime": "2025-03-02", "isRead": true}'), ("m3", '{"id": "m3", "subject": "Notice 2", "receivedDateTime": "2025-02-01", "isRead": false}'), ("m4", '{"id": "m4", "subject": "Notice 3", "receivedDateTime": "2025-04-01", "isRead": false}')]


@query(f"SELECT json_extract_string(x, '$.id') AS id, json_extract_string(x, '$.subject') AS subject, coalesce(json_extract_string(x, '$.hasAttachments'), 'false') = 'true' AS attached FROM {values(_MAIL, 'k, x')} WHERE json_extract_string(x, '$.isRead') = 'false' ORDER BY json_extract_string(x, '$.receivedDateTime') DESC LIMIT 2")
def s23_mail(spark: SparkSession, d: str) -> DataFrame:
    """Messages by filter, order, number and fields, as the service answers them; the number is the feature."""
    m = F.from_json("x", "id string, subject string, receivedDateTime string, isRead boolean, hasAttachments boolean")
    rows = fixture(spark, _MAIL, "k string, x string").select(m.alias("m")).select("m.*").where("NOT isRead").orderBy(F.desc("receivedDateTime")).limit(2)
    return rows.select("id", "subject", F.coalesce("hasAttachments", F.lit(False)).alias("attached"))


_CATALOGUE = [("new", None), ("legacy", '{"dataset": [{"title": "Tariff 2024", "distribution": [{"title": "Revision 3", "downloadURL": "u/r3.json"}, {"title": "Basic", "downloadURL": "u/b.json"}]}]}'), ("other", '{"dataset": []}')]


@query(f"WITH p AS (SELECT x FROM {values(_CATALOGUE, 'source, x')} WHERE x IS NOT NULL ORDER BY CASE source WHEN 'new' THEN 1 WHEN 'legacy' THEN 2 ELSE 3 END LIMIT 1), ds AS (SELECT unnest(json_extract(x, '$.dataset[*]')) AS ds FROM p) SELECT json_extract_string(ds, '$.title') AS dataset, json_extract_string(t, '$.title') AS title, json_extract_string(t, '$.downloadURL') AS url FROM (SELECT ds, unnest(json_extract(ds, '$.distribution[*]')) AS t FROM ds)")
def s24_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Datasets and their files from the first catalogue that answers: the new one, else the legacy one."""
    order = F.when(F.col("source") == "new", 1).when(F.col("source") == "legacy", 2).otherwise(3)
    p = fixture(spark, _CATALOGUE, "source string, x string").where("x IS NOT NULL").agg(F.min_by("x", order).alias("x"))
    ds = p.select(F.explode(F.from_json("x", "dataset array<struct<title string, distribution array<struct<title string, downloadURL string>>>>")["dataset"]).alias("ds"))
    return ds.select(F.col("ds.title").alias("dataset"), F.explode("ds.distribution").alias("t")).select("dataset", "t.title", F.col("t.downloadURL").alias("url"))


_YAML = ["# aliases", "version: 1", "aliases:", "  gdpr:", '    canonical: "General Data Protection Regulation"', "    hints:", "      - personal data", "      - 'data subject'", "  mica:", "    canonical: MiCA", "  empty:", "other:", "  rome:", "    canonical: no"]
_YAML_ROWS = [(k, x) for k, x in enumerate(_YAML)]


@query(rf"""WITH y AS (SELECT * FROM {values(_YAML_ROWS, 'n, line')} WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')), a AS (SELECT min(n) AS first FROM y WHERE line = 'aliases:'), z AS (SELECT coalesce(min(n), 1000) AS last FROM y, a WHERE n > first AND regexp_matches(line, '^\S')),
 k AS (SELECT n, line, last_value(nullif(regexp_extract(line, '^  ([a-z0-9-]+):\s*$', 1), '') IGNORE NULLS) OVER (ORDER BY n) AS key FROM y, a, z WHERE n > first AND n < last)
 SELECT key, max(nullif(regexp_extract(line, '^    canonical: *["'']?(.*?)["'']?\s*$', 1), '')) AS canonical, coalesce(string_agg(nullif(regexp_extract(line, '^      - *["'']?(.*?)["'']?\s*$', 1), ''), '; ' ORDER BY n), '') AS hints FROM k GROUP BY key HAVING max(nullif(regexp_extract(line, '^    canonical: *["'']?(.*?)["'']?\s*$', 1), '')) IS NOT NULL""")
def s25_alias_file(spark: SparkSession, d: str) -> DataFrame:
    """The aliases of a small configuration file, read line by line; a key without a name or hints is left out."""
    y = fixture(spark, _YAML_ROWS, "n int, line string").where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    w = Window.partitionBy(F.lit("file")).orderBy("n")
    y = y.withColumn("part", F.last(F.when(F.col("line").rlike(r"^\S"), F.col("line")), ignorenulls=True).over(w)).where(F.col("part") == "aliases:").where("line <> 'aliases:'")
    grab = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    y = y.withColumn("key", F.last(grab(r"^  ([a-z0-9-]+):\s*$"), ignorenulls=True).over(w))
    hints = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(grab(r"^      - *[\"']?(.*?)[\"']?\s*$").isNotNull(), F.struct("n", grab(r"^      - *[\"']?(.*?)[\"']?\s*$").alias("h"))))), lambda x: x["h"]), "; ")
    return y.groupBy("key").agg(F.max(grab(r"^    canonical: *[\"']?(.*?)[\"']?\s*$")).alias("canonical"), hints.alias("hints")).where("canonical IS NOT NULL")


_STATUTES = [("kc", 0, "original " * 300), ("kc", 1, ""), ("kc", 2, "consolidated 2019 " * 200), ("kc", 3, "consolidated 2010 " * 200), ("ksh", 0, "original law " * 300), ("ksh", 1, "too short"), ("xx", 1, "")]


@query(f"SELECT act, min_by(left(text, 17), CASE WHEN rank = 0 THEN 99 ELSE rank END) AS chosen FROM {values(_STATUTES, 'act, rank, text')} WHERE length(text) > 1500 AND rank <= 4 GROUP BY act")
def s28_statute_text(spark: SparkSession, d: str) -> DataFrame:
    """The newest of up to four consolidated texts that is not empty, else the original (rank 0)."""
    t = fixture(spark, _STATUTES, "act string, rank int, text string").where("length(text) > 1500 AND rank <= 4")
    return t.groupBy("act").agg(F.min_by(F.substring("text", 1, 17), F.when(F.col("rank") == 0, 99).otherwise(F.col("rank"))).alias("chosen"))


@query("""WITH r AS (SELECT ref_id, title, year, container, CASE WHEN doc_type IN ('book', 'OUV') THEN 1 WHEN doc_type IN ('thesis', 'THESE') THEN 2 ELSE 3 END AS section FROM (SELECT DISTINCT ref_id, title, year, container, doc_type FROM refs WHERE title IS NOT NULL)), o AS (SELECT section, coalesce(container, '') AS container, lower(title) AS k, min(ref_id) AS ref_id FROM r GROUP BY section, coalesce(container, ''), lower(title))
 SELECT section, container, ref_id, row_number() OVER (PARTITION BY section, container ORDER BY k, ref_id) AS no, count(*) OVER (PARTITION BY section, container) AS entries FROM o""")
def a13_sections(spark: SparkSession, d: str) -> DataFrame:
    """Records once per title, ordered within their section and journal; a section is as many groups as it has journals."""
    kind = F.when(F.col("doc_type").isin("book", "OUV"), 1).when(F.col("doc_type").isin("thesis", "THESE"), 2).otherwise(3)
    r = table(spark, d, "refs").where("title IS NOT NULL").select("ref_id", F.lower("title").alias("k"), F.coalesce("container", F.lit("")).alias("container"), kind.alias("section"))
    o = r.groupBy("section", "container", "k").agg(F.min("ref_id").alias("ref_id")).withColumn("group", F.concat_ws("|", F.col("section").cast("string"), "container"))
    # Numbered within the first letters of a title, then joined over one row for each.
    numbered = running_number(o, "group", ["k", "ref_id"], F.substring("k", 1, 2), "no")
    size = o.groupBy("group").agg(F.count(F.lit(1)).alias("entries"))
    return numbered.join(size, "group").select("section", "container", "ref_id", "no", "entries")
