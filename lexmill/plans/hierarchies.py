"""Named queries over hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.operators.hierarchy import descendants, heading_parents, hierarchy, ownership
from lexmill.session import cut_lineage, table

def _both(spark: SparkSession, sf_dir: str, with_path: bool = False, with_first: bool = False) -> DataFrame:
    """Company and heading hierarchies in one run, told apart by a letter before each name."""
    own = ownership(table(spark, sf_dir, "ownership_links"))
    heads = heading_parents(table(spark, sf_dir, "blocks"))
    mark = lambda df, m: df.select(F.concat(F.lit(m), "node").alias("node"), F.concat(F.lit(m), "parent").alias("parent"))
    return hierarchy(mark(own, "c").unionByName(mark(heads, "h")), cut_lineage, with_path=with_path, with_first=with_first)


def _strip(col: str):
    return F.substring(col, 2, 1 << 30)


def _kind():
    return F.when(F.substring("node", 1, 1) == "c", "link").otherwise("heading")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and number beneath of every company and heading, with cycles."""
    return _both(spark, sf_dir).select(_kind().alias("kind"), _strip("node").alias("node"), _strip("root").alias("root"), "depth", "n_below")


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path of every company and heading that is in no cycle, outermost first."""
    tree = _both(spark, sf_dir, with_path=True).where("path IS NOT NULL")
    return tree.select(_kind().alias("kind"), _strip("node").alias("node"), F.concat_ws(" > ", F.transform("path", lambda x: F.substring(x, 2, 1 << 30))).alias("path"))


def p6_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and interval of descendants of every company and heading; a cycle's nodes have all that hangs on the cycle."""
    tree = descendants(_both(spark, sf_dir, with_first=True))
    return tree.select(_kind().alias("kind"), _strip("root").alias("root"), _strip("node").alias("node"), "place", "first", "last")


def p6_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands beneath each heading and each owner, by the intervals: their number, the least and the greatest.

    Least and greatest of every run of 2**k places are worked out by doubling;
    an interval of any length is two such runs, so a deep tree costs no more
    rows than its nodes times the number of doublings.
    """
    rows = cut_lineage(p6_intervals(spark, sf_dir).withColumn("tree", F.concat_ws("|", "kind", "root")))
    # A node on a cycle stands within its own interval and is left out of it.
    ranges = F.array(F.struct(F.col("first").alias("a"), (F.col("place") - 1).alias("b")), F.struct((F.col("place") + 1).alias("a"), F.col("last").alias("b")))
    spans = rows.where("last > first").select("kind", "tree", "node", F.explode(F.filter(ranges, lambda x: x["b"] >= x["a"])).alias("r")).select("kind", "tree", "node", "r.*")
    spans = cut_lineage(spans.withColumn("k", F.floor(F.log2(F.col("b") - F.col("a") + 1)).cast("int")))
    levels = sorted(r.k for r in spans.select("k").distinct().collect())  # at most the logarithm of the largest tree
    runs = rows.select("tree", F.col("place").alias("at"), F.col("node").alias("low"), F.col("node").alias("high"))
    found = []
    for k in range(levels[-1] + 1 if levels else 0):
        if k in levels:
            q = spans.where(F.col("k") == k)
            for start in (F.col("a"), F.col("b") - (1 << k) + 1):
                found.append(q.withColumn("at", start).join(runs, ["tree", "at"]).select("kind", "node", "low", "high"))
        if k < levels[-1]:
            later = runs.select("tree", (F.col("at") - (1 << k)).alias("at"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            runs = cut_lineage(runs.join(later, ["tree", "at"]).select("tree", "at", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
    every = found[0] if found else rows.select("kind", "node", F.col("node").alias("low"), F.col("node").alias("high")).where("false")
    for x in found[1:]:
        every = every.unionByName(x)
    ends = every.groupBy("kind", "node").agg(F.min("low").alias("least"), F.max("high").alias("greatest"))
    return ends.join(rows.where("last > first").select("kind", "node", (F.col("last") - F.col("first")).cast("int").alias("n_below")), ["kind", "node"])


_LINKS = r"""
WITH RECURSIVE named AS (
  SELECT DISTINCT trim(regexp_replace(lower(child), '\s+', ' ', 'g')) AS node, trim(regexp_replace(lower(parent), '\s+', ' ', 'g')) AS parent
  FROM ownership_links WHERE child IS NOT NULL AND parent IS NOT NULL
), link AS (SELECT * FROM named WHERE node <> '' AND parent <> ''),
names AS (SELECT node FROM link UNION SELECT parent FROM link),
heads AS (SELECT doc_id, idx, min(level) AS level FROM blocks WHERE block_type = 'heading' GROUP BY doc_id, idx),
hlink AS (
  SELECT a.doc_id || ':' || a.idx AS node, a.doc_id || ':' || max(b.idx) AS parent
  FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.idx < a.idx AND b.level < a.level GROUP BY a.doc_id, a.idx
), edges AS (SELECT 'link' AS kind, node, parent FROM link UNION ALL SELECT 'heading', node, parent FROM hlink),
every AS (SELECT 'link' AS kind, node FROM names UNION ALL SELECT 'heading', doc_id || ':' || idx FROM heads),
pairs AS (
  SELECT kind, node, parent AS top FROM edges
  UNION
  SELECT pairs.kind, pairs.node, edges.parent FROM pairs JOIN edges ON edges.kind = pairs.kind AND edges.node = pairs.top
),
ring AS (SELECT kind, node FROM pairs WHERE node = top),
low AS (SELECT p.kind, p.node, min(p.top) AS low FROM pairs p JOIN ring r ON r.kind = p.kind AND r.node = p.top GROUP BY p.kind, p.node),
deep AS (SELECT kind, node, count(*) AS depth FROM pairs GROUP BY kind, node),
tops AS (SELECT p.kind, p.node, min(p.top) AS root FROM pairs p ANTI JOIN edges ON edges.kind = p.kind AND edges.node = p.top GROUP BY p.kind, p.node)
"""

P6_FOUND_SQL = (
    _LINKS
    + """,
below AS (SELECT kind, top AS node, count(*) FILTER (WHERE node <> top) AS n_below FROM pairs GROUP BY kind, top)
SELECT e.kind, e.node, coalesce(low.low, tops.root, e.node) AS root,
  CAST(CASE WHEN ring.node IS NOT NULL THEN -1 WHEN low.low IS NOT NULL THEN -2 ELSE coalesce(deep.depth, 0) END AS INTEGER) AS depth,
  CAST(coalesce(below.n_below, 0) AS INTEGER) AS n_below
FROM every e LEFT JOIN deep USING (kind, node) LEFT JOIN tops USING (kind, node) LEFT JOIN ring USING (kind, node) LEFT JOIN low USING (kind, node) LEFT JOIN below USING (kind, node)
"""
)

P6_PATHS_SQL = (
    _LINKS
    + """,
steps AS (SELECT kind, node, top FROM pairs UNION ALL SELECT kind, node, node FROM every)
SELECT s.kind, s.node, string_agg(s.top, ' > ' ORDER BY coalesce(deep.depth, 0)) AS path
FROM steps s LEFT JOIN deep ON deep.kind = s.kind AND deep.node = s.top ANTI JOIN low ON low.kind = s.kind AND low.node = s.node GROUP BY s.kind, s.node
"""
)

P6_BELOW_SQL = _LINKS + "SELECT kind, top AS node, min(node) AS least, max(node) AS greatest, CAST(count(*) AS INTEGER) AS n_below FROM pairs WHERE node <> top GROUP BY kind, top"

QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_intervals": p6_intervals, "p6_below": p6_below}
SQL = {"p6_found": P6_FOUND_SQL, "p6_paths": P6_PATHS_SQL, "p6_below": P6_BELOW_SQL}
