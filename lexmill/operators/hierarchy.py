"""Parent-child rows of unknown depth as full hierarchies, by heavy-path decomposition.

Every step takes a number of rounds logarithmic in the depth, each a join or
an aggregation over all nodes at once:

1. Pointer doubling finds, for every node, the ancestor 2**k steps up and the
   number of descendants fewer than 2**k steps down, until nothing above is
   left. Nodes that never get there are on or below a cycle; they are
   separated, the links into cycle nodes cut, and treated as a forest of their own.
2. The child with the largest subtree continues its parent's chain; every
   other node heads a chain. Doubling along chains gives head and position.
3. A path crosses at most log2(n) chains, so doubling over chain heads gives
   depth, root and pre-order number of each head; a node adds its position.
   Descendants of a node are the interval ``[first, first + n_below]``. The
   trees on a cycle are numbered one after the other, the cycle as their root.
4. Nodes of several parents tie trees together. In the trees so tied, and in
   them alone, the pairs of nodes of which one is reached from the other are
   worked out by doubling; they are as many as the ``n_below`` of these trees.

Defined results: a null or empty node is no node; a null parent makes a root,
unless another row names a parent; repeated rows count once. A node of several
parents counts below each of them; depth, root and path follow the smallest
parent, a node's own name first. A node on a cycle has the smallest name on the
cycle as root and depth -1, a node below one that root and depth -2; neither
has a path. Nodes of tied trees have no pre-order number: their descendants are
the pairs of ``tied_pairs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window, functions as F

from lexmill.operators.ordered import running_sum

#: Siblings are numbered in so many buckets side by side, so no parent's children meet in one task.
SIBLING_BUCKETS = 64
#: Headings of a document are ordered in runs of so many places.
RUN_LENGTH = 1024
#: Most distinct heading levels; an error beyond it, never a dropped level.
LEVELS_MAX = 64

Cut = Callable[[DataFrame], DataFrame]


def _counted(df: DataFrame, cut: Cut) -> tuple[DataFrame, int]:
    """The table written, and how many of its rows still point upwards, counted as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.col("up").isNotNull()).alias("n")))
    return out, seen.get["n"]


def _double(state: DataFrame, left: int, cut: Cut) -> tuple[DataFrame, DataFrame | None]:
    """Descendant counts of all nodes that reach a root; the table of those that do not, or None."""
    while left:
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        state = state.join(below, "node", "left").join(above, "up", "left")
        state, now = _counted(state.select("node", "parent", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), cut)
        if now == left:
            return state.where("up IS NULL").select("node", "parent", "size"), state.where("up IS NOT NULL").select("node", "parent", "up")
        left = now
    return state.select("node", "parent", "size"), None


def _forest(sized: DataFrame, cut: Cut, with_path: bool) -> DataFrame:
    """Root, depth and pre-order number by chains; ``sized`` has node, parent and subtree size."""
    heavy = sized.where("parent IS NOT NULL").groupBy("parent").agg(F.max_by("node", F.struct("size", "node")).alias("heavy"), F.max("size").alias("heavy_size"))
    links = sized.join(heavy.select(F.col("heavy").alias("node"), F.lit(True).alias("on")), "node", "left")
    # Chains: a heavy child points at its parent, a head at nothing.
    chain = links.select("node", "parent", "size", F.when(F.col("on"), F.col("parent")).alias("up"))
    chain = chain.withColumn("head", F.coalesce("up", "node")).withColumn("pos", F.col("up").isNotNull().cast("long"))
    if with_path:
        chain = chain.withColumn("segment", F.array("node"))
    chain, left = _counted(chain, cut)
    while left:
        above = chain.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("head").alias("next_head"), F.col("pos").alias("next_pos"), *([F.col("segment").alias("next_segment")] if with_path else []))
        joined = chain.join(above, "up", "left")
        chain = joined.select(
            "node", "parent", "size", F.col("next").alias("up"), F.coalesce("next_head", "head").alias("head"), (F.col("pos") + F.coalesce("next_pos", F.lit(0))).alias("pos"),
            *([F.when(F.col("next_segment").isNull(), F.col("segment")).otherwise(F.concat("next_segment", "segment")).alias("segment")] if with_path else []),
        )
        chain, left = _counted(chain, cut)
    # Pre-order of a head: after its parent, the parent's heavy subtree and its earlier siblings.
    light = chain.where("parent IS NOT NULL AND node = head").select("node", "parent", "size", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)).alias("bucket"))
    inside = Window.partitionBy("parent", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy("parent", "bucket").agg(F.sum("size").alias("bucket_size"))
    across = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("parent", "bucket", F.coalesce(F.sum("bucket_size").over(across), F.lit(0)).alias("bucket_start"))
    light = light.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["parent", "bucket"])
    light = light.join(heavy.select("parent", "heavy_size"), "parent")
    at = chain.select(F.col("node").alias("parent"), F.col("head").alias("parent_head"), F.col("pos").alias("parent_pos"), *([F.col("segment").alias("parent_segment")] if with_path else []))
    hop = light.join(at, "parent").select("node", F.col("parent_head").alias("up"), (F.col("parent_pos") + 1).alias("steps"), (F.col("parent_pos") + 1 + F.col("heavy_size") + F.col("start") + F.col("bucket_start")).alias("first"), *(["parent_segment"] if with_path else []))
    tops = chain.where("parent IS NULL").select("node", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("first"), *([F.array().cast("array<string>").alias("parent_segment")] if with_path else []))
    heads = hop.unionByName(tops).withColumn("root", F.coalesce("up", "node"))
    heads, left = _counted(heads, cut)
    while left:
        above = heads.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("next_root"), F.col("steps").alias("more"), F.col("first").alias("more_first"), *([F.col("parent_segment").alias("more_segment")] if with_path else []))
        joined = heads.join(above, "up", "left")
        heads = joined.select(
            "node", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("first") + F.coalesce("more_first", F.lit(0))).alias("first"), F.coalesce("next_root", "root").alias("root"),
            *([F.when(F.col("more_segment").isNull(), F.col("parent_segment")).otherwise(F.concat("more_segment", "parent_segment")).alias("parent_segment")] if with_path else []),
        )
        heads, left = _counted(heads, cut)
    heads = heads.select(F.col("node").alias("head"), "root", "steps", F.col("first").alias("head_first"), *(["parent_segment"] if with_path else []))
    out = chain.join(heads, "head")
    path = F.concat("parent_segment", "segment") if with_path else F.lit(None).cast("array<string>")
    return out.select("node", "parent", "root", (F.col("steps") + F.col("pos")).cast("int").alias("depth"), (F.col("size") - 1).cast("int").alias("n_below"), (F.col("head_first") + F.col("pos")).alias("first"), path.alias("path"))


def _cycles(rest: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Of nodes that reach no root: the cycle nodes with their cycle's smallest name, and each node's cycle."""
    # The image of ever more steps shrinks to the nodes on cycles.
    size = rest.select("up").distinct().count()
    while True:
        above = rest.select(F.col("node").alias("up"), F.col("up").alias("next"))
        rest = cut(rest.join(above, "up").select("node", "parent", F.col("next").alias("up")))
        now = rest.select("up").distinct().count()
        if now == size:
            break
        size = now
    on = rest.select(F.col("up").alias("node")).distinct().join(rest.select("node", "parent"), "node")
    ring = cut(on.select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("low")))
    # 2**k >= the number of cycle nodes: every cycle has been gone round.
    steps = 1
    while steps < size:
        above = ring.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"))
        ring = cut(ring.join(above, "up").select("node", F.col("next").alias("up"), F.least("low", "next_low").alias("low")))
        steps *= 2
    low = ring.select("node", "low")
    of = rest.join(low.select(F.col("node").alias("up"), "low"), "up").select("node", "parent", "low")
    return low, of


def _rows(links: DataFrame, node: str, parent: str) -> DataFrame:
    rows = links.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")).where("node IS NOT NULL AND node <> ''")
    return rows.withColumn("parent", F.when(F.col("parent") != "", F.col("parent")))


def _tied(tree: DataFrame, edges: DataFrame, several: DataFrame, cut: Cut) -> DataFrame:
    """``above, below``: pairs of which the second is reached from the first, in trees that nodes of several parents tie together."""
    of = tree.select("node", "root")
    ends = edges.join(several, "node", "left_semi")
    roots = cut(ends.select("node").unionByName(ends.select(F.col("parent").alias("node"))).distinct().join(of, "node").select("root").distinct())
    inside = of.join(roots, "root", "left_semi").select("node")
    reach = cut(edges.join(inside, "node", "left_semi").select(F.col("parent").alias("above"), F.col("node").alias("below")).distinct())
    n = reach.count()
    while True:
        on = reach.select(F.col("above").alias("via"), F.col("below").alias("next"))
        further = reach.join(on, F.col("below") == F.col("via")).select("above", F.col("next").alias("below"))
        reach = cut(reach.unionByName(further).distinct())
        now = reach.count()
        if now == n:
            return reach
        n = now


def _retie(tree: DataFrame, reach: DataFrame) -> DataFrame:
    """The tree with depth, root and ``n_below`` of tied nodes taken from their pairs."""
    back = reach.select(F.col("below").alias("above"), F.col("above").alias("below"))
    ring = reach.join(back, ["above", "below"]).groupBy(F.col("above").alias("node")).agg(F.min("below").alias("ring_low"))
    under = reach.join(ring.select(F.col("node").alias("above"), "ring_low"), "above").groupBy(F.col("below").alias("node")).agg(F.min("ring_low").alias("under_low"))
    many = reach.where("above <> below").groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("tied_below"))
    tied = reach.select(F.col("above").alias("node")).unionByName(reach.select(F.col("below").alias("node"))).distinct().withColumn("tied", F.lit(True))
    joined = tree.join(tied, "node", "left").join(ring, "node", "left").join(under, "node", "left").join(many, "node", "left")
    low = F.coalesce("ring_low", "under_low")
    depth = F.when(F.col("ring_low").isNotNull(), -1).when(F.col("under_low").isNotNull(), -2).otherwise(F.col("depth")).cast("int")
    return joined.select(
        "node", "parent", F.coalesce(low, "root").alias("root"), depth.alias("depth"), F.when(F.col("tied"), F.coalesce("tied_below", F.lit(0))).otherwise(F.col("n_below")).cast("int").alias("n_below"),
        F.when(F.col("tied").isNull(), F.col("first")).alias("first"), F.when(low.isNull(), F.col("path")).alias("path"),
    )


def tied_pairs(links: DataFrame, cut: Cut, node: str = "node", parent: str = "parent") -> DataFrame:
    """``above, below``: the descendants of each node in trees that nodes of several parents tie together."""
    rows = _rows(links, node, parent)
    tree, several = _single(rows, cut, False, False)
    edges = cut(rows.where("parent IS NOT NULL").distinct())
    return _tied(cut(tree), edges, several, cut).where("above <> below")


def hierarchy(links: DataFrame, cut: Cut, node: str = "node", parent: str = "parent", with_path: bool = False, with_first: bool = True) -> DataFrame:
    """``node, parent, root, depth, n_below, first, path`` for every node of the links.

    ``cut`` writes a table to the shared folder and reads it again; each round's
    table is cut, so no plan grows with the rounds. ``path`` is null unless asked
    for, and so is ``first`` of nodes on and below cycles.
    """
    rows = _rows(links, node, parent)
    tree, several = _single(rows, cut, with_path, with_first)
    if not several.limit(1).count():
        return tree
    tree, edges = cut(tree), cut(rows.where("parent IS NOT NULL").distinct())
    return _retie(tree, _tied(tree, edges, several, cut))


def _single(rows: DataFrame, cut: Cut, with_path: bool, with_first: bool) -> tuple[DataFrame, DataFrame]:
    """The hierarchy by each node's smallest parent, its own name first; and the nodes that have several."""
    every = rows.unionByName(rows.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    choice = F.struct((F.col("parent") != F.col("node")).alias("k"), "parent")
    nodes = every.groupBy("node").agg(F.min(F.when(F.col("parent").isNotNull(), choice)).alias("c"), F.min("parent").alias("p0"), F.max("parent").alias("p1"))
    nodes = nodes.select("node", F.col("c.parent").alias("parent"), (F.col("p0") != F.col("p1")).alias("several"))
    state, left = _counted(nodes.select("node", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), "several"), cut)
    several = state.where("several").select("node")
    sized, rest = _double(state.drop("several"), left, cut)
    out = _forest(sized, cut, with_path)
    if rest is None:
        return out, several
    low, of = _cycles(rest, cut)
    ring = low.select("node", F.lit(True).alias("ring"))
    loose = of.join(ring, "node", "left").select("node", F.when(F.col("ring").isNull(), F.col("parent")).alias("parent"), "low", F.coalesce("ring", F.lit(False)).alias("ring"))
    loose = cut(loose)
    trees, _ = _double(*_counted(loose.select("node", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), cut), cut)
    found = trees.select("node", "size").join(loose, "node").join(of.select("node", F.col("parent").alias("owner")), "node")
    whole = found.where("ring").groupBy("low").agg(F.sum("size").alias("total"))
    found = found.join(whole, "low", "left")
    found = found.withColumn("first", F.lit(None).cast("long"))
    if with_first:
        # The trees of a cycle's nodes, one after the other.
        numbers = _forest(cut(trees), cut, False).select("node", F.col("root").alias("head"), F.col("first").alias("inner"))
        heads = found.where("ring").select("low", F.col("node").alias("head"), "size").withColumn("bucket", F.pmod(F.xxhash64("head"), F.lit(SIBLING_BUCKETS)))
        heads = running_sum(heads, "low", ["head"], F.col("bucket"), F.col("size"), "offset", own=False).select("head", "offset")
        numbers = numbers.join(heads, "head").select("node", (F.col("offset") + F.col("inner")).alias("place"))
        found = found.join(numbers, "node").withColumn("first", F.col("place")).drop("place")
    on_cycle = found.select(
        "node", F.col("owner").alias("parent"), F.col("low").alias("root"), F.when(F.col("ring"), -1).otherwise(-2).cast("int").alias("depth"), (F.when(F.col("ring"), F.col("total")).otherwise(F.col("size")) - 1).cast("int").alias("n_below"),
        "first", F.lit(None).cast("array<string>").alias("path"),
    )
    return out.unionByName(on_cycle), several


def descendants(tree: DataFrame) -> DataFrame:
    """``root, node, place, first, last``: a node's descendants are the others of its root with a place from ``first`` to ``last``."""
    cycle = F.col("depth") == -1
    first = F.when(cycle, F.lit(0)).otherwise(F.col("first")).cast("long")
    return tree.where("first IS NOT NULL").select("root", "node", F.col("first").alias("place"), first.alias("first"), (first + F.col("n_below")).alias("last"))


def clean_name(name):
    """Lower case, trimmed, single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def ownership(links: DataFrame) -> DataFrame:
    """Node and parent names of ownership links with both ends filled."""
    named = links.select(clean_name(F.col("child")).alias("node"), clean_name(F.col("parent")).alias("parent"))
    return named.where("node <> '' AND parent <> ''").distinct()


def heading_parents(blocks: DataFrame) -> DataFrame:
    """Each heading's parent: the nearest earlier heading of its document with a smaller level.

    Headings are ordered within runs of RUN_LENGTH places and the last heading of
    each level is carried from run to run, so a document of any size is
    spread over many tasks. A null level counts as 1.
    """
    heads = blocks.where("block_type = 'heading' AND doc_id IS NOT NULL AND idx IS NOT NULL").groupBy("doc_id", "idx").agg(F.coalesce(F.min("level"), F.lit(1)).alias("level"))
    levels = sorted(r.level for r in blocks.where("block_type = 'heading'").select(F.coalesce("level", F.lit(1)).alias("level")).distinct().limit(LEVELS_MAX + 1).collect())
    if len(levels) > LEVELS_MAX:
        raise ValueError(f"more than {LEVELS_MAX} heading levels")
    if not levels:
        return heads.select(F.lit("").alias("node"), F.lit("").alias("parent")).limit(0)
    heads = heads.withColumn("run", F.floor(F.col("idx") / RUN_LENGTH))
    last = {v: F.max(F.when(F.col("level") == v, F.col("idx"))) for v in levels}
    within = Window.partitionBy("doc_id", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    local = heads.select("doc_id", "run", "idx", "level", *[last[v].over(within).alias(f"l{k}") for k, v in enumerate(levels)])
    per_run = heads.groupBy("doc_id", "run").agg(*[last[v].alias(f"r{k}") for k, v in enumerate(levels)])
    before = Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_run.select("doc_id", "run", *[F.max(f"r{k}").over(before).alias(f"c{k}") for k in range(len(levels))])
    joined = local.join(carried, ["doc_id", "run"])
    options = [F.when(F.col("level") > v, F.greatest(F.coalesce(f"l{k}", F.lit(-1)), F.coalesce(f"c{k}", F.lit(-1)))).otherwise(F.lit(-1)) for k, v in enumerate(levels)]
    parent = F.greatest(*options, F.lit(-1))
    name = lambda i: F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string"))
    return joined.select(name(F.col("idx")).alias("node"), F.when(parent >= 0, name(parent)).alias("parent"))
