"""Hierarchies against a walk over parents."""

import random

import pytest

from lexmill.operators.hierarchy import descendants, heading_parents, hierarchy, ownership, tied_pairs


def walk(parents):
    nodes = set(parents) | {p for p in parents.values() if p}
    out = {}
    below = {n: set() for n in nodes}
    for n in nodes:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parents.get(x)
        for a in seen[1:]:
            below[a].add(n)
        if x is not None:
            ring = seen[seen.index(x) :]
            out[n] = (min(ring), -1 if n in ring else -2)
            for a in ring:
                if a != n:
                    below[a].add(n)
        else:
            out[n] = (seen[-1], len(seen) - 1)
    return {(n, *out[n], len(below[n] - {n})) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_cycles(spark, cut, seed):
    r = random.Random(seed)
    parents = {f"n{k:03}": (f"n{r.randrange(200):03}" if seed else f"n{r.randrange(k):03}") for k in range(1, 120)}
    df = spark.createDataFrame(list(parents.items()), "node string, parent string")
    got = {(x.node, x.root, x.depth, x.n_below) for x in hierarchy(df, cut).collect()}
    assert got == walk(parents)


@pytest.mark.parametrize("seed", range(3))
def test_descendants_of_forests_with_cycles(spark, cut, seed):
    r = random.Random(seed)
    parents = {f"n{k:03}": f"n{r.randrange(150):03}" for k in range(1, 140)}
    tree = hierarchy(spark.createDataFrame(list(parents.items()), "node string, parent string"), cut)
    rows = {x.node: x for x in descendants(tree).collect()}
    want = {n: b for n, _, _, b in walk(parents)}
    assert set(rows) == set(want)
    for n, x in rows.items():
        under = {m for m, y in rows.items() if y.root == x.root and x.first <= y.place <= x["last"] and m != n}
        assert len(under) == want[n]
        for m in under:
            seen, y = set(), m
            while y is not None and y not in seen:
                seen.add(y)
                y = parents.get(y)
            assert n in seen


@pytest.mark.parametrize("seed", range(4))
def test_nodes_of_several_parents_count_below_each(spark, cut, seed):
    r = random.Random(seed)
    edges = {(f"n{k:02}", f"n{r.randrange(k):02}") for k in range(1, 40)} | {(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(1 + 2 * seed)} | {("solo", "alone"), ("b", "a"), ("b", "c")}
    links = spark.createDataFrame(sorted(edges), "node string, parent string")
    got = {x.node: x for x in hierarchy(links, cut).collect()}
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            x = todo.pop()
            new = {c for c, p in edges if p == x} - reach[n]
            reach[n] |= new
            todo += new
    for n in nodes:
        assert got[n].n_below == len(reach[n] - {n})
        rings = {a for a in nodes if n in reach[a] and a in reach[a]}
        if n in reach[n]:
            assert got[n].depth == -1 and got[n].root == min(a for a in reach[n] if n in reach[a])
        elif rings:
            assert got[n].depth == -2 and got[n].root in rings
        else:
            assert got[n].depth >= 0
    assert got["a"].n_below == got["c"].n_below == 1 and got["b"].root == "a" and got["alone"].first == 0
    pairs = {(x.above, x.below) for x in tied_pairs(links, cut).collect()}
    assert {("a", "b"), ("c", "b")} <= pairs and all(b in reach[a] for a, b in pairs) and not any("alone" in p for p in pairs)


def test_long_chain_paths_and_intervals(spark, cut):
    df = spark.createDataFrame([(f"c{k:02}", f"c{k - 1:02}") for k in range(1, 40)] + [("x", "c05"), ("y", "c05"), ("z", "x")], "node string, parent string")
    tree = hierarchy(df, cut, with_path=True)
    rows = {r.node: r for r in tree.collect()}
    assert rows["c39"].depth == 39 and rows["c39"].path[0] == "c00" and len(rows["c39"].path) == 40
    assert rows["z"].path == ["c00", "c01", "c02", "c03", "c04", "c05", "x", "z"]
    span = {r.node: (r.place, r["last"]) for r in descendants(tree).collect()}
    under = lambda a: {n for n, (f, _) in span.items() if span[a][0] < f <= span[a][1]}
    assert under("x") == {"z"} and under("c37") == {"c38", "c39"} and len(under("c05")) == 37
    assert sorted(f for f, _ in span.values()) == list(range(len(span)))


def test_hot_parent_nulls_repeats_and_empty(spark, cut):
    rows = [(f"k{k}", "top") for k in range(300)] + [("k1", "top"), (None, "top"), ("", "top"), ("lone", None), ("me", "me"), ("kid", "me")]
    got = {r.node: r for r in hierarchy(spark.createDataFrame(rows, "node string, parent string"), cut).collect()}
    assert got["top"].n_below == 300 and got["lone"].depth == 0 and got["me"].depth == -1 and got["me"].n_below == 1 and got["kid"].depth == -2
    assert hierarchy(spark.createDataFrame([], "node string, parent string"), cut).count() == 0


def test_names_and_headings(spark):
    links = spark.createDataFrame([("A  Co", " b co "), ("a co", "B CO"), (None, "x"), ("", "y")], "child string, parent string")
    assert [tuple(r) for r in ownership(links).collect()] == [("a co", "b co")]
    blocks = spark.createDataFrame([(1, 0, "heading", 1), (1, 1, "heading", 3), (1, 2, "heading", 2), (1, 2, "heading", 2), (1, 5000, "heading", 3), (1, 6, "paragraph", None), (2, 0, "heading", None)], "doc_id long, idx int, block_type string, level int")
    got = {r.node: r.parent for r in heading_parents(blocks).collect()}
    assert got == {"1:0": None, "1:1": "1:0", "1:2": "1:0", "1:5000": "1:2", "2:0": None}
    assert heading_parents(blocks.where("false")).count() == 0
