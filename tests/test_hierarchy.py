import random

import pytest

from srcquarry.operators import hierarchy as h
from srcquarry.operators.components import connected_components
from srcquarry.operators.hierarchy import contains_edges, descendants, extra_parents, hierarchy, loops

EDGE = "caller_symbol_id string, callee_symbol_id string, edge_type string"


def plain(links):
    parent = {}
    for p, c in links:
        parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in {x for pair in links for x in pair}:
        path, at = [n], n
        while at in parent and len(path) <= len(parent) + 1:
            at = parent[at]
            path.append(at)
        out[n] = ("", -1, ()) if len(path) > len(parent) + 1 else (at, len(path) - 1, tuple(reversed(path)))
    return out


def test_random_forests_match_walking_up(spark):
    r = random.Random(5)
    for size in (6, 40):
        links = sorted({(f"n{r.randrange(size)}", f"n{r.randrange(size)}") for _ in range(size)})
        tree = hierarchy(spark.createDataFrame(links, "parent string, child string"), keep_path=True).collect()
        got = {x.symbol_id: (x.root_symbol_id, x.depth, tuple(x.path)) for x in tree}
        assert len(tree) == len(got)
        assert got == plain(links)


def test_long_chain_and_descendants(spark):
    links = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(25)]
    tree = hierarchy(spark.createDataFrame(links, "parent string, child string"), keep_path=True)
    assert tree.count() == 26 and tree.agg({"depth": "max"}).first()[0] == 25
    assert descendants(tree).count() == 26 * 25 // 2


def test_loops_and_what_hangs_below(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s"), ("r", "x"), ("p", "q"), ("q", "p")]
    links = spark.createDataFrame(rows, "parent string, child string")
    tree = hierarchy(links)
    got = {x.symbol_id: (x.root_symbol_id, x.depth) for x in tree.collect()}
    assert got["r"] == ("r", 0) and got["x"] == ("r", 1)
    # c has the parents b and c's own loop; the smallest parent decides.
    assert {n for n, v in got.items() if v == ("", -1)} == {"a", "b", "c", "d", "e", "s", "p", "q"}
    assert {(x.symbol_id, x.loop_id) for x in loops(links, tree).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("s", "s"), ("p", "p"), ("q", "p")}


def test_odd_rows(spark):
    rows = [("a", "b", " contains "), ("a", "b", "CONTAINS"), (None, "c", "CONTAINS"), ("a", None, "contains\t"), ("a", "z", "CALLS"), ("", "k", "Contains")]
    links = contains_edges(spark.createDataFrame(rows, EDGE))
    got = {x.symbol_id: (x.root_symbol_id, x.depth) for x in hierarchy(links).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "": ("", 0), "k": ("", 1), "c": ("c", 0)}
    empty = contains_edges(spark.createDataFrame([], EDGE))
    assert hierarchy(empty).count() == 0 and hierarchy(empty, True).count() == 0


def test_extra_columns_and_several_parents(spark):
    df = spark.createDataFrame([("b", "x", 1, 2, "p"), ("a", "x", 3, 4, "q")], "parent string, child string, depth int, symbol_id int, path string")
    got = {x.symbol_id: (x.root_symbol_id, x.depth) for x in hierarchy(df, keep_path=True).collect()}
    assert got == {"a": ("a", 0), "b": ("b", 0), "x": ("a", 1)}
    assert [(x.child, x.parent) for x in extra_parents(df).collect()] == [("x", "b")]


@pytest.mark.parametrize("hot_links", [10_000, 300])
def test_hot_parent(spark, monkeypatch, hot_links):
    monkeypatch.setattr(h, "HOT_LINKS", hot_links)
    links = spark.range(5000).selectExpr("case when id % 3 = 0 then 'hot' else concat('p', id % 7) end as parent", "concat('c', id) as child")
    links = links.union(spark.createDataFrame([("c0", "x"), ("x", "y"), ("r", "hot"), ("c3", "z")], "parent string, child string"))
    tree = hierarchy(links, keep_path=True)
    assert {r.symbol_id: "/".join(r.path) for r in tree.filter("symbol_id in ('hot', 'y', 'z')").collect()} == {"hot": "r/hot", "y": "r/hot/c0/x/y", "z": "r/hot/c3/z"}
    tree = hierarchy(links)
    assert tree.count() == 5000 + 7 + 5
    assert tree.filter("root_symbol_id = 'r'").count() == 1 + 1 + 1667 + 3


def test_components_match_union_find(spark):
    r = random.Random(9)
    for n, m in ((30, 20), (60, 90)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(200 + k, 201 + k) for k in range(30)] + [(500, 500 + k) for k in range(1, 40)]
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
