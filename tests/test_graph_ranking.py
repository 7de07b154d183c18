import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcquarry.functions import text as X
from srcquarry.operators import graph as G, ranking as K

SYM = "id string, lang string, kind string, fq_name string, file string, start_line int, end_line int, signature_json string"
EDGE = "caller_symbol_id string, callee_symbol_id string, edge_type string"
FILE = "file string, module string, is_test boolean"


def sym(i, fq="x.Y", file="f", a=1, b=9, kind="class", lang="java", sig=None):
    return (i, lang, kind, fq, file, a, b, sig)


def test_expand_matches_a_walk(spark):
    r = random.Random(7)
    edges = sorted({(str(r.randrange(12)), str(r.randrange(12)), r.choice(["CALLS", "IMPORTS", "EXTENDS"])) for _ in range(30)})
    df = spark.createDataFrame(edges, EDGE)
    got = {(x.target_id, x.other_id): x.depth for x in G.expand(df, spark.createDataFrame([("0",), ("3",)], "id string"), "java_unit", 3).collect()}
    for t in ("0", "3"):
        dist, front = {t: 0}, [t]
        for d in (1, 2, 3):
            front = [b for b in {c for a, c, _ in edges if a in front} if b not in dist]
            dist |= {b: d for b in front}
        assert {k[1]: v for k, v in got.items() if k[0] == t} == {k: v for k, v in dist.items() if v}


def test_expand_takes_the_best_edge_and_both_ways(spark):
    e = spark.createDataFrame([("t", "a", "imports"), ("t", "a", " Calls"), ("b", "t", "ROUTE_TO_HANDLER")], EDGE)
    unit = G.expand(e, spark.createDataFrame([("t",)], "id string")).collect()
    assert [(x.other_id, x.edge_type, x.path) for x in unit] == [("a", "CALLS", "CALLS")]
    http = {x.other_id: x.path for x in G.expand(e, spark.createDataFrame([("t",)], "id string"), "spring", 1).collect()}
    assert http == {"a": "CALLS", "b": "ROUTE_TO_HANDLER←"}


def test_containers_and_types(spark):
    s = spark.createDataFrame([sym("o", a=1, b=300), sym("i", a=100, b=200), sym("m", kind="method", a=150, b=151), sym("z", kind="method", file="g")], SYM)
    assert {x.id: x.container_id for x in G.containers(s).collect()} == {"i": "o", "m": "i"}


def test_resolution_order(spark):
    s = spark.createDataFrame([sym("1", "com.example.model.Order"), sym("2", "a.b.Clock"), sym("3", "Clock"), sym("4", "com.x.Repo")], SYM)
    n = spark.createDataFrame([("Order", "com.example.api"), ("Clock", "a.b"), ("Nonexistent", "a"), ("Repo", "com.x")], "name string, module string")
    assert sorted(map(tuple, G.resolve_names(n, s).collect())) == [("Clock", "a.b", "3", 1), ("Order", "com.example.api", "1", 3), ("Repo", "com.x", "4", 2)]
    i = spark.createDataFrame([("a.b.Clock.now",), ("q.Z",)], "import_name string")
    assert [tuple(x) for x in G.resolve_imports(i, s).collect()] == [("a.b.Clock.now", "2", "a.b.Clock")]


def test_tests_source(spark):
    s = spark.createDataFrame([sym("t", "p.FooTest", "T.java"), sym("p", "p.Foo", "P.java"), sym("q", "p.Bar", "P.java"), sym("u", "p.Test", "T.java")], SYM)
    f = spark.createDataFrame([("T.java", "m", True), ("P.java", "m", False)], FILE)
    e = spark.createDataFrame([("t", "q", "calls "), ("q", "t", "CALLS"), ("t", "p", "CONTAINS")], EDGE)
    assert sorted(map(tuple, G.tests_source(e, s, f).collect())) == [("t", "p"), ("t", "q")]


def test_route_keys(spark):
    df = spark.createDataFrame([("API_ROUTE:get:/a:b@x@h",), ("API_CLIENT_REQUEST:GET:/a@x@h:L3",), ("nope",)], "fq string")
    got = df.select(X.route_key("fq", "API_ROUTE", True).alias("r"), X.route_key("fq", "API_CLIENT_REQUEST", False).alias("c")).collect()
    assert [tuple(x) for x in got] == [("GET:/a:b@x", None), (None, "GET:/a"), (None, None)]


def test_profiles():
    assert G.profile(" Spring ") == "http_api" and G.profile("?") == "java_unit" and K.pool_size(0) == 20 and K.pool_size(50) == 120
    assert "MODULE_PROVIDES" not in G.PROFILE_PRIORITY["nest_module"]


def test_gap_rules(spark):
    s = spark.createDataFrame([sym("a", "p.A", "pay/A.java"), sym("b", "p.B", "x/B.java"), sym("c", "p.C", "x/C.java"), sym("d", "p.D", "x/B.java", 3, 4, "method", "java", '{"visibility":"private"}'), sym("e", "p.E", "x/E.java")], SYM)
    f = spark.createDataFrame([(p, "m", False) for p in ("pay/A.java", "x/B.java", "x/C.java", "x/E.java")], FILE)
    e = spark.createDataFrame([(str(k), "b", "CALLS") for k in range(4)] + [("t", "c", "TESTS_SOURCE")], EDGE)
    got = {x.id: (x.kind, x.priority, x.reason[:8]) for x in K.gap_scores(s, f, e, ["java"], ["pay"], spark.createDataFrame([("x/E.java",)], "file string")).collect()}
    assert got == {"a": ("business_critical", 30, "business"), "b": ("low_coverage_central", 4, "central "), "c": ("no_tests", -38, "traceabi"), "e": ("no_tests", -20, "extend e")}


def test_mmr_matches_a_plain_greedy(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((15, 6))
    rel = rng.random(15)
    df = spark.createDataFrame([(1, k, v[k].tolist(), float(rel[k])) for k in range(15)], "query_id int, vec_id int, embedding array<double>, relevance double")
    got = [x.vec_id for x in K.mmr(df, 6).orderBy("pick").collect()]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want: list[int] = []
    while len(want) < 6:
        score = {i: (rel[i] if not want else 0.5 * rel[i] - 0.5 * max(0.0, max(u[i] @ u[j] for j in want))) for i in range(15) if i not in want}
        want.append(max(score, key=lambda i: (score[i], -i)))
    assert got == want


def test_nearest_and_limits(spark):
    df = spark.createDataFrame([(k, [float(k % 4), 0.0]) for k in range(8)] + [(9, [1.0])], "vec_id int, embedding array<float>")
    assert [x.vec_id for x in K.nearest(df, [0.0, 0.0], 3).collect()] == [0, 4, 1]
    each = K.nearest_to_each(df, df.filter("vec_id = 1"), 3)
    assert [(x.vec_id, x.rank) for x in each.orderBy("rank").collect()] == [(1, 1), (5, 2), (0, 3)]
    with pytest.raises(ValueError, match="queries"):
        K.nearest_to_each(df, df, 3, most=2)


def test_cosine_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [x[0] for x in df.select(K.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_closure_and_gate(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "x string, y string")
    got = {(r.start, r.node) for r in G.closure(e, spark.createDataFrame([("a",), ("d",)], "id string"), "x", "y").collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d")}
    df = spark.createDataFrame([(0, None), (3, 0.2), (3, 0.9)], "n int, best double")
    assert [x[0] for x in df.select(K.sufficient(F.col("n"), F.col("best"), F.lit(True), 2, 0.5)).collect()] == [False, False, True]
