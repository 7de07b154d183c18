"""Queries over whole tables without SQL, against plain Python on small fixtures."""

from srcquarry.operators.graph import closure
from srcquarry.plans import registry

QUERIES = registry()[0]
SYMBOL = "id string, lang string, kind string, fq_name string, file string, start_line int, end_line int, signature_json string"
EDGE = "caller_symbol_id string, callee_symbol_id string, edge_type string"


def put(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_dependency_closure_takes_links_both_ways_and_ends_on_cycles(spark, tmp_path):
    put(spark, tmp_path, "symbols", [(f"s{m}", "java", "class", f"p.{m}", f"{m}.java", 1, 2, None) for m in "abcd"], SYMBOL)
    put(spark, tmp_path, "files", [(f"{m}.java", m, False) for m in "abcd"], "file string, module string, is_test boolean")
    links = [("c", "a", "EXTENDS"), ("a", "b", "implements"), ("b", "c", "EXTENDS"), ("d", "c", "IMPLEMENTS"), ("a", "d", "CALLS"), ("a", "a", "EXTENDS")]
    put(spark, tmp_path, "edges", [(f"s{x}", f"s{y}", k) for x, y, k in links], EDGE)
    got = sorted((r.start, r.node) for r in QUERIES["dependency_closure"](spark, str(tmp_path)).collect())
    assert got == sorted([(x, y) for x in "abc" for y in "abc"] + [("d", y) for y in "abcd"])


def test_expansion_and_bundles_take_every_symbol(spark, tmp_path):
    kinds = {"a": "class", "b": "Method", "c": "constructor", "d": "function"}
    put(spark, tmp_path, "symbols", [(x, "java", k, f"p.{x}", "f.java", *((1, 9) if x == "a" else (3, 3)), None) for x, k in kinds.items()], SYMBOL)
    put(spark, tmp_path, "edges", [("a", "b", "CONTAINS"), ("b", "c", "CALLS"), ("c", "d", "CALLS"), ("d", "a", "TESTS_SOURCE")], EDGE)
    chunk = "id string, symbol_id string, parent_symbol_id string, repo_id string, lang string, chunk_type string, file string, start_line int"
    rows = [(f"k{x}", x, None if x == "a" else "a", "r", "java", "code", "f.java", 1) for x in "abd"]
    rows += [("t1", None, None, "r", "java", "test", "T.java", 1), ("f1", None, None, "r", "java", "fixture", "X.java", 1), ("f2", None, None, "r", "java", "code", "some/Builder.java", 1), ("o", None, None, "q", "java", "test", "a/config.java", 1)]
    put(spark, tmp_path, "chunks", rows, chunk)
    ring = {"a": "b", "b": "c", "c": "d", "d": "a"}
    got = sorted((r.target_id, r.other_id, r.depth) for r in QUERIES["bfs_depth2"](spark, str(tmp_path)).collect())
    assert got == sorted([(x, ring[x], 1) for x in ring] + [(x, ring[ring[x]], 2) for x in ring])
    got = sorted((r.target_id, r.section, r.item_id) for r in QUERIES["retrieval_bundle"](spark, str(tmp_path)).collect())
    want = [(x, "target", x) for x in kinds] + [(x, "container", "a") for x in "bcd"] + [(x, "dependency", ring[x]) for x in ring] + [(x, "chunk", f"k{x}") for x in "abd"] + [("a", "test", "d")]
    want += [(x, section, item) for x in "abd" for section, item in (("similar", "t1"), ("fixture", "f1"), ("fixture", "f2"))]
    assert got == sorted(want)
    got = sorted((r.target_id, r.item_id) for r in QUERIES["retrieval_bundle_http"](spark, str(tmp_path)).filter("section = 'sibling'").collect())
    # Siblings in the container, but not the target's own chunks nor those of its dependencies, which go both ways here.
    assert got == [("b", "kd")] or got == [("b", "kd"), ("d", "kb")]


def test_domain_types_of_the_file_come_before_those_of_the_signature(spark, tmp_path):
    rows = [("m", "java", "method", "p.A#run", "f.java", 3, 4, '{"type":"Clock Order"}'), ("a", "java", "class", "p.A", "f.java", 1, 9, None), ("b", "java", "enum", "p.B", "f.java", 20, 30, None)]
    rows += [("c", "java", "class", "q.Clock", "g.java", 1, 2, None), ("o", "java", "record", "q.Order", "h.java", 1, 2, None), ("x", "java", "method", "q.Clock#now", "g.java", 1, 1, None)]
    put(spark, tmp_path, "symbols", rows, SYMBOL)
    put(spark, tmp_path, "edges", [("m", "o", "CALLS")], EDGE)
    put(spark, tmp_path, "chunks", [], "id string, symbol_id string, parent_symbol_id string, repo_id string, lang string, chunk_type string, file string, start_line int")
    got = {r.item_id: r["rank"] for r in QUERIES["retrieval_bundle"](spark, str(tmp_path)).filter("target_id = 'm' and section = 'domain'").collect()}
    assert got == {"b": 1, "c": 2}


def test_a_container_linked_by_an_edge_stands_in_for_missing_lines(spark):
    from srcquarry.operators.graph import containers

    s = spark.createDataFrame([("c", "java", "class", "C", "f", 1, 5, None), ("k", "ts", "NEST_MODULE", "K", "f", 6, 9, None), ("m", "java", "method", "C#m", "f", None, None, None), ("e", "java", "enum", "E", "f", 1, 9, None), ("n", "java", "method", "n", "f", 7, 7, None)], SYMBOL)
    e = spark.createDataFrame([("c", "m", "Contains"), ("k", "m", "CONTAINS"), ("e", "m", "CONTAINS"), ("c", "n", "CONTAINS")], EDGE)
    assert {r.id: r.container_id for r in containers(s, e).collect()} == {"m": "k", "n": "k"}


def test_equal_vectors_at_the_edge_keep_the_smaller_keys(spark):
    from srcquarry.operators.ranking import nearest_to_each

    rows = [(k, [0.0, 1.0]) for k in range(30, 0, -1)] + [(99, [0.0, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(1)
    q = spark.createDataFrame([(0, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in nearest_to_each(df, q, 4).collect()) == [1, 2, 3, 99]


def test_names_without_a_prefix_are_looked_up(spark, tmp_path):
    rows = [(f"w{k:02d}", "java", "class", f"p{k:02d}.Widget", "f.java", 1, 2, None) for k in range(25)] + [("x", "java", "enum", "q.Fresh", "f.java", 1, 2, None), ("m", "java", "method", "q.Fresh#Other", "f.java", 1, 1, None), ("n", "java", "class", None, "f.java", 1, 1, None)]
    put(spark, tmp_path, "symbols", rows, SYMBOL)
    got = sorted((r.simple, r.id, r["rank"]) for r in QUERIES["symbols_by_simple_name"](spark, str(tmp_path)).collect())
    assert got == [("Fresh", "x", 1)] + [("Widget", f"w{k:02d}", k + 1) for k in range(20)]
    got = sorted(tuple(r) for r in QUERIES["type_name_resolution"](spark, str(tmp_path)).select("name", "module", "id", "step").collect())
    assert got == [("Fresh", "com", "x", 3)] + [("Widget", "com", f"w{k:02d}", 3) for k in range(8)]


def test_closure_reaches_the_end_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(100)], "x string, y string")
    start = spark.createDataFrame([("n000",)], "id string")
    assert sorted(r.node for r in closure(chain, start, "x", "y").collect()) == [f"n{k:03d}" for k in range(101)]
    assert closure(chain, start, "x", "y", depth=3).count() == 4


def test_paths_match_by_suffix_either_way(spark, tmp_path):
    put(spark, tmp_path, "files", [(x,) for x in ("r/a/src/A.java", "r/b/src/A.java", "r/c/B.java")], "file string")
    put(spark, tmp_path, "class_records", [(x,) for x in ("r/a/src/A.java", "b/src/A.java", "/home/ci/r/a/src/A.java", "x/B.java", "x/A.java", "src/A.java")], "file_path string")
    got = {r.file_path: (r.file, r.how) for r in QUERIES["path_suffix_match"](spark, str(tmp_path)).collect()}
    assert got == {
        "r/a/src/A.java": ("r/a/src/A.java", "exact"), "b/src/A.java": ("r/b/src/A.java", "suffix"), "/home/ci/r/a/src/A.java": ("r/a/src/A.java", "suffix"),
        "x/B.java": ("r/c/B.java", "base name"), "x/A.java": (None, "none"), "src/A.java": ("r/a/src/A.java", "suffix"),
    }
