import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from srcquarry.functions import logs as L, paths as P, python as Y, text as X
from srcquarry.operators import summaries as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_text(spark):
    assert one(spark, X.strip_block_comments("s"), s="a/* b\n*/c/**/d") == "acd"
    assert one(spark, X.strip_block_comments("s"), s="a/* open") == "an"
    assert one(spark, X.sanitize("s", comment_limit=5), s="// 123456\nx ") == "// 12…\nx"
    assert one(spark, X.line_range("s", F.lit(2), F.lit(9)), s="a\nb\nc") == "b\nc"
    assert one(spark, X.line_range("s", F.lit(7), F.lit(9)), s="a\nb") == ""
    assert one(spark, X.embedding_input("s", 3), s="  abcdef ") == "abc" and one(spark, X.embedding_input("s"), s=" \n") == " "
    assert one(spark, X.import_name("s"), s="import static a.b.C ; ") == "a.b.C" and one(spark, X.import_name("s"), s="import a.*;") == ""
    assert one(spark, X.member_of_signature("s"), s="a.b.C.m(int, d.E)") == "a.b.C#m" and one(spark, X.member_of_signature("s"), s="m") == "m"
    assert one(spark, X.module_of_path("s"), s="/src/App.tsx") == "src.App" and one(spark, X.module_of_path("s"), s="") == "root"
    assert one(spark, X.web_path("a", "b"), a="/api/", b="//x/") == "/api/x" and one(spark, X.web_path("a", "b"), a="", b="") == "/"
    assert one(spark, X.jaccard("a", "b"), a="one two", b="TWO, three") == 1 / 3 and one(spark, X.jaccard("a", "b"), a="", b="x") == 0
    assert one(spark, X.keyword_boost("a", "b"), a="test jest vitest cypress junit mockito", b=" ".join(X.BOOST_WORDS)) == 0.25
    assert one(spark, X.signature_types("s"), s="OrderResponse from(Order order, List<Order> x)") == ["OrderResponse", "Order", "List"]
    assert one(spark, X.body_types("s"), s="private final Clock clock; Status.OK; String s; new Order()") == ["Clock", "Status", "Order"]
    assert one(spark, X.branch_intents("s"), s="if (a == null) x(); else throw y; switch (b) { case 1: }") == ["exception_path", "if_false_path", "if_true_path", "null_handling", "switch_case_paths", "switch_default_path"]
    assert one(spark, X.is_collaborator("k", "n"), k="class", n="a.OrderService") and one(spark, X.is_collaborator("k", "n"), k=" Interface", n="Repo") and not one(spark, X.is_collaborator("k", "n"), k="class", n="a.model.Order")
    assert one(spark, X.under_test_name("s"), s="a.FooTests") == "a.Foo" and one(spark, X.under_test_name("s"), s="a.Test") is None
    assert one(spark, X.head_tail("s", 1000), s="x" * 2000).count("…") == 1 and one(spark, X.truncate("s", 2), s="abc") == "ab…"
    assert one(spark, X.approx_tokens("s"), s="12345") == 2 and one(spark, X.chunk_type("k", F.lit(False)), k=" API_ROUTE") == "route"


def test_paths(spark):
    for path, want in (("src/test/A.java", True), ("a/it/B.java", True), ("a/reddit/B.java", False), ("x/FooTest.kt", True), ("x/FooIT.java", True), ("a/b.spec.ts", True), ("cypress/x.js", True), ("x/latest.ts", False), ("e2e/x.ts", True), ("x/test.js", True), ("a/greatest.java", True)):
        assert one(spark, P.is_test("p"), p=path) is want, path
    assert one(spark, P.language("p"), p="a/X.KT") == "java" and one(spark, P.language("p"), p="api/openapi.yaml") == "openapi" and one(spark, P.language("p"), p="x.md") is None
    assert one(spark, P.in_skipped_dir("p"), p="a/Node_Modules/x.js") and one(spark, P.in_skipped_dir("p"), p=".git/x") and not one(spark, P.in_skipped_dir("p"), p="src/build.ts")
    assert one(spark, P.normal("p"), p=".\\a\\\\b/../c") == "a/c" and one(spark, P.is_declaration("p"), p="A.D.TS")
    assert one(spark, P.under_any("p", ["app/lib/"]), p="app.lib.angular.js") and not one(spark, P.under_any("p", [" "]), p="x")
    assert one(spark, P.source_candidates("p"), p="src/test/java/a/FooTest.java") == ["src/main/java/a/Foo.java"] and one(spark, P.suggested_test("p"), p="src/main/java/a/Foo.java") == "src/test/java/a/FooTest.java"
    kinds = {"a/x.md": "doc", ".cursor/skills/y/SKILL.md": "skill", "s.sql": "schema", "a/node_modules/r.md": None}
    assert all(one(spark, P.doc_kind("p", F.lit("")), p=k) == v for k, v in kinds.items())
    assert one(spark, P.doc_kind("p", "h"), p="o.yml", h="openapi: 3") == "api" and one(spark, P.doc_kind("p", "h"), p="o.yml", h="x: 3") is None


def test_logs(spark):
    log = "at a.B(Foo.java:12)\nsrc/x.cs(3,4): error CS1002\n'src/a.ts:5:1' again Foo.java:12"
    assert one(spark, L.locations("s"), s=log) == ["Foo.java:12", "src/x.cs:3", "src/a.ts:5"]
    assert one(spark, L.infra_class(F.lit("Kotlin"), "s"), s="Connection refused: MySQL") == "jdbc_connection" and one(spark, L.infra_class(F.lit("go"), "s"), s="Connection refused: MySQL") == ""
    assert one(spark, L.infra_class(F.lit("cs"), "s"), s="Microsoft.Data.Sqlite: initialization string") == "sqlite_connection_string"
    assert one(spark, L.is_compile_shaped("s"), s="x\ne: /a/F.kt:12:5 bad") and not one(spark, L.is_compile_shaped("s"), s="NU1101")
    out = one(spark, L.sanitize_build_log(F.lit("java"), "s"), s="real\n\n\n\n[ERROR]\n[ERROR] Failed to execute goal g\n[ERROR] tail")
    assert out == "real\n\n[ERROR] Failed to execute goal g"
    assert one(spark, L.missing_types("s"), s="symbol:   class a.b.Foo\nlocation: interface q.Bar") == ["Foo", "Bar"]
    assert one(spark, L.diagnostic_lines("s"), s="error: x\n error: x\nok\nfailed y") == 2
    assert one(spark, L.low_value_reason(F.lit("A.cs"), "s"), s="Assert.True( true )") == "tautological always-pass assertion" and one(spark, L.low_value_reason(F.lit("a.ts"), "s"), s="expect(x).toBe(1)") == ""
    assert one(spark, L.empty_test_reason("p", F.lit("class A {}")), p="A.java") and not one(spark, L.empty_test_reason("p", F.lit("it('x')")), p="a.test.ts")
    assert one(spark, S.first_error("s"), s="fine\n  Error: boom ") == "Error: boom" and one(spark, S.gist("s", 10, 5), s="x" * 30).startswith("x" * 10 + "\n")
    assert one(spark, S.narrative("s", "<!--m-->", ["## Files"]), s="text\n## Files\nmore") == "text"


def test_summaries(spark):
    assert S.bisected([("a", 5), ("b", 5), ("c", 9)], 10) == [["a"], ["b"], ["c"]]
    assert S.bisected([], 5) == [] and S.bisected([("x", 99)], 5) == [["x"]]
    df = spark.createDataFrame([("f", "aa"), ("f", "b" * 50), ("f", "c")], "k string, n string")
    r = S.manifest(df, "k", "n", 20).first()
    assert (r.listed, r.omitted, r.body) == (1, 2, "- aa")
    d = spark.createDataFrame([(1, "# Head\n\n- item\nplain one\nplain two\n" + "z" * 500)], "k int, t string")
    assert S.extract(d, "k", "t", 60).first().summary == "# Head\n- item\nplain one"


def test_json(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,{"c":2}]},"x":true}',), (None,), ("{broken",), ('{"a":1}',)], "j string")
    assert [r[0] for r in df.select(Y.json_contains("j", {"a": {"b": [{"c": 2}]}})).collect()] == [True, False, False, False]
    assert Y.json_contained([1], [2, 1]) and not Y.json_contained(1, True) and Y.json_contained({}, {"k": 1})
    doc = json.dumps({"paths": {"/a": {"$ref": "#/x~1y/0"}}, "x/y": [{"$ref": "#/z"}], "z": {"k": 7}, "loop": {"$ref": "#/loop"}})
    d = spark.createDataFrame([(doc,)], "j string")
    assert d.select(Y.resolve_pointer("j", "#/paths/~1a")).first()[0] == '{"k": 7}'
    assert Y.json_pointer(json.loads(doc), "#/loop") is not None and Y.json_pointer(json.loads(doc), "#/none/1") is None


@given(st.text(alphabet="ab \n", max_size=300), st.integers(8, 60))
@settings(max_examples=80, deadline=None)
def test_segments_cover(text, limit):
    s = Y.segments(text, limit)
    assert all(0 < b - a <= limit for a, b in s)
    assert not text or (s[0][0] == 0 and s[-1][1] == len(text) and all(c <= b < d for (_, b), (c, d) in zip(s, s[1:])))


def test_merge_small():
    import pandas as pd

    p = pd.DataFrame({"chunk_type": ["d", "d", "t", "d", "d"], "start_line": [1, 5, 7, 9, 40], "end_line": [4, 6, 8, 10, 41], "size": [40, 40, 40, 40, 40]})
    assert Y.merge_small(p, 300, 800) == [(0, 1), (2, 2), (3, 3), (4, 4)]


def test_merged_chunks_equal_the_fold_per_file(spark):
    import random

    r = random.Random(1)
    rows = [(f"f{r.randrange(9)}", r.choice("de"), a := r.randrange(200), a + r.randrange(6), r.randrange(1, 400)) for _ in range(300)]
    df = spark.createDataFrame(rows, "file string, chunk_type string, start_line int, end_line int, size int")
    got = sorted(map(tuple, Y.merged_chunks(df).collect()))
    want = []
    for f, g in df.toPandas().groupby("file"):
        g = g.sort_values(["start_line", "end_line", "size", "chunk_type"]).reset_index(drop=True)
        want += [(f, k, b - a + 1, int(g["start_line"][a]), int(g["end_line"][a : b + 1].max())) for k, (a, b) in enumerate(Y.merge_small(g, 300, 800))]
    assert got == sorted(want)
    assert Y.merged_chunks(df.limit(0)).count() == 0


def test_windows_and_responses():
    text = "\n".join(f"line {k}" for k in range(1, 400))
    w = Y.window_text(text, [200], 700)
    assert "200: line 200" in w and len(w) <= 700 and Y.window_text(text, [999]).startswith("1: ")
    assert Y.response_files('x ```json\n{"a.ts": "1"}\n``` y') == {"a.ts": "1"}
    assert Y.response_files('{"files": [{"path": "b", "content": "2"}]}') == {"b": "2"} and Y.response_files("nothing") == {}
    assert Y.without_bodies("class A { int f; void m() { if (x) { y(); } } int g() { return 1; } }") == "class A { int f; void m() { … } int g() { … } }"


def test_embedding_bisects(spark):
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if len(texts) > 2 or any(len(t) > 100 for t in texts):
            raise Y.LimitExceeded
        return [Y.hash_vector(t, 4) for t in texts]

    out = Y.embed_all(["a", "b", "c" * 250, "d"], provider, least=32)
    assert {i for i, _, _ in out} == {0, 1, 2, 3} and all(len(t) <= 100 for _, t, _ in out)
    df = Y.embedded(spark.createDataFrame([(1, "x"), (2, None)], "id int, t string"), "id", "t")
    rows = {r.id: r.embedding for r in df.collect()}
    assert len(rows[1]) == 64 and abs(sum(v * v for v in rows[1]) - 1) < 1e-5


def test_a_text_refused_as_too_large_keeps_all_its_pieces():
    def provider(texts):
        if any(len(t) > 60 or "#" in t for t in texts):
            raise Y.LimitExceeded
        return [[float(len(t))] for t in texts]

    text = "".join(f"line {k:03d}\n" for k in range(40))
    out = Y.embed_all(["a", text, "#" * 10, "b"], provider, least=32)
    assert [t for i, t, _ in out if i == 0] == ["a"] and [v for i, _, v in out if i == 2] == [None] and out[-1][:2] == (3, "b")
    pieces = [t for i, t, _ in out if i == 1]
    assert len(pieces) > 5 and all(p in text for p in pieces) and set("".join(pieces).split()) == set(text.split())


def test_failures_of_the_environment_mind_case_where_they_have_to(spark):
    assert one(spark, L.infra_class(F.lit("cs"), "s"), s="argumentexception: connection string") == ""
    assert one(spark, L.infra_class(F.lit("cs"), "s"), s="System.ArgumentException: Connection String") == "connection_configuration"
    assert one(spark, L.infra_class(F.lit("cs"), "s"), s="microsoft.data.sqlite: initialization string") == ""


def test_low_value_tests(spark):
    cases = [
        ("A.java", "// nothing\n/* here */\n", "placeholder/no-op content without behavioral test logic"),
        ("A.cs", '[Fact(Skip = "later")]\npublic void A() { }', "empty skipped xUnit test shell"),
        ("a.ts", "it.skip('x', () => { expect(f(1)).toBe(2); })", ""),
        ("a.ts", "it.skip('x', () => { // later\n })", "empty skipped JS/TS test shell"),
        ("A.cs", "using X;\nnamespace N {\n  public sealed class A : B {\n  }\n}", "empty C# namespace/class scaffold without test methods"),
        ("A.java", "class A {}", ""),
        ("A.cs", "Assert.Throws<ArgumentNullException>(() => new Foo(null))", "constructor null-guard smoke test without behavioral assertions"),
        ("A.cs", "Assert.Throws<ArgumentNullException>(() => new Foo(null)); mock.Verify(x)", ""),
        ("SmokeTest.cs", "Assert.NotNull(x);", "smoke/reference-only non-behavioral test"),
    ]
    for path, text, want in cases:
        assert one(spark, L.low_value_reason(F.lit(path), "s"), s=text) == want, (path, text)
    assert one(spark, L.empty_test_reason(F.lit("a_test.go"), "s"), s="package a\nfunc helper() {}") != "" and one(spark, L.empty_test_reason(F.lit("a_test.go"), "s"), s="package a\nfunc TestX(t *testing.T) {}") == ""
