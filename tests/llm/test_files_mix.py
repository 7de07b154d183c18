import random

import numpy as np
import pytest

from srcquarry.llm import function_docs as fd, generated_files as gf, mixing
from srcquarry.llm.forest import Forest

JAVA = '''package p;

/** The class. */
public class A {
    /** Drops the ring unless it is held. {@link X} */
    @Override
    @Named("a) {")
    public void drop(int x) {
        String s = "} /** not a doc */ {"; char c = '"'; // }
        if (x > 0) { run(); }
    }

    /** {@inheritDoc} */
    void inherits() {}

    /** Real text about nothing known. */
    // an ordinary comment
    /* and another */ A() { }

    /** first */ /** Second explains the thing well. */
    int two() { return 2; }

    /** TODO document */
    int todo();

    /** Merges the coach. */
    void mergeCoach();

    int field; /** Gets it. */ int getIt() { return """
        } /** text block */ " \\""" """; }

    /** Explains a lot here. */
    int other = 1;
    void undocumented() { }
    /** tail text says something. */ void sameLine() { /** inner */ }
}
'''


def lines(text):
    return {m: k for k, line in enumerate(text.split("\n"), 1) for m in ("@Override", "inherits()", "A() {", "two()", "todo()", "mergeCoach()", "getIt()", "undocumented()", "sameLine()") if m in line}


RECORD = "file_path string, methods array<struct<fq_name: string, kind: string, signature: string, start_line: int, end_line: int>>, content string"


def test_documented_methods(spark):
    at = lines(JAVA)
    names = {"@Override": "drop", "inherits()": "inherits", "A() {": "A", "two()": "two", "todo()": "todo", "mergeCoach()": "mergeCoach", "getIt()": "getIt", "undocumented()": "undocumented", "sameLine()": "sameLine"}
    methods = [(f"p.A#{names[k]}", "method", "", n, n) for k, n in at.items()]
    records = spark.createDataFrame([(".\\src\\A.java", methods, "x"), ("./src/A.java", methods, "x"), ("src/A.java", None, "x"), ("src/none.java", methods, "x"), (None, methods, "x"), ("src/A.java", [("p.A#far", "method", "", 999, 999), ("p.A#nil", "method", "", None, 1)], "x")], RECORD)
    sources = spark.createDataFrame([("src/A.java", JAVA, "r"), ("src/B.java", None, "r"), ("src/C.java", "", "r")], "file string, content string, methods string")
    got = {r.name: r for r in fd.method_docs(records, sources).collect()}
    assert set(got) == {"drop", "A", "two", "sameLine"}
    assert got["drop"].file == "src/A.java" and got["drop"].start_line == at["@Override"]
    assert got["drop"].code.startswith("@Override") and got["drop"].code.endswith("{ run(); }\n    }")
    assert got["two"].documentation == "Second explains the thing well."
    assert fd.method_docs(records.limit(0), sources).count() == 0 and fd.method_docs(records, sources.limit(0)).count() == 0


@pytest.mark.parametrize("text,name,want", [
    ("Drops the ring unless it is held.", "drop", True), ("drop", "drop", False), ("Drop.", "drop", False), ("Gets the lift policy.", "getLiftPolicy", False),
    ("Returns the lift policy.", "getLiftPolicy", False), ("Flushs the stair.", "flushStair", False), ("TODO", "x", False), ("TODO: document", "x", False), ("FIXME nobody wrote one yet", "x", False),
    ("-", "x", False), ("...", "x", False), ("n/a", "x", False), ("Auto-generated method stub", "x", False), ("Documentation is missing here; please add a sentence.", "x", False), ("Javadoc.", "x", False),
    ("Safe to call twice per node.", "retryLobby", True), ("Prüft, ob der Shard passt.", "x", True), ("Drops it. TODO: also cover the rest", "drop", True), ("", "x", False), ("索引を更新する", "x", True),
])
def test_says_something(text, name, want):
    assert fd.says_something(text, name) is want


def test_lexer_survives_unclosed_things():
    for text in ("/** open", 'String s = "open', "'", "/*", "/", "class A { /** x */", "/**/ int a;", ""):
        lx = fd.Lexed([text, "int b; // c"])
        assert len(lx.start) == len(lx.stop) == len(lx.is_doc)
    assert not fd.Lexed(["/**/ int a;"]).is_doc.any()


def test_forest_held_out_accuracy():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5) | (x[:, 4] > 1.2)).astype(float)
    f = Forest(trees=25).fit(x[:1000], y[:1000])
    assert ((f.score(x[1000:]) >= 0.5) == (y[1000:] == 1)).mean() > 0.95
    assert ((f.out_of_bag >= 0.5) == (y[:1000] == 1)).mean() > 0.93


def test_notices_are_seen_and_hidden():
    for head in ("// Code generated by x. DO NOT EDIT.\n", "/* This file was automatically generated by y. */\n", "/**\n * @license lib 1.2 | (c) the lib authors\n */\n"):
        text = head + "package p;\nclass A {}\n"
        assert gf.has_notice(text) and "enerated" not in gf.without_notice(text) and "license" not in gf.without_notice(text)
    for head in ("// Ids are generated by the seat; do not edit them in this module.\n", "// Renders code generated from the schema; the output lives elsewhere.\n", "// Copyright (c) Atlas Works. Licensed under the Meadow Licence.\n", ""):
        assert not gf.has_notice(head + "package p;\nclass A {}\n")
    assert gf.features(["", "a b\nc"]).shape == (2, len(gf.FEATURES))


def hand(r):
    return "import x from 'y';\n" + "\n".join(f"function {r.choice(['load', 'merge', 'scan'])}{k}(a, b) {{\n    // {r.choice(['keeps order', 'may wait', 'old rule'])}\n    return a.{r.choice(['map', 'run'])}(b) + {r.randrange(99)};\n}}" for k in range(r.randrange(4, 14)))


def minified(r):
    return ";".join(f"var {r.choice('abcxyz')}={r.choice('abcxyz')}({r.choice('abcxyz')},{r.randrange(99)})||{{}}" for _ in range(r.randrange(40, 90)))


def test_files_held_out(spark):
    r = random.Random(4)
    rows, truth = [], set()
    for k in range(400):
        bad = k % 5 == 0
        body = minified(r) if bad else hand(r)
        if bad and k % 10 == 0:
            body = "/*! bundle 1.2.3 */\n" + body
        name = f"repo{k % 7}/mod/src/file{k}.js"
        rows.append((name, f"repo{k % 7}", body, 1))
        truth |= {name} if bad else set()
    rows += [("repo0/mod/src/null.js", "repo0", None, 1), ("repo0/mod/src/empty.js", "repo0", "", 1)]
    sources = spark.createDataFrame(rows, "file string, repo_id string, content string, notice int")
    files = sources.select("file").union(sources.select("file").limit(5)).union(spark.createDataFrame([(None,)], "file string"))
    got = {x.file for x in gf.not_hand_written(files, sources).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 4
    assert gf.not_hand_written(files.limit(0), sources.limit(0)).count() == 0


DOC = "doc_id long, text string, source string, total long, start int"
TARGET = "source string, target_share double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    r = random.Random(6)
    rows = [(k, " ".join(["word"] * r.randint(1, 60)), r.choice(["big"] * 6 + ["mid", "mid", "tiny"]), 1, 1) for k in range(900)]
    rows += [(5000, None, "big", 1, 1), (5001, "", "mid", 1, 1), (5002, "lost", None, 1, 1), (5003, "lost", "other", 1, 1), *rows[:4]]
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 4), ("tiny", 0.15, 3), ("none", 0.05, 2)], TARGET)
    mix = mixing.Mix(spark.createDataFrame(rows, DOC), targets, slot=256)
    plan = mix.plan.toPandas()
    shares = {x.source: x for x in mix.shares().collect()}
    assert abs(shares["big"].share_of_total - 0.3) < 0.01 and abs(shares["mid"].share_of_total - 0.5) < 0.01
    assert shares["none"].used_tokens == 0 and shares["none"].available_tokens == 0
    for s, cap in (("big", 1), ("mid", 4), ("tiny", 3)):
        own = plan[plan.source == s]
        assert own.groupby("doc_id").use.nunique().max() <= cap
        # Every block but the last of a source is full.
        sizes = own.groupby("slot").n_tokens.sum().sort_index()
        assert set(sizes[:-1]) <= {256} and 0 < sizes.iloc[-1] <= 256
    assert not set(plan.doc_id) & {5000, 5001, 5002, 5003}
    assert not plan.duplicated(["doc_id", "use", "from_token"]).any()
    assert sorted(set(plan.slot)) == list(range(plan.slot.nunique())) and (plan.groupby("slot").source.nunique() == 1).all()
    assert plan.n_tokens.sum() == sum(x.used_tokens for x in shares.values())
    # Every stretch has the shares of the whole.
    plan = plan.sort_values("slot")
    part = plan[plan.slot < plan.slot.median()]
    assert abs(part[part.source == "mid"].n_tokens.sum() / part.n_tokens.sum() - plan[plan.source == "mid"].n_tokens.sum() / plan.n_tokens.sum()) < 0.06


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, None), (None, 0.1, 1)], TARGET)
    mix = mixing.Mix(spark.createDataFrame([], DOC), targets)
    assert mix.plan.count() == 0 and {(x.source, x.used_tokens) for x in mix.shares().collect()} == {("a", 0), ("b", 0)}
    one = mixing.Mix(spark.createDataFrame([(1, "x y z", "a", 1, 1), (2, "q r", "b", 1, 1)], DOC), targets)
    assert {x.source for x in one.plan.collect()} <= {"a"}
    assert mixing.Mix(spark.createDataFrame([(1, "x", "a", 1, 1)], DOC), targets.limit(0)).shares().count() == 0


def test_notices_are_searched_in_the_whole_header_all_lines_and_the_last_line():
    from srcquarry.llm.generated_files import has_notice, without_notice

    code = "class A {\n" + "".join(f"    int f{k};\n" for k in range(60)) + "}\n"
    imports = "package p;\n" + "".join(f"import p.q.Some{k}LongName;\n" for k in range(200))
    assert has_notice(imports + '@Generated("tool")\n' + code)
    assert has_notice("/*\n" + " * Permission is granted to use this.\n" * 200 + " */\n// Code generated by tool. DO NOT EDIT.\n" + code)
    mapped = code + "//# sourceMappingURL=data:application/json;base64," + "QUJD" * 300
    assert has_notice(mapped) and "sourceMappingURL" not in without_notice(mapped)
    assert not has_notice(imports + code)
