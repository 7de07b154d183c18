import json

from pyspark.sql import functions as F

from srcquarry.catalog import Catalog
from srcquarry.operators import rows as R
from srcquarry.schemas import schema
from srcquarry.sources import scan
from srcquarry.streaming import streams


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def test_repository(spark, tmp_path):
    for name, text in {"src/A.java": "class A {}", "src/test/ATest.java": "class ATest {}", "node_modules/x.js": "x", "src/t.d.ts": "t", "web/p.ts": "p", "README.md": "# hi", ".git/c.js": "c", "lib/old/z.cs": "z"}.items():
        put(tmp_path, name, text)
    got = {r.file: (r.lang, r.is_test, r.source) for r in scan.repository(spark, str(tmp_path), ["lib/old"]).collect()}
    assert got == {"src/A.java": ("java", False, "class A {}"), "src/test/ATest.java": ("java", True, "class ATest {}"), "web/p.ts": ("typescript", False, "p")}


def test_documents(spark, tmp_path):
    for name, text in {"a.md": "x", ".cursor/skills/k/SKILL.md": "y", "api.yaml": "openapi: 3.0", "plain.yaml": "k: v", "db/s.sql": "z", "node_modules/n.md": "n", "big.md": "b" * 3000}.items():
        put(tmp_path, name, text)
    assert {r.file: r.kind for r in scan.documents(spark, str(tmp_path), largest=2000).collect()} == {"a.md": "doc", ".cursor/skills/k/SKILL.md": "skill", "api.yaml": "api", "db/s.sql": "schema"}
    assert [r.file for r in scan.documents(spark, str(tmp_path), "db").collect()] == ["db/s.sql"]


def test_parsed_files(spark, tmp_path):
    row = {"path": "a.ts", "lang": "typescript", "module": "m", "is_test": False, "symbols": [{"kind": "CLASS", "fq_name": "a.A", "start_line": 1, "end_line": 9}, {"kind": "METHOD", "fq_name": "a.A.m", "start_line": 2, "end_line": 3}], "edges": [{"caller_fq_name": "a.A", "callee_fq_name": "a.A.m", "edge_type": " contains"}, {"caller_fq_name": "a.A", "callee_fq_name": "gone", "edge_type": "CALLS"}]}
    put(tmp_path, "p.jsonl", json.dumps(row) + "\nnot json\n")
    parsed = scan.parsed_files(spark, str(tmp_path / "p.jsonl")).filter("path is not null")
    symbols = scan.symbols_of(parsed)
    edges, lost = scan.edges_of(parsed, symbols)
    assert symbols.count() == 2 and len(symbols.first().id) == 64
    assert [r.edge_type for r in edges.collect()] == ["CONTAINS"] and [tuple(r) for r in lost.collect()] == [("CALLS", 0, 1)]
    put(tmp_path, "c.jsonl", json.dumps({"kind": "class", "fqName": "a.A", "filePath": "a/A.java", "methods": [{"fqName": "a.A#m", "startLine": 3}]}) + "\n" + json.dumps({"kind": "java_meta"}) + "\n")
    assert [(r.fqName, r.methods[0].startLine) for r in scan.class_records(spark, str(tmp_path / "c.jsonl")).collect()] == [("a.A", 3)]


def test_api_routes(spark):
    doc = {"openapi": "3", "paths": {"/a": {"get": {"operationId": "list"}, "post": {}}, "/b": {"$ref": "#/x"}}, "x": {"delete": {}}}
    df = spark.createDataFrame([("o.json", json.dumps(doc)), ("p.yaml", "swagger: '2'\npaths:\n  /c:\n    put: {}\n"), ("q.json", "{}"), ("r", None)], "file string, content string")
    got = {(r.file, r.method, r.route) for r in scan.api_routes(df).collect()}
    assert got >= {("o.json", "GET", "/a"), ("o.json", "POST", "/a"), ("o.json", "DELETE", "/b")} and all(f in ("o.json", "p.yaml") for f, _, _ in got)


def test_outline_packages_manifests(spark, tmp_path):
    src = 'package p.q;\npublic class A {\n  private int x(String s) {\n    return "}".length();\n  }\n  interface B {\n  }\n}\n'
    got = [tuple(r)[1:] for r in scan.java_outline(spark.createDataFrame([("A.java", src)], "file string, content string")).collect()]
    assert got == [("class", "p.q.A", 2, 8), ("method", "p.q.A#x", 3, 5), ("interface", "p.q.A.B", 6, 7)]
    put(tmp_path, "package.json", json.dumps({"name": "root", "devDependencies": {"jest": "1", "cypress": "2"}}))
    put(tmp_path, "apps/w/package.json", json.dumps({"name": "w", "dependencies": {"react": "1"}, "devDependencies": {"vitest": "1"}}))
    put(tmp_path, "be/pom.xml", "<x/>")
    deps = scan.packages(spark, str(tmp_path))
    assert {(r.package_dir, r.framework) for r in scan.frameworks(deps).collect()} == {(".", "jest"), ("apps/w", "vitest")}
    assert {(r.ecosystem, r.file) for r in scan.primary_manifests(spark, str(tmp_path)).collect()} == {("node", "package.json"), ("maven", "be/pom.xml")}


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.symbols.count() == 0
    c.init()
    rows = spark.createDataFrame([("f", "s1", "java", "m", False)], schema("files"))
    c.write("files", rows)
    c.write("files", c.files.withColumn("sha", F.lit("s2")))
    c.write("files", rows.withColumn("file", F.lit("g")), "append")
    assert {(r.file, r.sha) for r in c.files.collect()} == {("f", "s2"), ("g", "s1")}
    chunk = spark.createDataFrame([("1", "x", [1.0], None, None, "f", "l", "definition", repo, 1, 2, None) for repo in ("r1", "r2")], schema("chunks"))
    c.write("chunks", chunk)
    c.replace_repo("chunks", chunk.filter("repo_id = 'r1'").withColumn("content", F.lit("new")))
    assert {(r.repo_id, r.content) for r in c.chunks.collect()} == {("r1", "new"), ("r2", "x")}


def test_tail_and_heartbeats(spark, tmp_path):
    a = schema("audit_log")
    spark.createDataFrame([], a).write.parquet(str(tmp_path / "log"), mode="append")
    df = spark.sql("select cast(1 as bigint) id, 'r' run_id, 's' step, 'info' log_level, '{}' payload, timestamp_ntz '2025-01-01 00:00:00' logged_at union all select 2, 'r', 's', 'info', '{}', timestamp_ntz '2025-01-01 00:05:00'")
    df.write.parquet(str(tmp_path / "log"), mode="append")
    s = streams.tail(spark, str(tmp_path / "log")).withColumn("at", F.col("logged_at"))
    assert streams.run_once(streams.heartbeats(s), "beats", "complete").first().last_heartbeat_at.minute == 5


def events(spark, path):
    rows = [(k, f"2025-01-01 00:{k:02d}:00", "run", 1.0) for k in (0, 1, 2, 20, 21, 50)] + [(99, "2025-01-01 02:00:00", "run", 1.0)]
    df = spark.createDataFrame(rows, "id long, t string, run_id string, value double").select("id", F.to_timestamp("t").alias("at"), "run_id", "value")
    for part in (df.filter("id < 99"), df.filter("id = 99")):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_silent_runs_and_windows(spark, tmp_path):
    s = events(spark, str(tmp_path / "e"))
    got = sorted((r.start.minute, r.beats) for r in streams.run_once(streams.silent_runs(s), "silent").collect())
    assert got == [(0, 3), (20, 2), (50, 1)]
    w = streams.windowed(s.withColumnRenamed("at", "ts").withColumnRenamed("run_id", "event_type"), "10 minutes")
    assert sorted((r.start.minute, r.n, r.total) for r in streams.run_once(w, "wins").collect()) == [(0, 3, 3.0), (20, 2, 2.0), (50, 1, 1.0)]


def test_ingest_batches(spark, tmp_path):
    p = str(tmp_path / "f")
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], "file string, sha string, seq int").coalesce(1).write.parquet(p)
    seen = []
    s = spark.readStream.schema("file string, sha string, seq int").parquet(p)
    for _ in range(2):  # the second run finds nothing new
        streams.ingest(s, lambda df, epoch: seen.extend((r.file, r.sha) for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == [("a", "2"), ("b", "1")]


def test_stream_breaker_equals_batch(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [(k, i, r.choice("ab"), r.randrange(9)) for k in ("x", "y") for i in range(12)]
    df = spark.createDataFrame(rows, "run_id string, id bigint, signature string, size bigint")
    p = str(tmp_path / "b")
    for lo in (0, 6):
        df.filter(f"id >= {lo} and id < {lo + 6}").coalesce(1).write.mode("append").parquet(p)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(p)
    got = {(x.key, x.id): (x.streak, x.recurrences, x.idle, x.verdict) for x in streams.run_once(streams.breaker(s), "breaks").collect()}
    want = {(x.run_id, x.id): (x.streak, x.recurrences, x.idle, x.verdict or "") for x in R.breaker(df, ["run_id"], [F.col("id")], "signature", "size").collect()}
    assert got == want
