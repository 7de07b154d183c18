import pytest
from pyspark.sql import functions as F

from srcquarry.functions.python import hash_vector
from srcquarry.ingest import index
from srcquarry.schemas import PARSED_FILE
from srcquarry.store import Store


def parsed_row(path, cls, calls=(), test=False, lines=20):
    sym = [("class", f"p.{cls}", 1, lines, 1, 1, '{"visibility":"public"}'), ("method", f"p.{cls}#run", 2, lines - 1, 1, 1, None)]
    return (path, "java", "m", test, sym, [(f"p.{cls}#run", c, "calls", None) for c in calls] + [(f"p.{cls}", f"p.{cls}#run", "CONTAINS", None)])


def file_row(path, text, test=False):
    return (path, "java", str(hash(text)), test, text)


FILES = "file string, lang string, sha string, is_test boolean, source string"


def test_incremental_index(spark, tmp_path):
    text = "\n".join(f"line {k} of the class body" for k in range(1, 21))
    store = Store(spark, str(tmp_path / "store"))
    files = [file_row("r/A.java", text), file_row("r/ATest.java", text, True), file_row("r/skipped.java", text)]
    parsed = [parsed_row("./r/A.java".removeprefix("./"), "A"), parsed_row("r/ATest.java", "ATest", ["p.A#run", "gone"], True)]
    make = lambda f, p: (spark.createDataFrame(f, FILES), spark.createDataFrame(p, PARSED_FILE))
    first = index(store, "r", *make(files, parsed))
    assert (first["added"], first["symbols"], first["chunks"], first["unresolved"]) == (2, 4, 4, 1)
    edges = {(r.edge_type) for r in store.edges.collect()}
    assert edges == {"CALLS", "CONTAINS", "TESTS_SOURCE"} and store.edges.filter("edge_type = 'TESTS_SOURCE'").count() == 2
    again = index(store, "r", *make(files, parsed))
    assert (again["added"], again["changed"], again["removed"], again["forced"], again["chunks"]) == (0, 0, 0, 0, 4)
    changed = [file_row("r/A.java", text + "\nmore"), files[2]]
    last = index(store, "r", *make(changed, [parsed[0]]))
    assert (last["changed"], last["removed"], last["symbols"], last["chunks"], last["tests_source"]) == (1, 1, 2, 2, 0)
    store.delete_chunks(repo="r")
    assert index(store, "r", *make(changed, [parsed[0]]))["forced"] == 1
    chunk = store.list_chunks(repo="r", chunk_type="definition", contains={"chunk_index": 0}, limit=1).first()
    assert chunk.content.startswith("[symbol_kind=class fq_name=p.A]\n\nline 1")
    hit = store.search(hash_vector(chunk.content), 1, repo="r").first()
    assert hit.id == chunk.id and hit.distance < 1e-5
    with pytest.raises(ValueError, match="dimension"):
        store.search([0.0], repo="r")
    with pytest.raises(ValueError, match="prefix"):
        store.list_chunks(file="a", prefix="b")
    assert store.symbols_by_fq("p.A").count() == 1 and store.types_by_simple_name("A").count() == 1 and store.symbols_by_fq_substring("RUN").count() == 1
    s = store.symbols_by_file("r/A.java").first()
    assert store.symbol(s.id).count() == 1 and store.edges_from(s.id).count() == 1 and store.symbols_by_test("java", "class", False).count() == 1
    store.align(32, "local", "hash")
    assert store.chunks.count() == 0 and store.embedding_provider.first().dimension == 32


def test_runs_and_audit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    runs = [(f"r{k}", "repo", "c", "Completed " if k % 2 else "failed", 1000 + k, 0, 0, 5 * k if k > 3 else None, 1, None, None, None) for k in range(6)]
    store.write("index_runs", spark.createDataFrame(runs, store.index_runs.schema))
    page, n = store.list_runs(repo="repo", status="completed", since=1001, limit=2)
    assert n == 3 and [r.run_id for r in page.collect()] == ["r5", "r3"]
    assert [r.run_id for r in store.list_runs(scheduled=True)[0].collect()] == ["r4", "r5"] and store.due(20).count() == 1
    audit = spark.range(1, 30).select("id", F.lit("r1").alias("run_id"), F.lit("s").alias("step"), F.lit("info").alias("log_level"), F.lit("{}").alias("payload"), F.expr("timestamp_ntz '2025-01-01'").alias("logged_at"))
    store.write("audit_log", audit)
    assert [r.id for r in store.list_audit(run="r1", after=20, limit=3).collect()] == [21, 22, 23]
