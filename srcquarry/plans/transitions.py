"""State changes of queues and runs, point lookups, path flags, cubes: tables before and after."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcquarry.functions import logs as L, paths as P, python as Y, text as X
from srcquarry.operators import changes as C, queues as Q, rows as R
from srcquarry.plans.base import Tables, query
from srcquarry.plans.lookups import SQL as LOOKUPS

QUERIES: dict = {}
SQL: dict[str, str] = {}
_q = query(QUERIES)

_NOW = "1997-01-01 00:00:00"


def _jobs(t: Tables):
    """Orders as jobs of a queue."""
    state = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return t.orders.select(F.col("o_orderkey").alias("id"), state.alias("status"), F.col("o_orderdate").alias("run_at"), F.lit(None).cast("long").alias("created_run_id"))


def _ended(t: Tables):
    """The first line of each order as the end of its job."""
    return t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("run_id"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_shipdate").alias("next_run_at")).distinct()


def _runs(t: Tables):
    return t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("run_id"))


_ALL_JOBS = """j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS run_at FROM orders),
    d AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS run_id, l_returnflag <> 'R' AS ok, l_shipdate AS next_run_at FROM lineitem WHERE l_linenumber = 1),
    k AS (SELECT s_suppkey AS run FROM supplier WHERE s_acctbal > 0), x AS (SELECT d.*, run FROM d LEFT JOIN k ON run = run_id QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY run_id, {0}) = 1)"""
_JOBS = _ALL_JOBS.format("ok")


@_q
def queue_claim(t: Tables):
    """Jobs after the hundred oldest that are due have been claimed."""
    return Q.claim(_jobs(t), F.lit(_NOW).cast("timestamp_ntz"), 100).select("id", "status")


SQL["queue_claim"] = f"""WITH {_JOBS}, c AS (SELECT id FROM j WHERE status = 'pending' AND run_at <= TIMESTAMP '{_NOW}' ORDER BY run_at, id LIMIT 100)
    SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' ELSE status END AS status FROM j"""


@_q
def queue_settle(t: Tables):
    """Jobs after the running ones have ended: completed or failed, with the run they made if it exists."""
    return Q.settle(_jobs(t), _ended(t).select("id", "run_id", "ok"), _runs(t)).select("id", "status", "created_run_id")


SQL["queue_settle"] = f"""WITH {_JOBS} SELECT j.id, CASE WHEN status = 'running' AND x.id IS NOT NULL THEN CASE WHEN ok THEN 'completed' ELSE 'failed' END ELSE status END AS status,
    CASE WHEN status = 'running' THEN run END AS created_run_id FROM j LEFT JOIN x ON x.id = j.id"""


@_q
def queue_reschedule(t: Tables):
    """Jobs after the running ones have been set to their next time."""
    return Q.reschedule(_jobs(t), _ended(t).select("id", "run_id", "next_run_at"), _runs(t))


SQL["queue_reschedule"] = f"""WITH {_ALL_JOBS.format('next_run_at')} SELECT j.id, CASE WHEN status = 'running' AND x.id IS NOT NULL THEN 'pending' ELSE status END AS status,
    CASE WHEN status = 'running' AND x.id IS NOT NULL THEN next_run_at ELSE run_at END AS run_at, CASE WHEN status = 'running' THEN run END AS created_run_id FROM j LEFT JOIN x ON x.id = j.id"""


@_q
def queue_cancel(t: Tables):
    """Jobs after those with a returned first line have been cancelled as far as they were pending."""
    return Q.cancel(_jobs(t), _ended(t).filter("not ok")).select("id", "status")


SQL["queue_cancel"] = f"WITH {_JOBS} SELECT id, CASE WHEN status = 'pending' AND id IN (SELECT id FROM d WHERE NOT ok) THEN 'cancelled' ELSE status END AS status FROM j"


def _one_run(t: Tables):
    return t.index_runs.groupBy("run_id").agg(F.max("repo_id").alias("repo_id"), F.max("status").alias("status"), F.max("stable").alias("stable"), F.max("iterations").alias("iterations")).filter("run_id is not null")


_RUN = "r AS (SELECT run_id, max(repo_id) AS repo_id, max(status) AS status, max(stable) AS stable, max(iterations) AS iterations FROM index_runs WHERE run_id IS NOT NULL GROUP BY run_id)"


@_q
def run_completion(t: Tables):
    """Runs after those with a log have been completed, as far as they still ran; iterations are the steps logged."""
    done = t.audit_log.filter("run_id is not null").groupBy("run_id").agg(F.count_distinct("id").cast("int").alias("iterations")).withColumn("stable", F.lit(True))
    return C.complete(_one_run(t), done).select("run_id", "status", "stable", "iterations")


SQL["run_completion"] = f"""WITH {_RUN}, d AS (SELECT run_id, CAST(count(DISTINCT id) AS INT) AS n FROM audit_log WHERE run_id IS NOT NULL GROUP BY run_id),
    x AS (SELECT r.*, n, n IS NOT NULL AND lower(status) = 'running' AS hit FROM r LEFT JOIN d USING (run_id))
    SELECT run_id, CASE WHEN hit THEN 'completed' ELSE status END AS status, CASE WHEN hit THEN true ELSE stable END AS stable, CASE WHEN hit THEN n ELSE iterations END AS iterations FROM x"""


@_q
def run_failures(t: Tables):
    """Runs after those with a logged error have failed, as far as they still ran; runs known from the log only are added."""
    failed = t.audit_log.filter("run_id is not null and lower(log_level) = 'error'").select("run_id", F.lit("").alias("repo_id"))
    return C.fail(_one_run(t), failed).select("run_id", "repo_id", "status")


SQL["run_failures"] = f"""WITH {_RUN}, d AS (SELECT DISTINCT run_id FROM audit_log WHERE run_id IS NOT NULL AND lower(log_level) = 'error')
    SELECT coalesce(r.run_id, d.run_id) AS run_id, CASE WHEN d.run_id IS NULL THEN repo_id ELSE coalesce(repo_id, 'unknown') END AS repo_id,
      CASE WHEN d.run_id IS NOT NULL AND (r.run_id IS NULL OR lower(status) = 'running') THEN 'failed' ELSE status END AS status FROM r FULL JOIN d ON d.run_id = r.run_id"""


@_q
def run_states(t: Tables):
    """State and iteration of each run that the audit log names: point reads in bulk."""
    asked = t.audit_log.select("run_id").filter("run_id is not null").distinct()
    return t.index_runs.select("run_id", "status", "current_iteration", "iterations").distinct().join(asked, "run_id", "left_semi")


SQL["run_states"] = "SELECT DISTINCT run_id, status, current_iteration, iterations FROM index_runs WHERE run_id IN (SELECT run_id FROM audit_log)"


@_q
def chunks_by_id(t: Tables):
    """Place of the first chunk of each symbol, read by its id: point reads in bulk."""
    asked = t.chunks.filter("symbol_id is not null").groupBy("symbol_id").agg(F.min("id").alias("id")).select("id").distinct()
    return t.chunks.select("id", "repo_id", "file", "start_line", "end_line").distinct().join(asked, "id", "left_semi")


SQL["chunks_by_id"] = "SELECT DISTINCT id, repo_id, file, start_line, end_line FROM chunks WHERE id IN (SELECT min(id) FROM chunks WHERE symbol_id IS NOT NULL GROUP BY symbol_id)"


@_q
def symbol_cube(t: Tables):
    """Symbols by language and kind with all subtotals, and the median number of lines."""
    s = t.symbols.select("id", F.lower("lang").alias("lang"), F.lower("kind").alias("kind"), (F.col("end_line") - F.col("start_line") + 1).alias("n")).distinct()
    return s.cube("lang", "kind").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("symbols"), F.percentile("n", 0.5).alias("median_lines"))


SQL["symbol_cube"] = """WITH s AS (SELECT DISTINCT id, lower(lang) AS lang, lower(kind) AS kind, end_line - start_line + 1 AS n FROM symbols)
    SELECT lang, kind, CAST(grouping(lang) * 2 + grouping(kind) AS INT) AS level, count(*) AS symbols, quantile_cont(n, 0.5) AS median_lines FROM s GROUP BY CUBE (lang, kind)"""


@_q
def path_flags(t: Tables):
    """Files in directories that are not scanned, and declaration files."""
    return t.files.select("file").distinct().filter("file is not null").select("file", P.in_skipped_dir("file").alias("skipped"), P.is_declaration("file").alias("declaration"))


SQL["path_flags"] = f"""WITH f AS (SELECT DISTINCT file, string_split(lower(regexp_replace(file, '/?[^/]*$', '')), '/') AS d FROM files WHERE file IS NOT NULL)
    SELECT file, list_has_any(d, [{', '.join(f"'{x}'" for x in P.SKIPPED_DIRS)}]) OR len(list_filter(d, lambda x: regexp_matches(x, '^\\.[^./]'))) > 0 AS skipped, ends_with(lower(trim(file)), '.d.ts') AS declaration FROM f"""


@_q
def text_ends(t: Tables):
    """Digest of each document cut to its head and tail."""
    out = X.head_tail("text", 2000)
    return t.documents.filter("text is not null").select("doc_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).cast("long").alias("size")).distinct()


SQL["text_ends"] = """WITH d AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1500) || chr(10) || '…' || chr(10) || right(text, 500) ELSE text END AS s FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT doc_id, md5(s) AS digest, length(s) AS size FROM d"""


@_q
def metadata_pointer(t: Tables):
    """A value of the metadata of each chunk by its JSON pointer."""
    return t.chunks.select("id", "chunk_metadata").distinct().select("id", Y.resolve_pointer("chunk_metadata", "#/symbol_kind").alias("kind"))


SQL["metadata_pointer"] = "SELECT DISTINCT id, CASE WHEN json_valid(chunk_metadata) THEN json_extract_string(chunk_metadata, '$.symbol_kind') END AS kind FROM chunks"


@_q
def stored_chunks(t: Tables):
    """Chunks with a vector of the stored dimension as they are inserted: type defaulted, NUL dropped."""
    c = C.same_dimension(t.chunks.filter(F.size("embedding") == 64), 64)
    return c.select("id", "chunk_type", F.md5(F.col("content").cast("binary")).alias("digest")).distinct()


SQL["stored_chunks"] = "SELECT DISTINCT id, coalesce(nullif(chunk_type, ''), 'definition') AS chunk_type, md5(replace(content, chr(0), '')) AS digest FROM chunks WHERE len(embedding) = 64"


@_q
def event_rollup(t: Tables):
    """Events by type and day with subtotals, users counted once."""
    e = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "value")
    return e.rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total"))


SQL["event_rollup"] = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 3) AS total FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))"


@_q
def missing_type_files(t: Tables):
    """Files of the types a compiler misses: main sources that declare a type of the name, the shortest paths first, five of a log."""
    logs = t.documents.filter("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z0-9]{3,})(?![A-Za-z0-9_])"), F.lit(1))).alias("name")).distinct()
    # Names that a document mentions stand in for compiler lines: the names go through the same extraction.
    lines = logs.select("doc_id", F.explode(L.missing_types(F.concat(F.lit("  symbol:   class x."), "name"))).alias("name"))
    types = t.symbols.filter(F.lower("kind").isin("class", "interface", "enum", "record", "struct")).select(X.simple_name("fq_name").alias("name"), "file").filter("name is not null and file is not null").distinct()
    main = types.join(t.files.groupBy("file").agg(F.max("is_test").alias("is_test")).filter("not is_test"), "file", "left_semi").filter(~P.is_test("file"))
    # A log names a file once; of one name at most five files can be among its five.
    first = R.top_per_group(main, ["name"], [F.length("file"), F.col("file")], 5, "nth").drop("nth")
    return R.top_per_group(lines.join(first, "name").select("doc_id", "file").distinct(), ["doc_id"], [F.length("file"), F.col("file")], 5)


SQL["missing_type_files"] = rf"""WITH l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9]{{3,}})\b', 1)) AS name FROM documents WHERE text IS NOT NULL),
    t AS (SELECT DISTINCT regexp_extract(fq_name, '([^.#]*)$', 1) AS name, file FROM symbols WHERE lower(kind) IN ('class', 'interface', 'enum', 'record', 'struct') AND fq_name IS NOT NULL AND file IS NOT NULL),
    m AS (SELECT name, file FROM t WHERE file IN (SELECT file FROM files GROUP BY file HAVING NOT max(is_test)) AND NOT ({LOOKUPS["test_path_classifier"].split("SELECT DISTINCT file, is_test,")[1].split("AS by_path")[0]}))
    SELECT doc_id, file, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(file), file) AS INT) AS rank FROM (SELECT DISTINCT doc_id, file FROM l JOIN m USING (name)) QUALIFY rank <= 5"""
