"""Aggregations, fingerprints, set operations, runs, projects and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcquarry.functions import text as X
from srcquarry.operators import changes as C, graph as G, rows as R
from srcquarry.plans.base import Tables, query
from srcquarry.plans.joins import _SYM

QUERIES: dict = {}
SQL: dict[str, str] = {}
_q = query(QUERIES)


@_q
def global_counts(t: Tables):
    """Rows and distinct keys of the main relations."""
    def one(name, df, key):
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys")).select(F.lit(name).alias("relation"), "n_rows", "n_keys")

    return one("symbols", t.symbols, "id").union(one("files", t.files, "file")).union(one("chunks", t.chunks, "id")).union(one("index_runs", t.index_runs, "run_id"))


SQL["global_counts"] = " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {n}" for n, k in (("symbols", "id"), ("files", "file"), ("chunks", "id"), ("index_runs", "run_id")))


@_q
def chunks_by_repo(t: Tables):
    """Distinct chunks per repository, by type."""
    return t.chunks.select("id", "repo_id", "chunk_type").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_type") == "test").alias("tests"), F.count_if(F.col("chunk_type") == "definition").alias("definitions"))


SQL["chunks_by_repo"] = "SELECT repo_id, count(*) AS chunks, count(*) FILTER (chunk_type = 'test') AS tests, count(*) FILTER (chunk_type = 'definition') AS definitions FROM (SELECT DISTINCT id, repo_id, chunk_type FROM chunks) GROUP BY 1"


@_q
def audit_recent_runs(t: Tables):
    """Runs by their most recent audit entry."""
    return R.page(t.audit_log.filter("run_id is not null").groupBy("run_id").agg(F.max("logged_at").alias("last_at"), F.count(F.lit(1)).alias("entries")), [F.desc("last_at"), F.col("run_id")], 20)


SQL["audit_recent_runs"] = "SELECT run_id, max(logged_at) AS last_at, count(*) AS entries FROM audit_log WHERE run_id IS NOT NULL GROUP BY 1 ORDER BY last_at DESC, run_id LIMIT 20"


@_q
def edge_type_counts(t: Tables):
    """Edges by canonical type, with how many of their ends are unknown."""
    ids = t.symbols.select("id").distinct().withColumn("known", F.lit(1))
    e = G.distinct_edges(t.edges)
    j = e.join(ids.select(F.col("id").alias("caller_symbol_id"), F.col("known").alias("a")), "caller_symbol_id", "left").join(ids.select(F.col("id").alias("callee_symbol_id"), F.col("known").alias("b")), "callee_symbol_id", "left")
    return j.groupBy(F.substring("edge_type", 1, 64).alias("edge_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").isNull()).alias("unknown_callers"), F.count_if(F.col("b").isNull()).alias("unknown_callees"))


SQL["edge_type_counts"] = f"""WITH {_SYM} SELECT substr(edge_type, 1, 64) AS edge_type, count(*) AS n, count(*) FILTER (caller_symbol_id NOT IN (SELECT id FROM s)) AS unknown_callers,
    count(*) FILTER (callee_symbol_id NOT IN (SELECT id FROM s)) AS unknown_callees FROM e GROUP BY 1"""


@_q
def edge_type_sample(t: Tables):
    """Up to 16 edge types out of each symbol, sorted."""
    return G.distinct_edges(t.edges).groupBy("caller_symbol_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("edge_type")), 1, 16), ",").alias("types"))


SQL["edge_type_sample"] = f"WITH {_SYM} SELECT caller_symbol_id, array_to_string(list_sort(list(DISTINCT edge_type))[1:16], ',') AS types FROM e GROUP BY 1"


@_q
def lang_vote(t: Tables):
    """Languages of each repository and the one that wins (script, then Java, then C# on a tie)."""
    f = t.files.select("file", F.lower(F.trim("lang")).alias("lang")).distinct().withColumn("repo", F.substring_index("file", "/", 1))
    n = f.groupBy("repo").agg(F.count_if(F.col("lang") == "java").alias("java"), F.count_if(F.col("lang").isin("javascript", "typescript")).alias("script"), F.count_if(F.col("lang") == "csharp").alias("csharp"))
    vote = F.when((F.col("script") >= F.col("java")) & (F.col("script") >= F.col("csharp")) & (F.col("script") > 0), "script").when((F.col("java") >= F.col("csharp")) & (F.col("java") > 0), "java").when(F.col("csharp") > 0, "csharp").otherwise("")
    return n.withColumn("vote", vote)


SQL["lang_vote"] = """WITH f AS (SELECT DISTINCT file, lower(trim(lang)) AS lang, split_part(file, '/', 1) AS repo FROM files),
    n AS (SELECT repo, count(*) FILTER (lang = 'java') AS java, count(*) FILTER (lang IN ('javascript', 'typescript')) AS script, count(*) FILTER (lang = 'csharp') AS csharp FROM f GROUP BY 1)
    SELECT *, CASE WHEN script >= java AND script >= csharp AND script > 0 THEN 'script' WHEN java >= csharp AND java > 0 THEN 'java' WHEN csharp > 0 THEN 'csharp' ELSE '' END AS vote FROM n"""


@_q
def module_rollup(t: Tables):
    """Files per module and directory with a digest of their sorted paths."""
    f = t.files.select("module", "file").distinct().withColumn("dir", F.regexp_replace("file", r"/[^/]*$", ""))
    return f.groupBy("module", "dir").agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("file")), "\n"), 256).alias("digest"))


SQL["module_rollup"] = """SELECT module, regexp_replace(file, '/[^/]*$', '') AS dir, count(*) AS files, sha256(array_to_string(list_sort(list(file)), chr(10))) AS digest
    FROM (SELECT DISTINCT module, file FROM files) GROUP BY 1, 2"""


@_q
def token_usage_sum(t: Tables):
    """Milliseconds and files of the audit payloads per step; a missing total falls back to the parts."""
    a = t.audit_log.dropDuplicates(["id"]).withColumn("ms", F.get_json_object("payload", "$.ms").try_cast("long")).withColumn("files", F.get_json_object("payload", "$.files").try_cast("long"))
    total = F.when(F.col("ms") > 0, F.col("ms")).otherwise(F.coalesce("files", F.lit(0)))
    return a.groupBy("step").agg(F.sum(total).alias("total"), F.sum("ms").alias("ms"), F.sum("files").alias("files"), F.count_if(F.col("ms").isNull()).alias("broken"))


SQL["token_usage_sum"] = """WITH a AS (SELECT DISTINCT id, step, TRY_CAST(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.ms') END AS BIGINT) AS ms,
      TRY_CAST(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.files') END AS BIGINT) AS files FROM audit_log)
    SELECT step, CAST(sum(CASE WHEN ms > 0 THEN ms ELSE coalesce(files, 0) END) AS BIGINT) AS total, CAST(sum(ms) AS BIGINT) AS ms, CAST(sum(files) AS BIGINT) AS files, count(*) FILTER (ms IS NULL) AS broken FROM a GROUP BY 1"""


@_q
def plan_totals(t: Tables):
    """Code points, tokens and segmented chunks per chunk type."""
    c = t.chunks.select("id", "chunk_type", "content", "chunk_metadata").distinct()
    seg = F.coalesce(F.get_json_object("chunk_metadata", "$.chunk_index").try_cast("int"), F.lit(0)) > 0
    return c.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("code_points"), F.sum(X.approx_tokens("content")).alias("tokens"), F.count_if(seg).alias("segmented"))


SQL["plan_totals"] = """SELECT chunk_type, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS code_points, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens,
      count(*) FILTER (coalesce(TRY_CAST(CASE WHEN json_valid(chunk_metadata) THEN json_extract_string(chunk_metadata, '$.chunk_index') END AS INT), 0) > 0) AS segmented
    FROM (SELECT DISTINCT id, chunk_type, content, chunk_metadata FROM chunks) GROUP BY 1"""


@_q
def layout_fingerprint(t: Tables):
    """Digest of the sorted directories below the module of each repository."""
    f = t.files.select(F.substring_index("file", "/", 1).alias("repo"), F.get(F.split("file", "/"), 2).alias("segment")).filter("segment <> ''").distinct()
    sep = F.lit("\0")
    return f.groupBy("repo").agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set("segment")), "\0"), sep), 256).alias("digest"), F.count(F.lit(1)).alias("segments"))


SQL["layout_fingerprint"] = """SELECT repo, sha256(array_to_string(list_sort(list(DISTINCT segment)), chr(0)) || chr(0)) AS digest, count(*) AS segments
    FROM (SELECT DISTINCT split_part(file, '/', 1) AS repo, split_part(file, '/', 3) AS segment FROM files) WHERE segment <> '' GROUP BY 1"""


@_q
def file_fingerprint(t: Tables):
    """Digest of path and content hash of the files of each repository."""
    f = t.files.select(F.substring_index("file", "/", 1).alias("repo"), F.concat_ws(":", "file", "sha").alias("line")).distinct()
    return f.groupBy("repo").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))


SQL["file_fingerprint"] = """SELECT repo, sha256(array_to_string(list_sort(list(line)), chr(10))) AS digest
    FROM (SELECT DISTINCT split_part(file, '/', 1) AS repo, concat_ws(':', file, sha) AS line FROM files) GROUP BY 1"""


@_q
def loop_signature(t: Tables):
    """Signature of step, sorted paths and text of the audit entries of each run and step."""
    a = t.audit_log.filter("run_id is not null").select("run_id", "step", F.lower("log_level").alias("level")).distinct()
    g = a.groupBy("run_id", "step").agg(F.array_join(F.array_sort(F.collect_set("level")), "\x1e").alias("levels"))
    return g.select("run_id", "step", F.substring(F.sha1(F.concat_ws("\x1e", "step", "levels").cast("binary")), 1, 16).alias("signature"))


SQL["loop_signature"] = """SELECT run_id, step, substr(sha1(step || chr(30) || array_to_string(list_sort(list(DISTINCT lower(log_level))), chr(30))), 1, 16) AS signature
    FROM audit_log WHERE run_id IS NOT NULL GROUP BY 1, 2"""


@_q
def set_operations(t: Tables):
    """Names in tests and in production files: union, both, only one, with first-wins precedence."""
    f = G.one_file(t.files).select("file", "is_test")
    s = G.placed_symbols(t.symbols).join(f, "file").select(F.regexp_extract("fq_name", r"([^.#]*)$", 1).alias("name"), "is_test").filter("name is not null")
    tests, prod = s.filter("is_test").select("name").distinct(), s.filter("not is_test").select("name").distinct()
    both = tests.intersect(prod).withColumn("part", F.lit("both"))
    return both.unionByName(tests.exceptAll(prod).withColumn("part", F.lit("tests"))).unionByName(prod.exceptAll(tests).withColumn("part", F.lit("production")))


SQL["set_operations"] = f"""WITH {_SYM}, n AS (SELECT DISTINCT regexp_extract(fq_name, '([^.#]*)$', 1) AS name, is_test FROM s JOIN f USING (file) WHERE fq_name IS NOT NULL),
    a AS (SELECT name FROM n WHERE is_test), b AS (SELECT name FROM n WHERE NOT is_test)
    SELECT name, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT name, 'tests' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT name, 'production' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""


# ---- ingest
_PREV = "SELECT file, CASE WHEN length(file) % 11 = 0 THEN sha || 'x' ELSE sha END AS sha FROM f WHERE length(file) % 7 <> 0 UNION ALL SELECT file || '.gone', sha FROM f WHERE length(file) % 13 = 0"


def _snapshots(t: Tables):
    """Current files, and an earlier state made from them: some missing, some changed, some since removed."""
    now = t.files.groupBy("file").agg(F.min("sha").alias("sha"))
    n = F.length("file")
    before = now.filter(n % 7 != 0).select("file", F.when(n % 11 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")).alias("sha"))
    return now, before.union(now.filter(n % 13 == 0).select(F.concat("file", F.lit(".gone")).alias("file"), "sha"))


@_q
def change_detection(t: Tables):
    """Added, changed and removed files between two snapshots, in one full outer join."""
    now, before = _snapshots(t)
    return C.diff(now, before)


_CHANGES = f"""f AS (SELECT file, min(sha) AS sha FROM files GROUP BY file), p AS ({_PREV}),
    d AS (SELECT coalesce(f.file, p.file) AS file, CASE WHEN p.file IS NULL THEN 'added' WHEN f.file IS NULL THEN 'removed' ELSE 'changed' END AS change
          FROM f FULL JOIN p ON f.file = p.file WHERE f.sha IS DISTINCT FROM p.sha OR f.file IS NULL OR p.file IS NULL)"""
SQL["change_detection"] = f"WITH {_CHANGES} SELECT * FROM d"


@_q
def run_delta(t: Tables):
    """Totals of a change set with the symbols and chunks of the files concerned."""
    now, before = _snapshots(t)
    return C.delta(C.diff(now, before), t.symbols.select("id", "file").distinct(), t.chunks.select("id", "file").distinct())


SQL["run_delta"] = f"""WITH {_CHANGES} SELECT (SELECT count(*) FROM d WHERE change = 'added') AS added, (SELECT count(*) FROM d WHERE change = 'changed') AS changed, (SELECT count(*) FROM d WHERE change = 'removed') AS removed,
    (SELECT count(*) FROM (SELECT DISTINCT id, file FROM symbols) s JOIN d USING (file) WHERE change <> 'removed') AS symbols,
    (SELECT count(*) FROM (SELECT DISTINCT id, file FROM chunks) s JOIN d USING (file) WHERE change <> 'removed') AS chunks"""


@_q
def force_reindex_flag(t: Tables):
    """Per repository: nothing changed but it has no chunks or no run yet, so everything is indexed again."""
    f = t.files.select("file", F.substring_index("file", "/", 1).alias("repo_id")).distinct()
    now, before = _snapshots(t)
    changed = C.diff(now, before).select(F.substring_index("file", "/", 1).alias("repo_id")).distinct()
    return C.force_reindex(f.select("repo_id").distinct(), changed, t.index_runs.select("repo_id").distinct(), t.chunks.select("repo_id").distinct())


SQL["force_reindex_flag"] = f"""WITH {_CHANGES}, r AS (SELECT DISTINCT split_part(file, '/', 1) AS repo_id FROM files), x AS (
      SELECT repo_id, repo_id IN (SELECT split_part(file, '/', 1) FROM d) AS has_changes, repo_id NOT IN (SELECT repo_id FROM index_runs WHERE repo_id IS NOT NULL) AS first_run,
             repo_id NOT IN (SELECT repo_id FROM chunks WHERE repo_id IS NOT NULL) AS no_chunks FROM r)
    SELECT *, NOT has_changes AND (first_run OR no_chunks) AS force FROM x"""


@_q
def upsert_latest(t: Tables):
    """The file table after an upsert of a later snapshot: the later row of a file wins."""
    now, before = _snapshots(t)
    return C.upsert(before.withColumn("seq", F.lit(1)), now.withColumn("seq", F.lit(2)), ["file"], [F.desc("seq"), F.col("sha")]).select("file", "sha", "seq")


SQL["upsert_latest"] = f"WITH {_CHANGES} SELECT file, sha, 2 AS seq FROM f UNION ALL SELECT file, sha, 1 FROM p WHERE file NOT IN (SELECT file FROM f)"


@_q
def cascade_delete(t: Tables):
    """Symbols and edges left after the symbols of the test files are deleted, edges at both ends."""
    gone = G.one_file(t.files).filter("is_test").select("file")
    symbols, edges = C.delete_files(G.placed_symbols(t.symbols), G.distinct_edges(t.edges), gone)
    left = edges.select(F.concat(F.lit("edge "), "edge_type").alias("what")).unionByName(symbols.select(F.concat(F.lit("symbol "), F.coalesce(F.lower("kind"), F.lit(""))).alias("what")))
    return left.groupBy("what").agg(F.count(F.lit(1)).alias("n"))


SQL["cascade_delete"] = f"""WITH {_SYM}, k AS (SELECT id, kind FROM s WHERE file IS NULL OR file NOT IN (SELECT file FROM f WHERE is_test))
    SELECT 'edge ' || edge_type AS what, count(*) AS n FROM e WHERE caller_symbol_id IN (SELECT id FROM k) AND callee_symbol_id IN (SELECT id FROM k) GROUP BY 1
    UNION ALL SELECT 'symbol ' || coalesce(lower(kind), ''), count(*) FROM k GROUP BY 1"""


@_q
def runs_stale_reap(t: Tables):
    """Running runs without a heartbeat since a cutoff are completed with a note (0 and null are unset)."""
    r = t.index_runs.select("run_id", F.lower(F.trim("status")).alias("status"), "started_at", "last_heartbeat_at", "finished_at").distinct()
    return C.reap(r, 1770000000000, 1765000000000).select("run_id", "status", "finished_at", "note")


SQL["runs_stale_reap"] = """WITH r AS (SELECT DISTINCT run_id, lower(trim(status)) AS status, finished_at, coalesce(nullif(last_heartbeat_at, 0), started_at) AS seen FROM index_runs)
    SELECT run_id, CASE WHEN status = 'running' AND seen < 1765000000000 THEN 'completed' ELSE status END AS status,
      CASE WHEN status = 'running' AND seen < 1765000000000 THEN 1770000000000 ELSE finished_at END AS finished_at,
      CASE WHEN status = 'running' AND seen < 1765000000000 THEN 'no heartbeat' ELSE '' END AS note FROM r"""


@_q
def run_upsert(t: Tables):
    """Run table after restarts: a restarted run drops its end, schedule and metrics and keeps its stable flag and iteration."""
    r = t.index_runs.select("run_id", F.lower(F.trim("status")).alias("status"), "finished_at", "stable", "current_iteration", "first_wave_metrics").distinct()
    starts = r.filter("status = 'failed'").select("run_id", F.lit(1770000000000).alias("started_at"))
    return C.restart(r, starts)


SQL["run_upsert"] = """SELECT DISTINCT run_id, CASE WHEN lower(trim(status)) = 'failed' THEN 'running' ELSE lower(trim(status)) END AS status,
      CASE WHEN lower(trim(status)) <> 'failed' THEN finished_at END AS finished_at, stable, current_iteration, CASE WHEN lower(trim(status)) <> 'failed' THEN first_wave_metrics END AS first_wave_metrics FROM index_runs"""


@_q
def first_wave_metrics(t: Tables):
    """Metrics of the first wave, parsed out of JSON, with their share."""
    m = F.from_json("first_wave_metrics", "total int, passed int")
    return t.index_runs.select("run_id", m.alias("m")).distinct().filter("m is not null").select("run_id", "m.total", "m.passed", F.when(F.col("m.total") > 0, F.round(F.col("m.passed") / F.col("m.total"), 6)).alias("share"))


SQL["first_wave_metrics"] = """WITH m AS (SELECT DISTINCT run_id, first_wave_metrics AS j FROM index_runs WHERE json_valid(first_wave_metrics))
    SELECT run_id, CAST(j->>'$.total' AS INT) AS total, CAST(j->>'$.passed' AS INT) AS passed, CASE WHEN CAST(j->>'$.total' AS INT) > 0 THEN round(CAST(j->>'$.passed' AS INT) / CAST(j->>'$.total' AS INT), 6) END AS share FROM m"""

# ---- configurations, projects, jobs, sessions: on the order tables, which have the same shapes
# (part = configuration, lineitem = revision of a part, customer = project, nation = tenant, orders = job)


@_q
def latest_revision(t: Tables):
    """Latest revision of each configuration, 0 where there is none."""
    rev = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("version"))
    return t.part.select("p_partkey", "p_name").join(rev, "p_partkey", "left").groupBy("p_partkey", "p_name").agg(F.coalesce(F.max("version"), F.lit(0)).alias("latest"))


SQL["latest_revision"] = "SELECT p_partkey, p_name, coalesce(max(l_orderkey), 0) AS latest FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2"


@_q
def effective_revision(t: Tables):
    """Revision a configuration runs with: the pinned one, else the latest."""
    rev = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("version"), "l_linenumber")
    top = R.latest(rev, ["p_partkey"], [F.desc("version"), F.col("l_linenumber")]).select("p_partkey", "version")
    pinned = F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("long"))
    return t.part.join(top, "p_partkey", "left").select("p_partkey", F.coalesce(pinned, "version").alias("revision"))


SQL["effective_revision"] = "SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN p_size::BIGINT END, max(l_orderkey)) AS revision FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size"


@_q
def next_revision(t: Tables):
    """Version the next revision of each configuration gets."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_orderkey") + 1).alias("next_version"))


SQL["next_revision"] = "SELECT l_partkey AS p_partkey, max(l_orderkey) + 1 AS next_version FROM lineitem GROUP BY 1"


@_q
def jobs_left_join(t: Tables):
    """Jobs of a state and time range with their project, latest first, one page."""
    o = t.orders.filter("o_orderstatus = 'F' and o_orderdate >= timestamp_ntz '1993-01-01 00:00:00'")
    j = o.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("project")), "o_custkey", "left")
    return R.page(j.select("o_orderkey", "o_orderdate", "project"), [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 20)


SQL["jobs_left_join"] = """SELECT o_orderkey, o_orderdate, c_name AS project FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1993-01-01'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 20"""


@_q
def tenant_quota(t: Tables):
    """Tenants with their number of projects and whether a quota is reached."""
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("projects"))
    return t.nation.join(n, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("projects", F.lit(0)).alias("projects"), (F.coalesce("projects", F.lit(0)) >= 60).alias("full"))


SQL["tenant_quota"] = "SELECT n_nationkey, n_name, count(c_custkey) AS projects, count(c_custkey) >= 60 AS \"full\" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2"


@_q
def active_projects(t: Tables):
    """Projects with an open job."""
    return t.customer.join(t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


SQL["active_projects"] = "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')"


@_q
def sessions_of_project(t: Tables):
    """Sessions that belong to a project themselves or through their run."""
    runs = t.orders.filter("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey")).distinct().withColumn("by_run", F.lit(True))
    s = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(runs, "l_orderkey", "left")
    return s.filter((F.col("l_suppkey") == 7) | F.coalesce("by_run", F.lit(False))).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("sessions"))


SQL["sessions_of_project"] = "SELECT l_suppkey, count(*) AS sessions FROM lineitem WHERE l_suppkey = 7 OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0) GROUP BY 1"


@_q
def sessions_latest_outcomes(t: Tables):
    """Outcomes of the newest run of each repository: its audit entries by step."""
    runs = t.index_runs.select("run_id", "repo_id", "started_at").distinct().filter("repo_id is not null")
    newest = R.latest(runs, ["repo_id"], [F.desc("started_at"), F.col("run_id")])
    return newest.join(t.audit_log.dropDuplicates(["id"]), "run_id").groupBy("repo_id", "run_id", "step").agg(F.count(F.lit(1)).alias("entries"))


SQL["sessions_latest_outcomes"] = """WITH r AS (SELECT DISTINCT run_id, repo_id, started_at FROM index_runs WHERE repo_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC NULLS LAST, run_id) = 1)
    SELECT repo_id, run_id, step, count(*) AS entries FROM r JOIN (SELECT DISTINCT id, run_id, step FROM audit_log) a USING (run_id) GROUP BY 1, 2, 3"""


@_q
def attempts_list(t: Tables):
    """Attempts of runs, unknown runs told apart from missing ones (null-safe comparison)."""
    known = t.index_runs.select("run_id").distinct().withColumn("known", F.lit(True))
    a = t.audit_log.dropDuplicates(["id"]).select("id", "run_id")
    return a.join(known, "run_id", "left").groupBy(F.when(F.col("run_id").isNull(), "missing").when(F.col("known").isNull(), "unknown").otherwise("known").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


SQL["attempts_list"] = """SELECT CASE WHEN run_id IS NULL THEN 'missing' WHEN run_id NOT IN (SELECT run_id FROM index_runs WHERE run_id IS NOT NULL) THEN 'unknown' ELSE 'known' END AS run,
      count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT DISTINCT id, run_id FROM audit_log) GROUP BY 1"""


@_q
def queue_head(t: Tables):
    """The oldest pending job of each project that is due: what a claim would take (locking stays with the host)."""
    due = t.orders.filter("o_orderstatus = 'P' and o_orderdate <= timestamp_ntz '1997-01-01 00:00:00'")
    return R.latest(due, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


SQL["queue_head"] = "SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"


@_q
def tenants_page(t: Tables):
    """Projects of a tenant region, one page, by balance."""
    n = t.nation.join(t.region.filter("r_regionkey = 1").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    return R.page(t.customer.join(n, "c_nationkey", "left_semi").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 500, 10)


SQL["tenants_page"] = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey = 1)) ORDER BY c_acctbal DESC, c_custkey LIMIT 200 OFFSET 10"
