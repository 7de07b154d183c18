"""Manifests, gists, summaries, batches, revisions, exports, times and further gap lists."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from srcquarry.functions import paths as P, text as X
from srcquarry.operators import changes as C, graph as G, ranking as K, rows as R, summaries as S
from srcquarry.plans.base import Tables, query
from srcquarry.plans.joins import _SYM, SQL as JOINS

QUERIES: dict = {}
SQL: dict[str, str] = {}
_q = query(QUERIES)


@_q
def route_manifest(t: Tables):
    """Modules and interfaces of each file as a list of names within a budget, with the number left out."""
    s = G.placed_symbols(t.symbols).filter("upper(kind) in ('MODULE', 'INTERFACE', 'FUNCTION') and file is not null and fq_name is not null").select("file", "fq_name")
    return S.manifest(s, "file", "fq_name", 128)


SQL["route_manifest"] = f"""WITH {_SYM}, x AS (SELECT file, fq_name, sum(length(fq_name) + 3) OVER (PARTITION BY file ORDER BY fq_name ROWS UNBOUNDED PRECEDING) AS z FROM s WHERE upper(kind) IN ('MODULE', 'INTERFACE', 'FUNCTION') AND file IS NOT NULL AND fq_name IS NOT NULL)
    SELECT file, count(*) FILTER (z <= 128) AS listed, count(*) FILTER (z > 128) AS omitted, coalesce(string_agg('- ' || fq_name, chr(10) ORDER BY fq_name) FILTER (z <= 128), '') AS body FROM x GROUP BY 1"""


@_q
def error_gist(t: Tables):
    """Long documents as head and tail, with the first line that states an error."""
    d = t.documents.filter("text is not null").select("doc_id", "text").distinct()
    return d.select("doc_id", F.md5(S.gist("text", 300, 100).cast("binary")).alias("digest"), F.length(S.gist("text", 300, 100)).cast("long").alias("size"), F.length(S.first_error("text")).cast("long").alias("error_size"))


SQL["error_gist"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, text AS s FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, s, CASE WHEN length(s) > 300 AND length(s) - 100 <= 300 THEN substr(s, 1, 300) || chr(10) || chr(10) || '[cut]' || chr(10)
              WHEN length(s) > 300 THEN substr(s, 1, 300) || chr(10) || chr(10) || '[... cut ...]' || chr(10) || chr(10) || substr(s, length(s) - 99) ELSE s END AS g FROM d),
    e AS (SELECT doc_id, g, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '(?i)\[error\]|error:|failed|failure|exception|cannot find|symbol not found|undefined|assertionerror|expected.*but got'))[1] AS l FROM g)
    SELECT doc_id, md5(g) AS digest, length(g) AS size, length(coalesce(CASE WHEN length(l) > 200 THEN substr(l, 1, 200) || '...' ELSE l END, '')) AS error_size FROM e"""


@_q
def extractive_summary(t: Tables):
    """Headings, list lines and first lines of each document within 400 code points."""
    d = t.documents.filter("text is not null").select("doc_id", "text").distinct()
    return S.extract(d, "doc_id", "text", 400).select("doc_id", F.length("summary").cast("long").alias("size"))


SQL["extractive_summary"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM d),
    y AS (SELECT *, NOT regexp_matches(ltrim(line, ' '), '^[#*-]') AS plain, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS z FROM x WHERE trim(line, ' ') <> ''),
    k AS (SELECT *, sum((plain AND z > 133)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM y WHERE z <= 400),
    s AS (SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY n), ' ') AS summary FROM k WHERE coalesce(done, 0) = 0 GROUP BY 1)
    SELECT d.doc_id, length(coalesce(summary, '')) AS size FROM d LEFT JOIN s USING (doc_id)"""


@_q
def narrative_split(t: Tables):
    """Documents before the first of two headings, and whether they have one."""
    d = t.documents.filter("text is not null").select("doc_id", "text").distinct()
    part = S.narrative("text", "<!-- appendix -->", ["## ", "# "])
    return d.select("doc_id", F.length(part).cast("long").alias("size"), (F.contains("text", F.lit("\n## ")) | F.contains("text", F.lit("\n# "))).alias("had_appendix"))


SQL["narrative_split"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, text AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT *, least(nullif(strpos(s, chr(10) || '## '), 0), nullif(strpos(s, chr(10) || '# '), 0)) AS k FROM d)
    SELECT doc_id, length(regexp_replace(CASE WHEN k IS NOT NULL THEN substr(s, 1, k - 1) ELSE s END, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS size, k IS NOT NULL AS had_appendix FROM p"""


@_q
def earliest_hit(t: Tables):
    """First word of a module name that each document has."""
    names = t.files.select(F.explode(F.split("module", "-")).alias("name")).filter("name <> ''").distinct()
    d = t.documents.filter("text is not null").select("doc_id", "text").distinct()
    return S.earliest(d, "doc_id", "text", names, "name")


SQL["earliest_hit"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[A-Za-z0-9_./-]+') AS l FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS p FROM d), n AS (SELECT DISTINCT unnest(string_split(module, '-')) AS name FROM files)
    SELECT doc_id, arg_min(name, p) AS name, CAST(min(p) AS INT) AS position FROM x JOIN n USING (name) WHERE name <> '' GROUP BY 1"""


@_q
def dependency_rank(t: Tables):
    """Dependency files of each symbol, those a test reaches first, then by path; ten at most."""
    s = G.placed_symbols(t.symbols).select("id", "file").filter("file is not null")
    e = G.distinct_edges(t.edges)
    hit = e.filter("edge_type = 'TESTS_SOURCE'").select(F.col("callee_symbol_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    d = e.join(s.join(hit, "id", "left").select(F.col("id").alias("callee_symbol_id"), "file", F.coalesce("hit", F.lit(0)).alias("hit")), "callee_symbol_id")
    d = d.groupBy("caller_symbol_id", "file").agg(F.max("hit").alias("referenced"))
    return R.top_per_group(d, ["caller_symbol_id"], [F.desc("referenced"), F.col("file")], 10)


SQL["dependency_rank"] = f"""WITH {_SYM}, h AS (SELECT DISTINCT callee_symbol_id AS id FROM e WHERE edge_type = 'TESTS_SOURCE'),
    d AS (SELECT caller_symbol_id, file, max((callee_symbol_id IN (SELECT id FROM h))::INT) AS referenced FROM e JOIN s ON s.id = callee_symbol_id WHERE file IS NOT NULL GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY caller_symbol_id ORDER BY referenced DESC, file) AS INT) AS rank FROM d QUALIFY rank <= 10"""


@_q
def domain_models(t: Tables):
    """Up to eight types each chunk refers to that are types of the repository, in order of first mention."""
    c = t.chunks.select("id", "content").distinct().filter("content is not null").select("id", F.posexplode(X.body_types("content")).alias("pos", "name"))
    types = G.placed_symbols(t.symbols).filter(F.lower("kind").isin("class", "interface", "enum", "record", "struct")).select(X.simple_name("fq_name").alias("name")).distinct()
    return R.top_per_group(c.join(types, "name", "left_semi"), ["id"], [F.col("pos")], 8).select("id", "name", "rank")


SQL["domain_models"] = """WITH {sym}, k AS (SELECT DISTINCT regexp_extract(fq_name, '([^.#]*)$', 1) AS name FROM s WHERE lower(kind) IN ('class', 'interface', 'enum', 'record', 'struct')),
    c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL),
    x AS (SELECT id, list_filter(list_transform(regexp_extract_all(content, '\\b([A-Z][a-zA-Z0-9]*(?:\\.[A-Za-z0-9]+)*)\\b', 1), lambda y: split_part(y, '.', 1)), lambda y: y NOT IN ({common}) AND lower(y) NOT IN ('void','int','long','boolean','double','float','byte','short','char')) AS l FROM c),
    z AS (SELECT id, list_filter(l, lambda y, i: list_position(l, y) = i)[1:40] AS l FROM x), u AS (SELECT id, unnest(l) AS name, generate_subscripts(l, 1) AS p FROM z)
    SELECT id, name, CAST(row_number() OVER (PARTITION BY id ORDER BY p) AS INT) AS rank FROM u JOIN k USING (name) QUALIFY rank <= 8""".format(sym=_SYM, common=", ".join(f"'{x}'" for x in X.COMMON_TYPES)).replace("\\\\", "\\")


@_q
def epoch_times(t: Tables):
    """Run times out of epoch milliseconds (0 is unset): start, whole minutes to the end."""
    r = t.index_runs.select("run_id", "started_at", "finished_at").distinct()
    start = F.timestamp_millis(F.nullif("started_at", F.lit(0)))
    return r.select("run_id", F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started"), F.expr("(nullif(finished_at, 0) - nullif(started_at, 0)) div 60000").alias("minutes"))


SQL["epoch_times"] = """SELECT DISTINCT run_id, strftime(make_timestamp(nullif(started_at, 0) // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS started, (nullif(finished_at, 0) - nullif(started_at, 0)) // 60000 AS minutes FROM index_runs"""


@_q
def session_upsert(t: Tables):
    """Sessions after repeated upserts: the latest state of each run and step, its first entry kept as the start."""
    a = t.audit_log.dropDuplicates(["id"]).filter("run_id is not null")
    return a.groupBy("run_id", "step").agg(F.min_by("logged_at", "id").alias("started"), F.max_by(F.lower("log_level"), "id").alias("state"), F.max("id").alias("last_id"))


SQL["session_upsert"] = "SELECT run_id, step, arg_min(logged_at, id) AS started, arg_max(lower(log_level), id) AS state, max(id) AS last_id FROM audit_log WHERE run_id IS NOT NULL GROUP BY 1, 2"


@_q
def insert_idempotent(t: Tables):
    """Edges after inserting derived ones that may exist: every triple once."""
    e = G.distinct_edges(t.edges)
    new = G.tests_source(t.edges, t.symbols, t.files).withColumn("edge_type", F.lit("TESTS_SOURCE"))
    return C.insert_ignore(e, new, ["caller_symbol_id", "callee_symbol_id", "edge_type"]).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


SQL["insert_idempotent"] = """WITH x AS (SELECT DISTINCT caller_symbol_id, callee_symbol_id, upper(trim(edge_type)) AS edge_type FROM edges WHERE caller_symbol_id IS NOT NULL AND callee_symbol_id IS NOT NULL UNION SELECT *, 'TESTS_SOURCE' FROM ({tests}))
    SELECT edge_type, count(*) AS n FROM x GROUP BY 1""".format(tests=JOINS["tests_source_edges"])


@_q
def e2e_gaps(t: Tables):
    """End-to-end gaps: page objects and specs that nothing targets; here functions of test files, by inbound edges of two or more."""
    s = G.placed_symbols(t.symbols).join(G.one_file(t.files).filter("is_test"), "file").filter("upper(kind) = 'FUNCTION' or lower(kind) = 'method'")
    n = F.coalesce("in_degree", F.lit(0))
    g = s.join(G.in_degree(t.edges), "id", "left").select("id", "file", F.when(n >= 2, "low_coverage_central").otherwise("no_tests").alias("kind"), F.when(n >= 2, n).otherwise(F.lit(0)).cast("long").alias("priority"))
    return K.ranked_gaps(g, 25, 2)


SQL["e2e_gaps"] = f"""WITH {_SYM}, d AS (SELECT callee_symbol_id AS id, count(*) AS n FROM e WHERE edge_type <> 'TESTS_SOURCE' GROUP BY 1),
    g AS (SELECT s.id, s.file, CASE WHEN coalesce(n, 0) >= 2 THEN 'low_coverage_central' ELSE 'no_tests' END AS kind, CAST(CASE WHEN coalesce(n, 0) >= 2 THEN n ELSE 0 END AS BIGINT) AS priority
          FROM s JOIN f USING (file) LEFT JOIN d ON d.id = s.id WHERE is_test AND (upper(kind) = 'FUNCTION' OR lower(kind) = 'method'))
    SELECT id, file, kind, priority FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY priority DESC, id) AS r FROM g) WHERE r <= 2 ORDER BY priority DESC, id LIMIT 25"""


@_q
def provider_score(t: Tables):
    """Best provider for each test: a file whose name ends with the same word, by shared directories, then path."""
    word = lambda c: F.regexp_extract(F.regexp_replace(c, r"(Tests?|IT)?\.java$", ""), r"([A-Z][a-z]+)$", 1)
    f = t.files.filter(F.col("file").endswith(".java")).select("file", word(F.col("file")).alias("word"), F.split("file", "/").alias("dirs")).distinct().filter("word <> ''")
    is_test = F.col("file").rlike(r"(Tests?|IT)\.java$")
    want = f.filter(is_test).select(F.col("file").alias("test_file"), "word", F.substring_index("file", "/", 1).alias("repo"), F.col("dirs").alias("own"))
    j = want.join(f.filter(~is_test).withColumn("repo", F.substring_index("file", "/", 1)), ["word", "repo"])
    shared = F.size(F.filter(F.zip_with("own", "dirs", lambda a, b: a == b), lambda x: x))
    return R.latest(j.withColumn("score", F.lit(100) + shared), ["test_file"], [F.desc("score"), F.col("file")]).select("test_file", "file", "score")


SQL["provider_score"] = r"""
    WITH f AS (SELECT DISTINCT file, regexp_extract(regexp_replace(file, '(Tests?|IT)?\.java$', ''), '([A-Z][a-z]+)$', 1) AS word, split_part(file, '/', 1) AS repo, string_split(file, '/') AS dirs,
            regexp_matches(file, '(Tests?|IT)\.java$') AS is_test FROM files WHERE ends_with(file, '.java')),
    j AS (SELECT w.file AS test_file, f.file, 100 + len(list_filter(list_zip(w.dirs, f.dirs), lambda z: z[1] = z[2])) AS score FROM f w JOIN f ON f.word = w.word AND f.repo = w.repo WHERE w.is_test AND NOT f.is_test AND w.word <> '')
    SELECT test_file, file, CAST(score AS INT) AS score FROM j QUALIFY row_number() OVER (PARTITION BY test_file ORDER BY score DESC, file) = 1"""


@_q
def export_queue(t: Tables):
    """Exports by state and age: position in the queue of each pending one (orders stand in for exports)."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return t.orders.filter("o_orderstatus = 'P'").withColumn("position", F.row_number().over(w)).filter("position <= 5").select("o_orderkey", "o_orderpriority", "position")


SQL["export_queue"] = "SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS INT) AS position FROM orders WHERE o_orderstatus = 'P' QUALIFY position <= 5"


@_q
def pinned_revisions(t: Tables):
    """Pinned revisions that do not belong to their configuration (a constraint as an anti join)."""
    pins = t.part.select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("pinned")).filter("p_partkey % 5 = 0")
    rev = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("pinned"))
    return pins.join(rev, ["p_partkey", "pinned"], "left_anti")


SQL["pinned_revisions"] = "SELECT p_partkey, p_partkey % 100 + 1 AS pinned FROM part WHERE p_partkey % 5 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_orderkey = p_partkey % 100 + 1)"


@_q
def java_e2e_kinds(t: Tables):
    """End-to-end kinds of Java sources by path and markers."""
    s = t.sources.filter(F.col("file").endswith(".java") & F.col("content").isNotNull())
    low = F.lower("file")
    spec = low.rlike(r"(^|/)(e2e|it)/|it\.java$|e2e") | F.col("content").rlike("playwright|selenium")
    page, flow = F.contains("content", F.lit("@FindBy")), F.col("content").rlike("io\\.restassured|RestAssured") & F.col("content").rlike("given\\(")
    return s.select("file", F.array_join(F.array_compact(F.array(F.when(spec, "E2E_SPEC"), F.when(page, "PAGE_OBJECT"), F.when(flow, "USER_FLOW"))), ",").alias("kinds")).filter("kinds <> ''")


SQL["java_e2e_kinds"] = r"""SELECT file, concat_ws(',', CASE WHEN a THEN 'E2E_SPEC' END, CASE WHEN b THEN 'PAGE_OBJECT' END, CASE WHEN c THEN 'USER_FLOW' END) AS kinds FROM (
      SELECT file, regexp_matches(lower(file), '(^|/)(e2e|it)/|it\.java$|e2e') OR regexp_matches(content, 'playwright|selenium') AS a, contains(content, '@FindBy') AS b,
        regexp_matches(content, 'io\.restassured|RestAssured') AND regexp_matches(content, 'given\(') AS c FROM sources WHERE ends_with(file, '.java') AND content IS NOT NULL) WHERE a OR b OR c"""


@_q
def java_outline(t: Tables):
    """Types and methods of Java sources by line patterns (the fallback parser)."""
    from srcquarry.sources.scan import java_outline as outline

    return outline(t.sources.filter(F.col("file").endswith(".java") & F.col("content").isNotNull()))


@_q
def event_windows(t: Tables):
    """Events by five-minute window and type (batch form of the streaming aggregate)."""
    w = F.window("ts", "5 minutes")
    g = t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


SQL["event_windows"] = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@_q
def silent_sessions(t: Tables):
    """Sessions of events per user: a gap of an hour ends one (batch form of the heartbeat sessions)."""
    g = t.events.groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("beats"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "beats")


SQL["silent_sessions"] = """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m) SELECT user_id, min(ts) AS start, count(*) AS beats FROM g GROUP BY user_id, g"""


@_q
def content_languages(t: Tables):
    """Scanned sources whose language by extension differs from the one of the file table."""
    f = t.files.select("file", F.lower(F.trim("lang")).alias("lang")).distinct()
    return f.withColumn("by_extension", P.language("file")).filter(~F.col("lang").eqNullSafe(F.col("by_extension"))).groupBy("lang", "by_extension").agg(F.count(F.lit(1)).alias("n"))


SQL["content_languages"] = r"""SELECT lang, x AS by_extension, count(*) AS n FROM (SELECT DISTINCT file, lower(trim(lang)) AS lang, CASE regexp_extract(lower(file), '(\.[^./]*)$', 1) WHEN '.java' THEN 'java' WHEN '.cs' THEN 'csharp' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript'
      WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' WHEN '.html' THEN 'html' END AS x FROM files) WHERE lang IS DISTINCT FROM x GROUP BY 1, 2"""
