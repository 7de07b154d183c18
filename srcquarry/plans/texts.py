"""Text, chunk, path and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcquarry.functions import logs as L, paths as P, python as Y, text as X
from srcquarry.operators import graph as G, rows as R
from srcquarry.plans.base import Tables, query
from srcquarry.runtime import spread
from srcquarry.plans.lookups import SQL as LOOKUPS

QUERIES: dict = {}
SQL: dict[str, str] = {}
_q = query(QUERIES)


@_q
def approx_tokens(t: Tables):
    """Tokens of each chunk by the characters per token of its language."""
    lim = t.chunk_limits.groupBy("lang").agg(F.max("chars_per_token").alias("cpt"))
    size = t.chunks.select("id", "lang", "content").join(lim, "lang", "left").select("id", X.approx_tokens("content", F.coalesce("cpt", F.lit(0))).alias("tokens"))
    return size.distinct()


SQL["approx_tokens"] = """SELECT DISTINCT c.id, CAST(ceil(length(content) / (CASE WHEN chars_per_token > 0 THEN chars_per_token ELSE 4 END)::DOUBLE) AS BIGINT) AS tokens FROM chunks c LEFT JOIN chunk_limits l ON l.lang = c.lang"""


@_q
def chunk_lines(t: Tables):
    """Code of each method by its lines in the source (line ranges clamped to the file)."""
    m = t.class_records.select(P.normal("file_path").alias("file"), F.explode("methods").alias("m")).select("file", F.col("m.fq_name").alias("fq_name"), F.col("m.start_line").alias("start_line"), F.col("m.end_line").alias("end_line")).distinct()
    s = t.sources.filter("content is not null").select("file", "content")
    code = X.line_range("content", "start_line", "end_line")
    return m.join(s, "file").select("file", "fq_name", "start_line", "end_line", F.length(code).cast("long").alias("code_points"), F.sha1(code.cast("binary")).alias("digest"))


SQL["chunk_lines"] = r"""
    WITH m AS (SELECT DISTINCT file, m.fq_name, m.start_line, m.end_line FROM (SELECT regexp_replace(replace(trim(file_path), '\', '/'), '^(\./|/)+', '') AS file, unnest(methods) AS m FROM class_records)),
    x AS (SELECT m.*, CASE WHEN least(end_line, len(l)) >= greatest(start_line, 1) THEN array_to_string(l[greatest(start_line, 1):least(end_line, len(l))], chr(10)) ELSE '' END AS code
          FROM m JOIN (SELECT file, string_split(content, chr(10)) AS l FROM sources WHERE content IS NOT NULL) s ON s.file = m.file)
    SELECT file, fq_name, start_line, end_line, length(code) AS code_points, sha1(code) AS digest FROM x"""


@_q
def symbol_boundary_pieces(t: Tables):
    """Line ranges of the pieces of each symbol: one per symbol, or blocks of fixed height above the token limit."""
    s = G.placed_symbols(t.symbols).filter("end_line >= start_line").select("id", "start_line", "end_line")
    step = 40
    starts = F.sequence(F.col("start_line"), F.col("end_line"), F.lit(step))
    p = s.select("id", "end_line", F.posexplode(starts).alias("piece", "first_line"))
    return p.select("id", "piece", "first_line", F.least(F.col("first_line") + step - 1, "end_line").alias("last_line"))


SQL["symbol_boundary_pieces"] = """WITH s AS (SELECT id, min(start_line) AS a, min(end_line) AS b FROM symbols GROUP BY id)
    SELECT id, CAST(i AS INT) AS piece, CAST(a + 40 * i AS INT) AS first_line, CAST(least(a + 40 * i + 39, b) AS INT) AS last_line FROM s, range(0, 100000) r(i) WHERE b >= a AND a + 40 * i <= b"""


@_q
def chunk_kind_map(t: Tables):
    """Chunk type each symbol gets by its kind, tests apart."""
    s = G.placed_symbols(t.symbols).join(G.one_file(t.files), "file")
    return s.groupBy("kind", X.chunk_type("kind", "is_test").alias("chunk_type")).agg(F.count(F.lit(1)).alias("n"))


SQL["chunk_kind_map"] = """WITH s AS (SELECT id, min(kind) AS kind, min(file) AS file FROM symbols GROUP BY id), f AS (SELECT file, max(is_test) AS is_test FROM files GROUP BY file)
    SELECT kind, CASE WHEN is_test THEN 'test' WHEN lower(trim(kind)) IN ('api_route', 'page_route') THEN 'route' WHEN lower(trim(kind)) = 'user_flow' THEN 'flow' WHEN lower(trim(kind)) IN ('e2e_spec', 'page_object') THEN 'e2e_pattern'
      WHEN lower(trim(kind)) IN ('form', 'test_selector', 'ui_test_hook', 'static_template') THEN 'page' WHEN lower(trim(kind)) = 'api_client_request' THEN 'api_contract' ELSE 'definition' END AS chunk_type, count(*) AS n FROM s JOIN f USING (file) GROUP BY 1, 2"""


@_q
def chunk_headers(t: Tables):
    """Header line of the chunk of each symbol, at most 160 code points."""
    s = G.placed_symbols(t.symbols).filter("fq_name is not null and file is not null")
    head = F.concat(F.lit("[symbol_kind="), F.lower(F.coalesce("kind", F.lit(""))), F.lit(" fq_name="), "fq_name", F.lit(" file="), F.regexp_extract("file", "([^/]*)$", 1), F.lit(" type="), F.coalesce(F.get_json_object("signature_json", "$.type"), F.lit("")), F.lit("]"))
    return s.select("id", X.truncate(head, 160).alias("header"))


SQL["chunk_headers"] = """WITH s AS (SELECT id, min(kind) AS kind, min(fq_name) AS fq_name, min(file) AS file, min(signature_json) AS signature_json FROM symbols GROUP BY id),
    h AS (SELECT id, '[symbol_kind=' || lower(coalesce(kind, '')) || ' fq_name=' || fq_name || ' file=' || regexp_extract(file, '([^/]*)$', 1) || ' type=' || coalesce(CASE WHEN json_valid(signature_json) THEN json_extract_string(signature_json, '$.type') END, '') || ']' AS h FROM s WHERE fq_name IS NOT NULL AND file IS NOT NULL)
    SELECT id, CASE WHEN length(h) > 160 THEN substr(h, 1, 160) || '…' ELSE h END AS header FROM h"""


@_q
def chunk_metadata_json(t: Tables):
    """Metadata of each symbol as JSON text, fields without a value left out."""
    s = G.placed_symbols(t.symbols)
    vis = F.get_json_object("signature_json", "$.visibility")
    return s.select("id", F.to_json(F.struct(F.lower("kind").alias("symbol_kind"), vis.alias("visibility"), F.when(vis == "public", F.lit(True)).alias("exported"))).alias("metadata"))


SQL["chunk_metadata_json"] = """WITH s AS (SELECT id, min(kind) AS kind, min(signature_json) AS j FROM symbols GROUP BY id), v AS (SELECT id, lower(kind) AS k, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.visibility') END AS v FROM s)
    SELECT id, '{' || concat_ws(',', CASE WHEN k IS NOT NULL THEN '"symbol_kind":"' || k || '"' END, CASE WHEN v IS NOT NULL THEN '"visibility":"' || v || '"' END, CASE WHEN v = 'public' THEN '"exported":true' END) || '}' AS metadata FROM v"""


@_q
def parent_map(t: Tables):
    """Parent of each symbol: the smallest one that contains it."""
    e = G.distinct_edges(t.edges).filter("edge_type = 'CONTAINS'")
    return e.groupBy("callee_symbol_id").agg(F.min("caller_symbol_id").alias("parent_id"))


SQL["parent_map"] = "SELECT callee_symbol_id, min(caller_symbol_id) AS parent_id FROM edges WHERE upper(trim(edge_type)) = 'CONTAINS' AND caller_symbol_id IS NOT NULL AND callee_symbol_id IS NOT NULL GROUP BY 1"


@_q
def sanitize_comments(t: Tables):
    """Digest of each chunk without block comments and with long comment lines cut."""
    return spread(t.chunks.select("id", "content")).select("id", F.md5(X.sanitize("content", True, 80).cast("binary")).alias("digest")).distinct()


SQL["sanitize_comments"] = r"""
    WITH c AS (SELECT DISTINCT id, content FROM chunks), b AS (SELECT id, regexp_replace(regexp_replace(content, '/\*.*?\*/', '', 'gs'), '/\*.*(.)$', '\1', 's') AS s FROM c),
    l AS (SELECT id, array_to_string(list_transform(string_split(s, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\s*//') AND length(x) > 80 THEN substr(x, 1, 80) || '…' ELSE x END), chr(10)) AS s FROM b)
    SELECT id, CASE WHEN s IS NOT NULL THEN md5(regexp_replace(replace(s, chr(0), ''), '^\s+|\s+$', '', 'g')) END AS digest FROM l"""


@_q
def embedding_inputs(t: Tables):
    """Lengths of the embedding inputs of documents: trimmed, a space if empty, at most 30,000 code points."""
    x = X.embedding_input("text")
    return t.documents.filter("text is not null").select("doc_id", F.length(x).cast("long").alias("size"), F.md5(x.cast("binary")).alias("digest")).distinct()


SQL["embedding_inputs"] = r"""WITH d AS (SELECT DISTINCT doc_id, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, CASE WHEN s = '' THEN ' ' ELSE substr(s, 1, 30000) END AS s FROM d)
    SELECT doc_id, length(s) AS size, md5(s) AS digest FROM e"""


@_q
def name_helpers(t: Tables):
    """Class, member, simple and module names out of full names, signatures and paths."""
    m = t.class_records.select(P.normal("file_path").alias("path"), F.explode("methods").alias("m")).select("path", F.col("m.fq_name").alias("fq"), F.col("m.signature").alias("sig")).distinct()
    return m.select("fq", "sig", X.class_of("fq").alias("class_name"), X.simple_name("fq").alias("simple"), X.module_of_path("path").alias("module"), X.is_collaborator(F.lit("class"), F.regexp_replace("fq", "#.*$", "")).alias("collaborator"))


SQL["name_helpers"] = r"""
    WITH m AS (SELECT DISTINCT path, m.fq_name AS fq, m.signature AS sig FROM (SELECT regexp_replace(replace(trim(file_path), '\', '/'), '^(\./|/)+', '') AS path, unnest(methods) AS m FROM class_records))
    SELECT fq, sig, CASE WHEN strpos(fq, '#') > 1 THEN split_part(fq, '#', 1) END AS class_name, regexp_extract(fq, '([^.#]*)$', 1) AS simple,
      array_to_string(list_filter(string_split(regexp_replace(path, '\.[^./]*$', ''), '/'), lambda x: x NOT IN ('', '.', '..')), '.') AS module,
      regexp_matches(regexp_extract(regexp_replace(fq, '#.*$', ''), '([^.#]*)$', 1), '(Service|Repository|Client|Dao|Gateway|Provider|Mapper|Manager|Factory|Handler|Producer|Consumer|Publisher|Listener|Store|Engine|Validator|Resolver|Adapter|Facade|Strategy|Broker|Dispatcher|Scheduler)$') AS collaborator FROM m"""


@_q
def path_mapping(t: Tables):
    """Suggested test path of each source, and the sources of test files that exist."""
    f = G.one_file(t.files).select("file", "is_test")
    tests = f.filter("is_test").select(F.col("file").alias("test_file"), F.posexplode(P.source_candidates("file")).alias("pos", "file"))
    hit = R.latest(tests.join(f.filter("not is_test").select("file"), "file", "left_semi"), ["test_file"], [F.col("pos")]).select(F.col("test_file").alias("file"), F.col("file").alias("other"), F.lit("source").alias("what"))
    want = f.filter("not is_test").select("file", P.suggested_test("file").alias("other"), F.lit("test").alias("what"))
    return hit.unionByName(want)


SQL["path_mapping"] = r"""
    WITH f AS (SELECT file, max(is_test) AS is_test FROM files GROUP BY file),
    t AS (SELECT file AS test_file, regexp_extract(lower(file), '(\.[^./]*)$', 1) AS ext, file AS p FROM f WHERE is_test),
    c AS (SELECT test_file, CASE WHEN ext = '.java' THEN [regexp_replace(regexp_replace(p, 'src/(test|it)/java/', 'src/main/java/', 'g'), '(Tests|Test|IT)\.java$', '.java')]
            WHEN ext = '.cs' THEN [regexp_replace(regexp_replace(p, '\.?(Tests|Test|IntegrationTests)/', '/', 'g'), 'Tests?\.cs$', '.cs'), regexp_replace(p, 'Tests?\.cs$', '.cs')]
            ELSE [regexp_replace(p, '\.(spec|test|cy)\.', '.', 'g'), regexp_replace(regexp_replace(p, '\.(spec|test|cy)\.', '.', 'g'), '(^|/)(__tests__|tests?)/', '\1', 'g'),
                  regexp_replace(regexp_replace(regexp_replace(p, '\.(spec|test|cy)\.', '.', 'g'), '(^|/)(__tests__|tests?)/', '\1', 'g'), '(^|/)tests?/', '\1src/', 'g')] END AS cand FROM t),
    x AS (SELECT test_file, unnest(cand) AS file, generate_subscripts(cand, 1) AS pos FROM c)
    SELECT test_file AS file, arg_min(file, pos) AS other, 'source' AS what FROM x WHERE file <> test_file AND file IN (SELECT file FROM f WHERE NOT is_test) GROUP BY 1
    UNION ALL SELECT file, CASE regexp_extract(lower(file), '(\.[^./]*)$', 1) WHEN '.java' THEN regexp_replace(regexp_replace(file, 'src/main/java/', 'src/test/java/', 'g'), '\.java$', 'Test.java')
      WHEN '.cs' THEN regexp_replace(regexp_replace(file, '^(.*?)src/', '\1tests/'), '\.cs$', 'Tests.cs') ELSE regexp_replace(file, '(\.[^./]*)$', '.test\1') END, 'test' FROM f WHERE NOT is_test"""


@_q
def html_hooks(t: Tables):
    """Test hooks of HTML sources with their line."""
    lines = t.sources.filter(F.col("file").endswith(".html") & F.col("content").isNotNull()).select("file", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    found = F.regexp_extract_all("line", F.lit(r"\b(?:data-testid|data-cy|th:data-testid|th:testid)\s*=\s*\"([^\"]+)\""), F.lit(1))
    return lines.select("file", (F.col("n") + 1).alias("line"), F.explode(found).alias("hook")).distinct()


SQL["html_hooks"] = r"""WITH s AS (SELECT file, string_split(content, chr(10)) AS l FROM sources WHERE ends_with(file, '.html') AND content IS NOT NULL), x AS (SELECT file, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM s)
    SELECT DISTINCT file, CAST(n AS INT) AS line, unnest(regexp_extract_all(line, '\b(?:data-testid|data-cy|th:data-testid|th:testid)\s*=\s*"([^"]+)"', 1)) AS hook FROM x"""


@_q
def http_paths(t: Tables):
    """Literal paths that start with a slash in the sources, joined to a prefix with single slashes."""
    s = t.sources.filter("content is not null").select("file", F.explode(F.regexp_extract_all("content", F.lit(r"\"(/[A-Za-z][A-Za-z0-9_/{}.-]*)\""), F.lit(1))).alias("path")).distinct()
    return s.select("file", "path", X.web_path(F.lit("/api/"), "path").alias("full_path"))


SQL["http_paths"] = r"""SELECT *, regexp_replace(regexp_replace('/' || '/api/' || '/' || path, '/+', '/', 'g'), '(.)/$', '\1') AS full_path
    FROM (SELECT DISTINCT file, unnest(regexp_extract_all(content, '"(/[A-Za-z][A-Za-z0-9_/{}.-]*)"', 1)) AS path FROM sources WHERE content IS NOT NULL)"""


@_q
def spring_routes(t: Tables):
    """Routes of mapping annotations of Java sources: verb and path."""
    s = t.sources.filter(F.col("file").endswith(".java") & F.col("content").isNotNull())
    both = F.lit(r"@(Get|Post|Put|Delete|Patch)Mapping\(\"([^\"]*)\"\)")
    pairs = F.arrays_zip(F.regexp_extract_all("content", both, F.lit(1)).alias("verb"), F.regexp_extract_all("content", both, F.lit(2)).alias("path"))
    r = s.select("file", F.explode(pairs).alias("r")).select("file", F.upper("r.verb").alias("verb"), X.web_path(F.lit(""), F.col("r.path")).alias("path"))
    return r.groupBy("file", "verb", "path").agg(F.count(F.lit(1)).alias("n"))


SQL["spring_routes"] = r"""WITH x AS (SELECT file, unnest(regexp_extract_all(content, '@(?:Get|Post|Put|Delete|Patch)Mapping\("[^"]*"\)')) AS a FROM sources WHERE ends_with(file, '.java') AND content IS NOT NULL)
    SELECT file, upper(regexp_extract(a, '@(Get|Post|Put|Delete|Patch)', 1)) AS verb, regexp_replace(regexp_replace('//' || regexp_extract(a, '"([^"]*)"', 1), '/+', '/', 'g'), '(.)/$', '\1') AS path, count(*) AS n FROM x GROUP BY 1, 2, 3"""


@_q
def type_tokens(t: Tables):
    """Types each chunk refers to: distinct, in order, without common ones, 40 at most."""
    return spread(t.chunks.filter("content is not null").select("id", "content")).select("id", F.array_join(X.body_types("content"), ",").alias("types")).distinct()


_COMMON = ", ".join(f"'{x}'" for x in X.COMMON_TYPES)
SQL["type_tokens"] = f"""WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL),
    x AS (SELECT id, list_filter(list_transform(regexp_extract_all(content, '\\b([A-Z][a-zA-Z0-9]*(?:\\.[A-Za-z0-9]+)*)\\b', 1), lambda y: split_part(y, '.', 1)), lambda y: y NOT IN ({_COMMON}) AND lower(y) NOT IN ('void','int','long','boolean','double','float','byte','short','char')) AS l FROM c)
    SELECT id, array_to_string(list_filter(l, lambda y, i: list_position(l, y) = i)[1:40], ',') AS types FROM x""".replace("\\\\", "\\")


_INTENTS = r"""array_to_string(list_filter([
      CASE WHEN regexp_matches(content, '(?i)(<=|>=|<|>|==)\s*(0|1|-1|max|min|length|count|size|limit|timeout)') THEN 'boundary_conditions' END,
      CASE WHEN regexp_matches(content, '\b(catch|throws?|throw)\b') THEN 'exception_path' END,
      CASE WHEN regexp_matches(content, '\bif\s*\(') AND regexp_matches(content, '\belse\b') THEN 'if_false_path' END,
      CASE WHEN regexp_matches(content, '\bif\s*\(') THEN 'if_true_path' END,
      CASE WHEN regexp_matches(content, '(?i)(==\s*null|!=\s*null|\bis\s+null\b|\bnull\b)') THEN 'null_handling' END,
      CASE WHEN regexp_matches(content, '\bswitch\s*\(') THEN 'switch_case_paths' END,
      CASE WHEN regexp_matches(content, '\bswitch\s*\(') AND (regexp_matches(content, '\bdefault\s*:') OR regexp_matches(content, '\bcase\b')) THEN 'switch_default_path' END], lambda x: x IS NOT NULL), ',')"""


@_q
def branch_intents(t: Tables):
    """Branches each chunk has."""
    return spread(t.chunks.filter("content is not null").select("id", "content")).select("id", F.array_join(X.branch_intents("content"), ",").alias("intents")).distinct()


SQL["branch_intents"] = f"SELECT DISTINCT id, {_INTENTS} AS intents FROM chunks WHERE content IS NOT NULL"


@_q
def intent_diff(t: Tables):
    """Branches of the definitions of a file that no test chunk of the file covers."""
    c = t.chunks.select("id", "file", "chunk_type", "content").distinct().filter("content is not null and file is not null")
    both = c.select("file", (F.col("chunk_type") == "test").alias("test"), F.explode(F.when(F.col("chunk_type") == "test", X.covered_intents("content")).otherwise(X.branch_intents("content"))).alias("intent")).distinct()
    covered = both.filter("test").select("file", "intent")
    return both.filter("not test").join(covered, ["file", "intent"], "left_anti").groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("intent")), ",").alias("missing"))


SQL["intent_diff"] = f"""WITH c AS (SELECT DISTINCT id, file, chunk_type = 'test' AS test, content FROM chunks WHERE content IS NOT NULL AND file IS NOT NULL),
    i AS (SELECT DISTINCT file, test, unnest(string_split({_INTENTS}, ',')) AS intent FROM c),
    x AS (SELECT file, intent FROM i WHERE test UNION SELECT file, 'error_path' FROM c WHERE test AND regexp_matches(lower(content), '(throws?|exception|error|invalid|fail|timeout|retry)')
          UNION SELECT file, 'empty_or_null_input' FROM c WHERE test AND regexp_matches(lower(content), '(empty|null|blank|whitespace|zero)'))
    SELECT file, array_to_string(list_sort(list(DISTINCT intent)), ',') AS missing FROM i WHERE NOT test AND intent <> '' AND NOT EXISTS (SELECT 1 FROM x WHERE x.file = i.file AND x.intent = i.intent) GROUP BY 1"""


@_q
def log_locations(t: Tables):
    """Places named in the logs and other documents: a log line is made for each file a document names."""
    log = F.regexp_replace("text", r"([A-Za-z0-9_/-]+\.(?:java|cs|ts|js))", "at X.run($1:12) $1:7:3 ")
    # The generator yields no row for a text without places, so that the places are found once and only they are shuffled.
    found = F.explode(F.filter(F.array(F.array_join(L.locations(log), ",")), lambda p: p != "")).alias("places")
    return spread(t.documents.filter("text is not null").select("doc_id", "text")).select("doc_id", found).distinct()


SQL["log_locations"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, regexp_replace(text, '([A-Za-z0-9_/-]+\.(?:java|cs|ts|js))', 'at X.run(\1:12) \1:7:3 ', 'g') AS log FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, list_concat(
        list_transform(regexp_extract_all(log, '\([A-Za-z0-9_./\\$-]+\.(?:java|kt|kts|scala):\d+\)'), lambda x: regexp_replace(x, '[()]', '', 'g')),
        list_transform(regexp_extract_all(log, '[A-Za-z0-9_.][A-Za-z0-9_./\\~-]*\.(?:java|kt|kts|ts|tsx|js|jsx|mjs|cjs|cs|go|scala):\d+(?::\d+)?'), lambda x: regexp_extract(x, '^(.*?\.[a-z]+:\d+)', 1))) AS l FROM d)
    SELECT doc_id, array_to_string(list_filter(l, lambda y, i: list_position(l, y) = i), ',') AS places FROM l WHERE len(l) > 0"""


@_q
def consecutive_dedupe(t: Tables):
    """Documents whose runs of more than one equal line are collapsed (lines are made by cutting the text at spaces)."""
    d = t.documents.filter("text is not null").select("doc_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("text")).distinct()
    return R.repeated_lines(d, "doc_id", "text", 1).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


SQL["consecutive_dedupe"] = """
    WITH d AS (SELECT DISTINCT doc_id, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM d),
    m AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM x), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM m),
    r AS (SELECT doc_id, min(n) AS n, any_value(line) AS line, count(*) AS c FROM g GROUP BY doc_id, g)
    SELECT doc_id, md5(string_agg(CASE WHEN c > 1 THEN line || chr(10) || '[... ' || (c - 1) || ' more identical lines]' ELSE line END, chr(10) ORDER BY n)) AS digest FROM r GROUP BY 1"""


@_q
def log_classes(t: Tables):
    """Failure classes of texts: environment, compiler diagnostics, lines with a diagnostic; over documents and the notes of runs."""
    d = spread(t.documents.filter("text is not null").select("doc_id", "text"))
    noisy = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\nERROR connection refused: jdbc:postgres 5432"))).when(F.col("doc_id") % 9 == 1, F.concat("text", F.lit("\n[ERROR] COMPILATION ERROR\ncannot find symbol\nsymbol: class a.b.Missing"))).otherwise(F.col("text"))
    tag = F.when(F.col("doc_id") % 2 == 0, "java").otherwise("ts")
    return d.select("doc_id", L.infra_class(tag, noisy).alias("infra"), L.is_compile_shaped(noisy).alias("compile_shaped"), L.diagnostic_lines(noisy).cast("long").alias("diagnostics"), F.array_join(L.missing_types(noisy), ",").alias("missing")).distinct()


SQL["log_classes"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || chr(10) || 'ERROR connection refused: jdbc:postgres 5432' WHEN doc_id % 9 = 1 THEN text || chr(10) || '[ERROR] COMPILATION ERROR' || chr(10) || 'cannot find symbol' || chr(10) || 'symbol: class a.b.Missing' ELSE text END AS t
               FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND contains(lower(t), 'connection refused') THEN 'jdbc_connection' ELSE '' END AS infra,
      regexp_matches(t, '\[ERROR\]\s+COMPILATION ERROR|cannot find symbol|no suitable method found|incompatible types|error\s+CS\d{4}\b|\bTS\d{4}\b') AS compile_shaped,
      len(list_filter(list_distinct(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'))), lambda x: x <> '' AND regexp_matches(x, '(?i)(cannot find symbol|incompatible types|cannot be resolved|assertionerror|compilation error|error|failed|exception)'))) AS diagnostics,
      array_to_string(list_transform(regexp_extract_all(t, 'symbol:\s+class\s+([\w.]+)', 1), lambda x: regexp_extract(x, '([^.]*)$', 1)), ',') AS missing FROM d"""


@_q
def low_value_test(t: Tables):
    """Test sources that say little, and those without any test."""
    s = t.sources.filter("content is not null").select("file", "content").filter(P.is_test("file"))
    return s.select("file", L.low_value_reason("file", "content").alias("low_value"), L.empty_test_reason("file", "content").alias("empty_test"))


def _low_value_sql() -> str:
    def has(text: str, phrases: list[str]) -> str:
        return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"

    cases = []
    for label, patterns, needs, lacks in L.LOW_VALUE_RULES:
        cond = "(" + " OR ".join(f"regexp_matches(s, '{p}')" for p in patterns) + ")"
        cond += f" AND {has('low', needs)}" if needs else ""
        cond += f" AND NOT {has('low', lacks)}" if lacks else ""
        cond += r" OR regexp_replace(regexp_replace(s, '/\*.*?\*/|//[^\n]*', '', 'gs'), '\s+', '', 'g') = ''" if label == L.COMMENTS_ONLY else ""
        cases.append(f"WHEN {cond} THEN '{label}'")
    shell = r"(?is)^\s*(?:using\s+[A-Za-z0-9_.]+\s*;\s*)*(?:namespace\s+[A-Za-z0-9_.]+\s*\{\s*)*(?:public\s|internal\s|private\s|protected\s|sealed\s|abstract\s|static\s|\s)*class\s+[A-Za-z0-9_]+\s*(?::[^{]+)?\{\s*\}\s*(?:\}\s*)*$"
    cases.append(f"WHEN ends_with(base, '.cs') AND NOT {has('s', L.SCAFFOLD_MARKS)} AND regexp_matches(s, '{shell}') THEN '{L.EMPTY_SCAFFOLD}'")
    cases.append(f"WHEN {has('base', L.SMOKE_NAMES)} AND {has('low', L.SMOKE_PHRASES)} THEN '{L.SMOKE_ONLY}'")
    markers = " ".join(f"WHEN regexp_matches(base, '{n}') AND NOT regexp_matches(s, '{m}') THEN '{label}'" for n, m, label in L.TEST_MARKERS)
    is_test = LOOKUPS["test_path_classifier"].split("SELECT DISTINCT file, is_test,")[1].split("AS by_path")[0]
    return rf"""WITH x AS (SELECT file, regexp_replace(content, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS s, lower(regexp_extract(file, '([^/]*)$', 1)) AS base FROM sources WHERE content IS NOT NULL AND ({is_test})),
        y AS (SELECT *, lower(s) AS low FROM x)
        SELECT file, CASE WHEN s = '' THEN '' {' '.join(cases)} ELSE '' END AS low_value, CASE WHEN s = '' THEN '' {markers} ELSE '' END AS empty_test FROM y"""


SQL["low_value_test"] = _low_value_sql()


@_q
def build_log_sanitize(t: Tables):
    """Documents as build logs: tool epilogues dropped, blank runs collapsed."""
    d = t.documents.filter("text is not null").select("doc_id", F.concat(F.regexp_replace("text", "\r", ""), F.lit("\n\n\n[ERROR] -> [Help 1]\n[ERROR]\n[ERROR] Failed to execute goal x\n[ERROR] rest\n")).alias("log")).distinct()
    out = L.sanitize_build_log(F.lit("java"), "log")
    return d.select("doc_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).cast("long").alias("size"))


SQL["build_log_sanitize"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, replace(text, chr(13), '') || chr(10) || chr(10) || chr(10) || '[ERROR] -> [Help 1]' || chr(10) || '[ERROR]' || chr(10) || '[ERROR] Failed to execute goal x' || chr(10) || '[ERROR] rest' || chr(10) AS log FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, substr(log, 1, strpos(log, '[ERROR] Failed to execute goal x') + 31) AS log FROM d),
    l AS (SELECT doc_id, list_transform(list_filter(string_split(log, chr(10)), lambda x: NOT regexp_matches(x, '^\s*\[ERROR\]\s*$') AND NOT contains(x, '[ERROR] -> [Help ')), lambda x: CASE WHEN regexp_matches(x, '^\s*$') THEN '' ELSE x END) AS l FROM c),
    o AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\n+$', '') AS s FROM l)
    SELECT doc_id, md5(s) AS digest, length(s) AS size FROM o"""


@_q
def failing_paths(t: Tables):
    """Files named by their stem in documents on lines that read like a failure."""
    lines = spread(t.documents.filter("text is not null").select("doc_id", "text")).select("doc_id", F.explode(F.split("text", r"[\n.!?]")).alias("line")).filter(F.lower("line").rlike(r"fail|error|broken|hung|stopped"))
    named = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_-]+)"), F.lit(1))).alias("stem")).filter("length(stem) >= 5").distinct()
    stems = t.files.select(F.regexp_extract("file", r"([^/.]*)\.[^/]*$", 1).alias("stem"), "file").distinct()
    return named.join(stems, "stem").select("doc_id", "file").distinct()


SQL["failing_paths"] = r"""
    WITH d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[\n.!?]')) AS line FROM documents WHERE text IS NOT NULL),
    n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '([A-Za-z0-9_-]+)', 1)) AS stem FROM d WHERE regexp_matches(lower(line), 'fail|error|broken|hung|stopped')),
    s AS (SELECT DISTINCT regexp_extract(file, '([^/.]*)\.[^/]*$', 1) AS stem, file FROM files)
    SELECT DISTINCT doc_id, file FROM n JOIN s USING (stem) WHERE length(stem) >= 5"""


@_q
def small_chunk_merge(t: Tables):
    """Small neighbouring chunks of a file folded together (order-dependent; compared with a plain version in the tests)."""
    c = t.chunks.select("id", "file", "chunk_type", "start_line", "end_line", F.length("content").alias("size")).distinct().filter("file is not null and start_line > 0 and end_line >= start_line and size > 0")
    return Y.merged_chunks(c.select("file", "chunk_type", "start_line", "end_line", "size"))


@_q
def overlap_segments(t: Tables):
    """Windows of all chunks for embedding, with overlap, cut at line ends where possible; a short chunk is one window."""
    c = t.chunks.select("id", "content").distinct().filter("content is not null")
    return Y.segmented(c, "id", "content", 3000)


@_q
def json_containment(t: Tables):
    """Chunks whose metadata contain an object."""
    return t.chunks.filter(Y.json_contains("chunk_metadata", {"chunk_index": 0, "symbol_kind": "METHOD"})).select("id").distinct()


SQL["json_containment"] = """SELECT DISTINCT id FROM chunks WHERE CASE WHEN json_valid(chunk_metadata) THEN json_contains(chunk_metadata, '{"chunk_index":0,"symbol_kind":"METHOD"}') END"""


@_q
def signature_slices(t: Tables):
    """Java sources reduced to their headers."""
    return t.sources.filter(F.col("file").endswith(".java") & F.col("content").isNotNull()).select("file", F.length(Y.sliced_signatures("content")).alias("size"), F.length("content").alias("full_size"))


@_q
def diagram_edges(t: Tables):
    """Module dependency diagram: one line per pair of modules."""
    s = G.placed_symbols(t.symbols).join(G.one_file(t.files), "file").select("id", "module").filter("module <> ''")
    e = G.distinct_edges(t.edges)
    m = e.join(s.select(F.col("id").alias("caller_symbol_id"), F.col("module").alias("a")), "caller_symbol_id").join(s.select(F.col("id").alias("callee_symbol_id"), F.col("module").alias("b")), "callee_symbol_id").filter("a <> b")
    return m.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(F.concat(X.diagram_id("a"), F.lit(" --> "), X.diagram_id("b")).alias("line"), "n")


SQL["diagram_edges"] = """WITH s AS (SELECT id, min(file) AS file FROM symbols GROUP BY id), f AS (SELECT file, max(module) AS module FROM files GROUP BY file), p AS (SELECT id, module FROM s JOIN f USING (file) WHERE module <> ''),
    e AS (SELECT DISTINCT caller_symbol_id, callee_symbol_id, upper(trim(edge_type)) AS k FROM edges)
    SELECT regexp_replace(x.module, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(y.module, '[^A-Za-z0-9_]', '_', 'g') AS line, count(*) AS n FROM e JOIN p x ON x.id = caller_symbol_id JOIN p y ON y.id = callee_symbol_id WHERE x.module <> y.module GROUP BY x.module, y.module"""
