"""Join and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcquarry.functions import paths as P, text as X
from srcquarry.operators import graph as G, rows as R
from srcquarry.plans.base import Tables, query

QUERIES: dict = {}
SQL: dict[str, str] = {}
_q = query(QUERIES)

_SYM = """s AS (SELECT id, min(lang) AS lang, min(kind) AS kind, min(fq_name) AS fq_name, min(file) AS file, min(start_line) AS start_line, min(end_line) AS end_line,
             min(signature_json) AS signature_json FROM symbols GROUP BY id),
    f AS (SELECT file, max(is_test) AS is_test, max(module) AS module FROM files GROUP BY file),
    e AS (SELECT DISTINCT caller_symbol_id, callee_symbol_id, upper(trim(edge_type)) AS edge_type FROM edges WHERE caller_symbol_id IS NOT NULL AND callee_symbol_id IS NOT NULL)"""


@_q
def symbols_in_nontest_files(t: Tables):
    """Java classes and methods in files that are no tests."""
    s = G.placed_symbols(t.symbols).filter((F.lower("lang") == "java") & F.col("kind").isin("class", "method") & ~P.is_declaration("file"))
    return s.join(G.one_file(t.files).filter("not is_test"), "file").select("id", "fq_name", "file", "module")


SQL["symbols_in_nontest_files"] = f"""WITH {_SYM} SELECT s.id, s.fq_name, s.file, f.module FROM s JOIN f USING (file)
    WHERE lower(lang) = 'java' AND kind IN ('class', 'method') AND NOT is_test AND NOT ends_with(lower(trim(file)), '.d.ts')"""


@_q
def symbols_in_test_files(t: Tables):
    """Symbols in test files, with their language."""
    return G.placed_symbols(t.symbols).join(G.one_file(t.files).filter("is_test"), "file").select("id", "lang", "kind", "file")


SQL["symbols_in_test_files"] = f"WITH {_SYM} SELECT s.id, s.lang, s.kind, s.file FROM s JOIN f USING (file) WHERE is_test"


@_q
def edge_files(t: Tables):
    """File-to-file projection of the edges by type, with the number of edges."""
    return G.file_edges(t.edges, t.symbols).groupBy("caller_file", "callee_file", "edge_type").agg(F.count(F.lit(1)).alias("n"))


SQL["edge_files"] = f"""WITH {_SYM} SELECT a.file AS caller_file, b.file AS callee_file, edge_type, count(*) AS n
    FROM e JOIN s a ON a.id = caller_symbol_id JOIN s b ON b.id = callee_symbol_id GROUP BY 1, 2, 3"""


@_q
def edge_file_pairs(t: Tables):
    """Distinct pairs of different files."""
    return G.file_pairs(t.edges, t.symbols)


SQL["edge_file_pairs"] = f"""WITH {_SYM} SELECT DISTINCT a.file AS from_file, b.file AS to_file
    FROM e JOIN s a ON a.id = caller_symbol_id JOIN s b ON b.id = callee_symbol_id WHERE a.file <> b.file"""


@_q
def edge_distinct(t: Tables):
    """Edge triples, once each."""
    return G.distinct_edges(t.edges)


SQL["edge_distinct"] = f"WITH {_SYM} SELECT * FROM e"

_TESTS = f"""{_SYM}, calls AS (
        SELECT DISTINCT e.caller_symbol_id, e.callee_symbol_id FROM e JOIN s a ON a.id = caller_symbol_id JOIN s b ON b.id = callee_symbol_id
        JOIN f fa ON fa.file = a.file JOIN f fb ON fb.file = b.file WHERE edge_type IN ('CALLS', 'IMPORTS') AND fa.is_test AND NOT fb.is_test),
    named AS (
        SELECT a.id AS caller_symbol_id, min(b.id) AS callee_symbol_id FROM s a JOIN f fa ON fa.file = a.file JOIN s b ON b.fq_name = regexp_replace(trim(a.fq_name), '(Tests|Test|IT)$', '')
        JOIN f fb ON fb.file = b.file WHERE fa.is_test AND NOT fb.is_test AND lower(a.kind) = 'class' AND lower(b.kind) = 'class'
          AND regexp_matches(trim(a.fq_name), '[^.](Tests|Test|IT)$') GROUP BY 1)"""


@_q
def tests_source_edges(t: Tables):
    """Edges from tests to the production symbols they exercise."""
    return G.tests_source(t.edges, t.symbols, t.files)


SQL["tests_source_edges"] = f"WITH {_TESTS} SELECT * FROM calls UNION SELECT * FROM named"


@_q
def materialized_edges(t: Tables):
    """The edge table with its TESTS_SOURCE edges replaced by derived ones."""
    kept = G.distinct_edges(t.edges).filter("edge_type <> 'TESTS_SOURCE'")
    return kept.unionByName(G.tests_source(t.edges, t.symbols, t.files).withColumn("edge_type", F.lit("TESTS_SOURCE"))).distinct()


SQL["materialized_edges"] = f"""WITH {_TESTS} SELECT caller_symbol_id, callee_symbol_id, edge_type FROM e WHERE edge_type <> 'TESTS_SOURCE'
    UNION SELECT *, 'TESTS_SOURCE' FROM calls UNION SELECT *, 'TESTS_SOURCE' FROM named"""


@_q
def naming_convention_link(t: Tables):
    """Test classes by name: the name of the class under test, and whether it exists in another file (names from the class records)."""
    c = t.class_records.select("fq_name", "is_test").filter("fq_name is not null").distinct()
    tests = c.select(F.col("fq_name").alias("test_fq"), X.under_test_name("fq_name").alias("fq_name")).filter("fq_name is not null").distinct()
    known = c.select("fq_name").distinct().withColumn("known", F.lit(True))
    return tests.join(known, "fq_name", "left").select("test_fq", F.col("fq_name").alias("under_test_fq"), F.coalesce("known", F.lit(False)).alias("known"))


SQL["naming_convention_link"] = """
    WITH c AS (SELECT DISTINCT fq_name FROM class_records WHERE fq_name IS NOT NULL),
    t AS (SELECT DISTINCT fq_name AS test_fq, regexp_replace(trim(fq_name), '(Tests|Test|IT)$', '') AS under_test_fq FROM c WHERE regexp_matches(trim(fq_name), '[^.](Tests|Test|IT)$'))
    SELECT test_fq, under_test_fq, under_test_fq IN (SELECT fq_name FROM c) AS known FROM t"""


@_q
def uncovered_anti_join(t: Tables):
    """Methods no test reaches by a TESTS_SOURCE edge."""
    hit = G.distinct_edges(t.edges).filter("edge_type = 'TESTS_SOURCE'").select(F.col("callee_symbol_id").alias("id"))
    return G.placed_symbols(t.symbols).filter("lower(kind) = 'method'").join(hit, "id", "left_anti").select("id", "file")


SQL["uncovered_anti_join"] = f"WITH {_SYM} SELECT id, file FROM s WHERE lower(kind) = 'method' AND id NOT IN (SELECT callee_symbol_id FROM e WHERE edge_type = 'TESTS_SOURCE')"


@_q
def trace_semi_join(t: Tables):
    """Symbols of which a test has a trace: an edge to them or to the type around them."""
    from srcquarry.operators.ranking import traced

    return traced(t.edges, t.symbols)


_HOLDS = "(lower(trim({0})) IN ('class', 'interface', 'struct', 'record') OR trim({0}) IN ('REACT_COMPONENT', 'ANGULAR_COMPONENT', 'ANGULARJS_CONTROLLER', 'NEST_CONTROLLER', 'NEST_MODULE', 'NEST_GATEWAY'))"
_CONT = f"""{_SYM}, c AS (
        SELECT i.id, arg_min(o.id, (-o.start_line, o.end_line, o.id)) AS container_id FROM s i JOIN s o ON o.file = i.file AND o.start_line <= i.start_line AND i.end_line <= o.end_line
        WHERE o.id <> i.id AND i.end_line >= i.start_line AND o.end_line >= o.start_line AND {_HOLDS.format('o.kind')}
          AND NOT (o.start_line = i.start_line AND o.end_line = i.end_line AND o.id > i.id) GROUP BY i.id)"""
_TRACED = f"""{_CONT}, hit AS (SELECT DISTINCT callee_symbol_id AS id FROM e WHERE edge_type = 'TESTS_SOURCE'),
    traced AS (SELECT id FROM hit UNION SELECT id FROM c WHERE container_id IN (SELECT id FROM hit)
        UNION SELECT m.id FROM s m JOIN s k ON k.file = m.file AND k.fq_name = split_part(m.fq_name, '#', 1) JOIN hit ON hit.id = k.id WHERE strpos(m.fq_name, '#') > 1)"""
SQL["trace_semi_join"] = f"WITH {_TRACED} SELECT id FROM traced"


@_q
def container_range_join(t: Tables):
    """Innermost container around each symbol, by file and line range, else by a CONTAINS edge in its file."""
    return G.containers(t.symbols, t.edges)


_HELD = f"""{_CONT}, held AS (SELECT id, container_id FROM c UNION ALL
        SELECT i.id, arg_min(o.id, (-coalesce(o.start_line, -1), coalesce(o.end_line, 2000000000), o.id)) FROM e JOIN s o ON o.id = caller_symbol_id JOIN s i ON i.id = callee_symbol_id AND i.file = o.file
        WHERE edge_type = 'CONTAINS' AND o.id <> i.id AND {_HOLDS.format('o.kind')} AND i.id NOT IN (SELECT id FROM c) GROUP BY i.id)"""
SQL["container_range_join"] = f"WITH {_HELD} SELECT id, container_id FROM held"


@_q
def chunk_symbol_span(t: Tables):
    """Chunks whose symbol is gone or null, with the first symbol of their file whose lines hold theirs."""
    s = G.placed_symbols(t.symbols).filter("file is not null and end_line >= start_line")
    c = t.chunks.select("id", "symbol_id", "file", "start_line", "end_line").distinct()
    lost = c.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti").filter("start_line > 0 and end_line >= start_line")
    block = 64
    spans = s.select("file", F.col("id").alias("found_id"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"), F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("block"))
    hits = lost.withColumn("block", F.floor(F.col("start_line") / block)).join(spans, ["file", "block"]).filter("cs <= start_line and end_line <= ce")
    return R.latest(hits, ["id"], [F.col("cs"), F.col("ce"), F.col("found_id")]).select("id", "found_id")


SQL["chunk_symbol_span"] = f"""WITH {_SYM}, c AS (SELECT DISTINCT id, symbol_id, file, start_line, end_line FROM chunks WHERE start_line > 0 AND end_line >= start_line)
    SELECT c.id, arg_min(s.id, (s.start_line, s.end_line, s.id)) AS found_id FROM c JOIN s ON s.file = c.file AND s.start_line <= c.start_line AND c.end_line <= s.end_line
    WHERE s.end_line >= s.start_line AND (symbol_id IS NULL OR symbol_id NOT IN (SELECT id FROM s)) GROUP BY c.id"""


@_q
def field_types_in_container(t: Tables):
    """Declared types of the fields in each container, sorted."""
    c = G.containers(t.symbols)
    fields = G.placed_symbols(t.symbols).filter(F.lower("kind").isin("field", "variable", "property")).select("id", F.get_json_object("signature_json", "$.type").alias("type"))
    return c.join(fields.filter("type is not null and type <> ''"), "id").groupBy("container_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


SQL["field_types_in_container"] = f"""WITH {_CONT}, x AS (SELECT id, CASE WHEN json_valid(signature_json) THEN json_extract_string(signature_json, '$.type') END AS type FROM s
        WHERE lower(kind) IN ('field', 'variable', 'property'))
    SELECT container_id, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM c JOIN x USING (id) WHERE type <> '' GROUP BY 1"""


@_q
def longest_prefix_owner(t: Tables):
    """Owning package of each file: the longest of the package directories above it (repo, repo/module, module source roots)."""
    parts = F.split("file", "/")
    dirs = t.files.select(F.explode(F.array(*[F.array_join(F.slice(parts, 1, n), "/") for n in (1, 2, 4)])).alias("package_dir")).distinct()
    return G.owning_package(t.files, dirs)


SQL["longest_prefix_owner"] = """
    WITH p AS (SELECT DISTINCT array_to_string(string_split(file, '/')[1:n], '/') AS package_dir FROM files, (VALUES (1), (2), (4)) v(n)),
    x AS (SELECT DISTINCT file FROM files)
    SELECT file, arg_max(package_dir, length(package_dir)) AS package_dir FROM x JOIN p ON starts_with(file, package_dir || '/') GROUP BY file"""


@_q
def package_listing(t: Tables):
    """Files per owning package with their number."""
    own = longest_prefix_owner(t)
    return own.groupBy("package_dir").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


SQL["package_listing"] = f"SELECT package_dir, count(*) AS files, min(file) AS first_file, max(file) AS last_file FROM ({SQL['longest_prefix_owner']}) GROUP BY 1"


@_q
def import_suffix_resolution(t: Tables):
    """Imports of class records to symbols: the longest dotted prefix that names a symbol or a record."""
    imports = t.class_records.select(F.explode("imports").alias("raw")).select(X.import_name("raw").alias("import_name")).distinct()
    known = t.symbols.select("id", "lang", "kind", "fq_name", "file", "start_line", "end_line", "signature_json").unionByName(
        t.class_records.select("id", F.lit("java").alias("lang"), "kind", "fq_name", F.col("file_path").alias("file"), "start_line", "end_line", F.lit(None).cast("string").alias("signature_json"))
    )
    packages = t.class_records.select(F.concat(F.lit("pkg:"), "package_name").alias("id"), F.lit("java").alias("lang"), F.lit("package").alias("kind"), F.col("package_name").alias("fq_name"), F.lit("").alias("file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(None).cast("string").alias("signature_json"))
    return G.resolve_imports(imports, known.unionByName(packages))


SQL["import_suffix_resolution"] = r"""
    WITH k AS (SELECT id, fq_name FROM symbols UNION ALL SELECT id, fq_name FROM class_records UNION ALL SELECT 'pkg:' || package_name, package_name FROM class_records),
    o AS (SELECT id, min(fq_name) AS fq_name FROM k GROUP BY id), s AS (SELECT fq_name, min(id) AS id FROM o WHERE fq_name IS NOT NULL GROUP BY 1),
    i AS (SELECT DISTINCT CASE WHEN ends_with(x, '.*') THEN '' ELSE trim(x) END AS import_name FROM (
        SELECT regexp_replace(trim(regexp_replace(trim(unnest(imports)), ';$', '')), '^(?i)import\s+(static\s+)?', '') AS x FROM class_records))
    SELECT import_name, arg_max(s.id, length(s.fq_name)) AS id, arg_max(s.fq_name, length(s.fq_name)) AS matched
    FROM i JOIN s ON import_name = s.fq_name OR starts_with(import_name, s.fq_name || '.') WHERE import_name <> '' GROUP BY 1"""


@_q
def type_name_resolution(t: Tables):
    """Types named in signatures and all declared names to symbols: exact name, same package, then any package (at most eight)."""
    s = G.placed_symbols(t.symbols).withColumn("type", F.get_json_object("signature_json", "$.type"))
    names = s.select(F.explode(X.signature_types("type")).alias("name"), F.regexp_replace("fq_name", r"\.[^.]*$", "").alias("module")).filter("module is not null")
    declared = s.filter("fq_name is not null").select(F.regexp_extract("fq_name", r"([^.#]*)$", 1).alias("name"), F.lit("com").alias("module"))
    return G.resolve_names(names.unionByName(declared), t.symbols).select("name", "module", "id", "step")


SQL["type_name_resolution"] = f"""WITH {_SYM},
    k AS (SELECT id, fq_name, regexp_extract(fq_name, '([^.#]*)$', 1) AS simple FROM s WHERE lower(kind) IN ('class', 'interface', 'enum', 'record', 'struct')),
    x AS (SELECT DISTINCT unnest(regexp_extract_all(CASE WHEN json_valid(signature_json) THEN json_extract_string(signature_json, '$.type') END, '\\b([A-Z][a-zA-Z0-9]*(?:\\.[A-Za-z0-9]+)*)\\b')) AS name,
            regexp_replace(fq_name, '\\.[^.]*$', '') AS module FROM s WHERE fq_name IS NOT NULL
          UNION SELECT regexp_extract(fq_name, '([^.#]*)$', 1), 'com' FROM s WHERE fq_name IS NOT NULL),
    n AS (SELECT * FROM x WHERE lower(name) NOT IN ('void', 'int', 'long', 'boolean', 'double', 'float', 'byte', 'short', 'char')),
    h AS (SELECT name, module, id, 1 AS step FROM n JOIN k ON k.fq_name = name UNION ALL SELECT name, module, id, 2 FROM n JOIN k ON k.fq_name = module || '.' || name
        UNION ALL SELECT name, module, id, 3 FROM (SELECT name, module, id, row_number() OVER (PARTITION BY name, module ORDER BY length(fq_name), fq_name, id) AS r FROM n JOIN k ON simple = name) WHERE r <= 8)
    SELECT DISTINCT name, module, id, step FROM h QUALIFY step = min(step) OVER (PARTITION BY name, module)""".replace("\\\\", "\\")


@_q
def edge_endpoint_resolution(t: Tables):
    """Calls of class records to symbols by name: own class first, then by full name, then by simple name; the rest counts as unresolved."""
    m = t.class_records.select("fq_name", F.explode("methods").alias("m")).select(F.col("fq_name").alias("own"), F.col("m.fq_name").alias("caller"), F.explode("m.calls").alias("call"))
    c = m.select("own", "caller", F.regexp_replace(X.member_of_signature(F.regexp_replace("call", "^UNRESOLVED:", "")), r"\(.*$", "").alias("callee"), F.col("call").startswith("UNRESOLVED:").alias("unresolved")).distinct()
    known = t.class_records.select(F.explode("methods").alias("m")).select(F.col("m.fq_name").alias("callee")).distinct()
    full = c.join(known.withColumn("hit", F.lit(1)), "callee", "left")
    simple = known.select(F.regexp_extract("callee", r"([^.#]*)$", 1).alias("name")).distinct().withColumn("near", F.lit(1))
    full = full.withColumn("name", F.regexp_extract("callee", r"([^.#]*)$", 1)).join(simple, "name", "left")
    step = F.when(F.col("hit").isNotNull() & F.startswith("callee", F.concat("own", F.lit("#"))), "own class").when(F.col("hit").isNotNull(), "full name").when(F.col("near").isNotNull(), "simple name").otherwise("unresolved")
    return full.groupBy(step.alias("step"), "unresolved").agg(F.count(F.lit(1)).alias("n"))


SQL["edge_endpoint_resolution"] = r"""
    WITH m AS (SELECT fq_name AS own, unnest(methods) AS m FROM class_records), k AS (SELECT DISTINCT m.fq_name AS callee FROM m),
    x AS (SELECT own, m.fq_name AS caller, unnest(m.calls) AS call FROM m),
    c AS (SELECT DISTINCT own, caller, starts_with(call, 'UNRESOLVED:') AS unresolved,
          regexp_replace(CASE WHEN regexp_matches(y, '^[^(]*\.[^(]*\(') THEN regexp_replace(y, '^([^(]*)\.([^.(]*)\((?s).*$', '\1#\2') ELSE y END, '\(.*$', '') AS callee
          FROM (SELECT *, trim(regexp_replace(call, '^UNRESOLVED:', '')) AS y FROM x))
    SELECT CASE WHEN callee IN (SELECT callee FROM k) AND starts_with(callee, own || '#') THEN 'own class' WHEN callee IN (SELECT callee FROM k) THEN 'full name'
                WHEN regexp_extract(callee, '([^.#]*)$', 1) IN (SELECT regexp_extract(callee, '([^.#]*)$', 1) FROM k) THEN 'simple name' ELSE 'unresolved' END AS step,
           unresolved, count(*) AS n FROM c GROUP BY 1, 2"""


@_q
def route_link(t: Tables):
    """Client calls linked to routes by method and path; keys are parsed out of names built from handler files and their callers."""
    e = G.distinct_edges(t.edges).filter("edge_type in ('HANDLER_USES_DTO', 'CALLS')")
    route = e.filter("edge_type = 'HANDLER_USES_DTO'").select(F.concat(F.lit("API_ROUTE:get:/"), F.substring("callee_symbol_id", 1, 3), F.lit("@x@"), "caller_symbol_id").alias("fq_name"), F.col("caller_symbol_id").alias("id"))
    call = e.filter("edge_type = 'CALLS'").select(F.concat(F.lit("API_CLIENT_REQUEST:GET:/"), F.substring("callee_symbol_id", 1, 3), F.lit("@x@"), "caller_symbol_id").alias("fq_name"), F.col("caller_symbol_id").alias("id"))
    r = route.select(F.col("id").alias("route_id"), F.regexp_replace(X.route_key("fq_name", "API_ROUTE", True), "@x$", "").alias("key")).distinct()
    c = call.select(F.col("id").alias("caller_id"), X.route_key("fq_name", "API_CLIENT_REQUEST", False).alias("key")).distinct()
    return c.join(r, "key").groupBy("key").agg(F.countDistinct("caller_id").alias("callers"), F.countDistinct("route_id").alias("routes"))


SQL["route_link"] = f"""WITH {_SYM}, r AS (SELECT DISTINCT caller_symbol_id AS route_id, 'GET:/' || substr(callee_symbol_id, 1, 3) AS key FROM e WHERE edge_type = 'HANDLER_USES_DTO'),
    c AS (SELECT DISTINCT caller_symbol_id AS caller_id, 'GET:/' || substr(callee_symbol_id, 1, 3) AS key FROM e WHERE edge_type = 'CALLS')
    SELECT key, count(DISTINCT caller_id) AS callers, count(DISTINCT route_id) AS routes FROM c JOIN r USING (key) GROUP BY 1"""


@_q
def path_suffix_match(t: Tables):
    """Paths of class records matched with scanned files: exact, then one the end of the other, then a unique base name."""
    c = t.class_records.select("file_path").filter("file_path is not null").distinct()
    raw = c.select("file_path", P.normal("file_path").alias("p"))
    f = t.files.select("file").distinct()
    base = f.select(F.regexp_extract("file", r"([^/]*)$", 1).alias("base"), "file").groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("by_base")).filter("n = 1")
    exact = raw.join(f.select(F.col("file").alias("p")).withColumn("hit", F.lit(1)), "p", "left").withColumn("base", F.regexp_extract("p", r"([^/]*)$", 1))
    # Either path may have more leading directories; the smallest file among several.
    ends = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), n, F.size(F.split(c, "/"))), "/")))
    paths, rest = f.filter("file <> ''"), exact.filter("hit is null and p <> ''").select("p").distinct()
    longer = rest.select("p", ends("p").alias("file")).join(paths, "file").select("p", "file")
    shorter = paths.select("file", ends("file").alias("p")).join(rest, "p").select("p", "file")
    suffix = longer.union(shorter).groupBy("p").agg(F.min("file").alias("by_suffix"))
    found = exact.join(suffix, "p", "left").join(base, "base", "left")
    how = F.when(F.col("hit").isNotNull(), "exact").when(F.col("by_suffix").isNotNull(), "suffix").when(F.col("by_base").isNotNull(), "base name").otherwise("none")
    return found.select("file_path", F.when(F.col("hit").isNotNull(), F.col("p")).otherwise(F.coalesce("by_suffix", "by_base")).alias("file"), how.alias("how"))


SQL["path_suffix_match"] = r"""
    WITH c AS (SELECT DISTINCT file_path, regexp_replace(replace(trim(file_path), '\', '/'), '^(\./|/)+', '') AS p FROM class_records WHERE file_path IS NOT NULL),
    f AS (SELECT DISTINCT file FROM files), b AS (SELECT regexp_extract(file, '([^/]*)$', 1) AS base, min(file) AS by_base FROM f GROUP BY 1 HAVING count(*) = 1)
    SELECT file_path, CASE WHEN f.file IS NOT NULL THEN p ELSE by_base END AS file, CASE WHEN f.file IS NOT NULL THEN 'exact' WHEN by_base IS NOT NULL THEN 'base name' ELSE 'none' END AS how
    FROM c LEFT JOIN f ON f.file = c.p LEFT JOIN b ON b.base = regexp_extract(c.p, '([^/]*)$', 1)"""


@_q
def indegree_centrality(t: Tables):
    """Symbols that at least three edges reach, tests left out."""
    return G.in_degree(t.edges).filter("in_degree >= 3")


SQL["indegree_centrality"] = f"WITH {_SYM} SELECT callee_symbol_id AS id, count(*) AS in_degree FROM e WHERE edge_type <> 'TESTS_SOURCE' GROUP BY 1 HAVING count(*) >= 3"


@_q
def outdegree(t: Tables):
    """Outgoing edges of each symbol."""
    return G.out_degree(t.edges)


SQL["outdegree"] = f"WITH {_SYM} SELECT caller_symbol_id AS id, count(*) AS out_degree FROM e GROUP BY 1"


@_q
def edge_type_cap(t: Tables):
    """Dependencies of each calling symbol: five at most, of one edge type no more than two before others refill."""
    e = G.distinct_edges(t.edges).join(G.placed_symbols(t.symbols).select(F.col("id").alias("callee_symbol_id")), "callee_symbol_id", "left_semi")
    e = e.withColumn("pri", G.priority(F.col("edge_type"), F.lit(False)))
    return R.refill(e, ["caller_symbol_id"], "edge_type", [F.col("pri"), F.col("edge_type"), F.col("callee_symbol_id")], 5).select("caller_symbol_id", "callee_symbol_id", "edge_type", "rank")


_PRI = "CASE edge_type WHEN 'CALLS' THEN 0 WHEN 'INJECTS' THEN 1 WHEN 'INJECTS_NAMED' THEN 1 WHEN 'IMPLEMENTS_SERVICE' THEN 1 WHEN 'EXTENDS' THEN 2 WHEN 'REGISTERS_SERVICE' THEN 2 WHEN 'IMPLEMENTS' THEN 3 WHEN 'CONTAINS' THEN 4 WHEN 'IMPORTS' THEN 5 ELSE 6 END"
SQL["edge_type_cap"] = f"""WITH {_SYM}, x AS (SELECT *, {_PRI} AS pri FROM e WHERE callee_symbol_id IN (SELECT id FROM s)),
    y AS (SELECT *, CAST(row_number() OVER (PARTITION BY caller_symbol_id, edge_type ORDER BY pri, callee_symbol_id) > 2 AS INT) AS over_cap FROM x)
    SELECT caller_symbol_id, callee_symbol_id, edge_type, CAST(row_number() OVER (PARTITION BY caller_symbol_id ORDER BY over_cap, pri, edge_type, callee_symbol_id) AS INT) AS rank FROM y QUALIFY rank <= 5"""


@_q
def bfs_depth2(t: Tables):
    """Everything within two outgoing edges of each symbol, with the best path."""
    return G.expand(t.edges, G.placed_symbols(t.symbols), "java_unit", 2).select("target_id", "other_id", "depth", "edge_type", "path")


_CONF = "CASE WHEN edge_type IN ('CALLS','INJECTS','INJECTS_NAMED','ROUTE_TO_HANDLER','HANDLER_USES_DTO','USES_GUARD','USES_PIPE','USES_INTERCEPTOR','TARGETS_API_ROUTE','CALLS_API','USES_SELECTOR','RENDERS','USES_HOOK','ACCEPTS_PROPS_TYPE','IMPLEMENTS_SERVICE','REGISTERS_SERVICE') THEN 3 WHEN edge_type IN ('IMPORTS','DEPENDS_ON','DEPENDS_ON_DEV','PACKAGE_MAIN','PACKAGE_MODULE','PACKAGE_EXPORT','PACKAGE_ENTRY','PACKAGE_BIN') THEN 1 ELSE 2 END"
SQL["bfs_depth2"] = f"""WITH {_SYM}, tg AS (SELECT id FROM s WHERE id IS NOT NULL),
    one AS (SELECT tg.id AS target_id, callee_symbol_id AS other_id, 1 AS depth, edge_type, edge_type AS path FROM tg JOIN e ON caller_symbol_id = tg.id WHERE callee_symbol_id <> tg.id
            QUALIFY row_number() OVER (PARTITION BY target_id, other_id ORDER BY {_PRI}, {_CONF} DESC, edge_type, path) = 1),
    two AS (SELECT o.target_id, e.callee_symbol_id AS other_id, 2 AS depth, e.edge_type AS edge_type, o.path || ' -> ' || e.edge_type AS path, o.other_id AS via FROM one o JOIN e ON e.caller_symbol_id = o.other_id
            WHERE e.callee_symbol_id <> o.target_id AND NOT EXISTS (SELECT 1 FROM one x WHERE x.target_id = o.target_id AND x.other_id = e.callee_symbol_id))
    SELECT * FROM one UNION ALL SELECT target_id, other_id, depth, edge_type, path FROM (SELECT * FROM two
            QUALIFY row_number() OVER (PARTITION BY target_id, other_id ORDER BY {_PRI}, {_CONF} DESC, edge_type, path, via) = 1)"""


def _module_links(t: Tables):
    """(a, b): different modules with an EXTENDS or IMPLEMENTS edge from a symbol of a to one of b."""
    s = G.placed_symbols(t.symbols).join(G.one_file(t.files), "file").select("id", "module").filter("module <> ''")
    e = G.distinct_edges(t.edges).filter("edge_type in ('EXTENDS', 'IMPLEMENTS')")
    m = e.join(s.select(F.col("id").alias("caller_symbol_id"), F.col("module").alias("a")), "caller_symbol_id").join(s.select(F.col("id").alias("callee_symbol_id"), F.col("module").alias("b")), "callee_symbol_id")
    return m.filter("a <> b").select("a", "b").distinct()


@_q
def dependency_closure(t: Tables):
    """Modules each module reaches over EXTENDS and IMPLEMENTS edges between files of different modules, in whichever order and through cycles."""
    m = _module_links(t)
    return G.closure(m, m.select(F.col("a").alias("id")).distinct(), "a", "b")


SQL["dependency_closure"] = f"""WITH RECURSIVE {_SYM}, p AS (SELECT s.id, f.module FROM s JOIN f USING (file) WHERE module <> ''),
    m AS (SELECT DISTINCT x.module AS a, y.module AS b FROM e JOIN p x ON x.id = caller_symbol_id JOIN p y ON y.id = callee_symbol_id WHERE edge_type IN ('EXTENDS', 'IMPLEMENTS') AND x.module <> y.module),
    r AS (SELECT DISTINCT a AS start, a AS node FROM m UNION SELECT r.start, m.b FROM r JOIN m ON m.a = r.node) SELECT start, node FROM r"""


@_q
def root_compression(t: Tables):
    """Directories that hold files, without those below another such directory at depth two or more."""
    dirs = t.files.select(F.regexp_replace("file", r"/[^/]*$", "").alias("dir")).distinct().filter(F.size(F.split("dir", "/")) >= 3)
    return R.uncovered_roots(dirs, "dir")


SQL["root_compression"] = """WITH d AS (SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS dir FROM files WHERE length(regexp_replace(file, '/[^/]*$', '')) - length(replace(regexp_replace(file, '/[^/]*$', ''), '/', '')) >= 2)
    SELECT dir FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE starts_with(d.dir, x.dir || '/'))"""
