"""Scans, filters, point lookups, listings and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcquarry.functions import paths as P, text as X
from srcquarry.operators import rows as R
from srcquarry.plans.base import Tables, query

QUERIES: dict = {}
SQL: dict[str, str] = {}
_q = query(QUERIES)

#: Kinds that name types; page sizes.
TYPE_KINDS = ["class", "interface", "enum", "record", "struct", "type", "type_alias", "trait"]


def _by_simple_name(s):
    hits = s.select("simple", "id", "fq_name", "file").distinct()
    return R.top_per_group(hits, ["simple"], [F.length("fq_name"), F.col("fq_name"), F.col("id")], 20).select("simple", "id", "fq_name", "rank")


def _typed(t: Tables):
    return t.symbols.filter(F.lower("kind").isin(TYPE_KINDS)).withColumn("simple", X.simple_name("fq_name")).filter("simple is not null")


@_q
def symbols_by_simple_name(t: Tables):
    """Type symbols of every simple name in any package, shortest name first, twenty at most of a name."""
    return _by_simple_name(_typed(t))


SQL["symbols_by_simple_name"] = """
    WITH h AS (SELECT DISTINCT regexp_extract(fq_name, '([^.#]*)$', 1) AS simple, id, fq_name, file FROM symbols
               WHERE lower(kind) IN ('class','interface','enum','record','struct','type','type_alias','trait'))
    SELECT simple, id, fq_name, CAST(row_number() OVER (PARTITION BY simple ORDER BY length(fq_name), fq_name, id) AS INT) AS rank
    FROM h QUALIFY rank <= 20"""


@_q
def symbols_fq_substring(t: Tables):
    """Names that contain a needle, ignoring case."""
    return R.page(t.symbols.filter(F.contains(F.lower("fq_name"), F.lit("branch"))).select("fq_name", "id", "kind").distinct(), [F.col("fq_name"), F.col("id")], 50, default=50)


SQL["symbols_fq_substring"] = """
    SELECT DISTINCT fq_name, id, kind FROM symbols WHERE contains(lower(fq_name), 'branch') ORDER BY fq_name, id LIMIT 50"""


@_q
def symbols_by_file(t: Tables):
    """Symbols of each file in line order, with their position."""
    s = t.symbols.select("file", "start_line", "end_line", "id", "fq_name").distinct().filter("file is not null")
    return R.top_per_group(s, ["file"], [F.col("start_line"), F.col("end_line"), F.col("id")], 1 << 30, "position")


SQL["symbols_by_file"] = """
    SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, id) AS INT) AS position
    FROM (SELECT DISTINCT file, start_line, end_line, id, fq_name FROM symbols WHERE file IS NOT NULL)"""


@_q
def symbols_by_fq(t: Tables):
    """Symbols by their full name, with the number of symbols that share it."""
    s = t.symbols.select("fq_name", "id", "file", "start_line").distinct().filter("fq_name is not null")
    many = s.groupBy("fq_name").agg(F.count(F.lit(1)).alias("n"))
    return s.join(many, "fq_name").select("fq_name", "file", "start_line", "id", "n")


SQL["symbols_by_fq"] = """
    WITH s AS (SELECT DISTINCT fq_name, id, file, start_line FROM symbols WHERE fq_name IS NOT NULL)
    SELECT fq_name, file, start_line, id, n FROM s JOIN (SELECT fq_name, count(*) AS n FROM s GROUP BY 1) USING (fq_name)"""


@_q
def symbols_by_lang_kind(t: Tables):
    """Number of symbols per exact language and kind."""
    return t.symbols.dropDuplicates().groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


SQL["symbols_by_lang_kind"] = "SELECT lang, kind, count(*) AS n FROM (SELECT DISTINCT * FROM symbols) GROUP BY 1, 2"


@_q
def files_by_lang(t: Tables):
    """Non-test files of one language, by path."""
    return t.files.filter((F.lower(F.trim("lang")) == "java") & (~F.col("is_test"))).select("file", "sha", "module").distinct()


SQL["files_by_lang"] = "SELECT DISTINCT file, sha, module FROM files WHERE lower(trim(lang)) = 'java' AND NOT is_test"


@_q
def edges_of_symbol(t: Tables):
    """Outgoing and incoming edges of each symbol, by canonical type."""
    e = t.edges.withColumn("edge_type", X.canonical_edge_type("edge_type")).distinct()
    out = e.select(F.col("caller_symbol_id").alias("id"), "edge_type", F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = out.unionByName(e.select(F.col("callee_symbol_id").alias("id"), "edge_type", F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id", "edge_type").agg(F.sum("o").alias("edges_from"), F.sum("i").alias("edges_to"))


SQL["edges_of_symbol"] = """
    WITH e AS (SELECT DISTINCT caller_symbol_id, callee_symbol_id, upper(trim(edge_type)) AS edge_type FROM edges)
    SELECT id, edge_type, CAST(sum(o) AS BIGINT) AS edges_from, CAST(sum(i) AS BIGINT) AS edges_to FROM (
        SELECT caller_symbol_id AS id, edge_type, 1 AS o, 0 AS i FROM e UNION ALL SELECT callee_symbol_id, edge_type, 0, 1 FROM e)
    GROUP BY 1, 2"""


@_q
def chunks_filtered(t: Tables):
    """Chunk listing with optional predicates: repository, type, language, module of the metadata, contained JSON."""
    c = t.chunks.filter((F.col("chunk_type") == "definition") & F.col("lang").isin("typescript", "javascript"))
    c = c.filter(F.coalesce(F.get_json_object("chunk_metadata", "$.module"), F.lit("")) == "")
    c = c.filter(F.get_json_object("chunk_metadata", "$.chunk_index") == "0")
    return c.select("id", "file", "repo_id", "start_line", "end_line").distinct()


SQL["chunks_filtered"] = """
    SELECT DISTINCT id, file, repo_id, start_line, end_line FROM chunks
    WHERE chunk_type = 'definition' AND lang IN ('typescript', 'javascript')
      AND coalesce(CASE WHEN json_valid(chunk_metadata) THEN json_extract_string(chunk_metadata, '$.module') END, '') = ''
      AND CASE WHEN json_valid(chunk_metadata) THEN json_extract_string(chunk_metadata, '$.chunk_index') END = '0'"""


@_q
def path_prefix(t: Tables):
    """Files at or below a path."""
    return t.files.filter(P.under_prefix("file", "atlas-core")).select("file", "module").distinct()


SQL["path_prefix"] = "SELECT DISTINCT file, module FROM files WHERE file = 'atlas-core' OR starts_with(file, 'atlas-core/')"


@_q
def skip_prefixes(t: Tables):
    """Files not under any skipped prefix (paths, or module ids with dots)."""
    return t.files.filter(~P.under_any("file", ["atlas-core/ledger-aisle", "local-lift"])).select("file").distinct()


SQL["skip_prefixes"] = """
    SELECT DISTINCT file FROM files WHERE NOT regexp_matches(replace(lower(file), '.', '/'), '^(atlas-core/ledger-aisle|local-lift)(/|$)')"""


@_q
def json_field_filter(t: Tables):
    """Null-safe test of a JSON text field."""
    return t.chunks.filter(F.coalesce(F.get_json_object("chunk_metadata", "$.module"), F.lit("")) == "chapter").select("id", "chunk_type").distinct()


SQL["json_field_filter"] = """
    SELECT DISTINCT id, chunk_type FROM chunks
    WHERE CASE WHEN json_valid(chunk_metadata) THEN json_extract_string(chunk_metadata, '$.module') END = 'chapter'"""


@_q
def limit_then_filter(t: Tables):
    """Of the first 100 chunks of a repository those whose path has a pattern: the limit comes first."""
    c = t.chunks.filter("repo_id = 'atlas-core'").select("file", "start_line", "id").distinct()
    return R.limit_then_filter(c, [F.col("file"), F.col("start_line"), F.col("id")], 100, F.lower("file").rlike("test|core"), 20)


SQL["limit_then_filter"] = """
    SELECT * FROM (SELECT DISTINCT file, start_line, id FROM chunks WHERE repo_id = 'atlas-core' ORDER BY file, start_line NULLS FIRST, id LIMIT 100)
    WHERE regexp_matches(lower(file), 'test|core') ORDER BY file, start_line NULLS FIRST, id LIMIT 20"""


@_q
def chunks_by_type_fallback(t: Tables):
    """Up to five chunks of a type per repository in a module; without the module where there are none."""
    c = t.chunks.filter("chunk_type = 'route'").withColumn("module", F.get_json_object("chunk_metadata", "$.module"))
    c = c.select("repo_id", "file", "start_line", "id", (F.coalesce("module", F.lit("")) == "chapter").alias("strict")).distinct()
    has = c.groupBy("repo_id").agg(F.max("strict").alias("any_strict"))
    kept = c.join(has, "repo_id").filter(F.col("strict") | ~F.col("any_strict"))
    return R.top_per_group(kept, ["repo_id"], [F.col("file"), F.col("start_line"), F.col("id")], 5).select("repo_id", "id", "strict", "rank")


SQL["chunks_by_type_fallback"] = """
    WITH c AS (SELECT DISTINCT repo_id, file, start_line, id,
                 coalesce(CASE WHEN json_valid(chunk_metadata) THEN json_extract_string(chunk_metadata, '$.module') END, '') = 'chapter' AS strict
               FROM chunks WHERE chunk_type = 'route'),
    k AS (SELECT * FROM (SELECT *, max(strict) OVER (PARTITION BY repo_id) AS any_strict FROM c) WHERE strict OR NOT any_strict)
    SELECT repo_id, id, strict, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY file, start_line NULLS FIRST, id) AS INT) AS rank FROM k QUALIFY rank <= 5"""


@_q
def edges_excluding_types(t: Tables):
    """Edges but those of given types, compared by canonical type."""
    return t.edges.filter(~X.canonical_edge_type("edge_type").isin("TESTS_SOURCE", "CONTAINS")).select("caller_symbol_id", "callee_symbol_id", X.canonical_edge_type("edge_type").alias("edge_type")).distinct()


SQL["edges_excluding_types"] = """
    SELECT DISTINCT caller_symbol_id, callee_symbol_id, upper(trim(edge_type)) AS edge_type FROM edges WHERE upper(trim(edge_type)) NOT IN ('TESTS_SOURCE', 'CONTAINS')"""


@_q
def non_private_methods(t: Tables):
    """Java methods that are not private; a broken or missing signature counts as not private."""
    vis = F.lower(F.coalesce(F.get_json_object("signature_json", "$.visibility"), F.lit("")))
    return t.symbols.filter((F.lower("lang") == "java") & (F.lower("kind") == "method") & (vis != "private")).select("id", "fq_name").distinct()


SQL["non_private_methods"] = """
    SELECT DISTINCT id, fq_name FROM symbols WHERE lower(lang) = 'java' AND lower(kind) = 'method'
      AND lower(coalesce(CASE WHEN json_valid(signature_json) THEN json_extract_string(signature_json, '$.visibility') END, '')) <> 'private'"""


@_q
def test_path_classifier(t: Tables):
    """Test files by path, with the flag of the table."""
    return t.files.select("file", "is_test", P.is_test("file").alias("by_path"), P.language("file").alias("by_extension"), P.in_skipped_dir("file").alias("skipped")).distinct()


SQL["test_path_classifier"] = r"""
    SELECT DISTINCT file, is_test,
      regexp_matches(lower(trim(file)), '(^|/)(test|tests|testing|__tests__|it)(/|$)') OR contains(trim(file), 'Test')
      OR regexp_matches(lower(trim(file)), '(^|/)e2e/') OR regexp_matches(trim(file), 'IT\.java$')
      OR regexp_matches(regexp_extract(lower(trim(file)), '([^/]*)$', 1), 'tests?\.(java|kt)$|\.tests?\.(cshtml|razor)$|^tests?\.(tsx?|[mc]?jsx?)$')
      OR (regexp_matches(lower(trim(file)), '\.(tsx?|jsx?|mjs|cjs)$') AND (regexp_matches(regexp_extract(lower(trim(file)), '([^/]*)$', 1), '\.(spec|test|cy|e2e|e2e-spec)\.')
          OR regexp_matches(lower(trim(file)), '(^|/)cypress/|playwright'))) AS by_path,
      CASE regexp_extract(lower(file), '(\.[^./]*)$', 1) WHEN '.java' THEN 'java' WHEN '.kt' THEN 'java' WHEN '.cs' THEN 'csharp' WHEN '.cshtml' THEN 'csharp' WHEN '.razor' THEN 'csharp'
        WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript'
        WHEN '.vue' THEN 'javascript' WHEN '.html' THEN 'html' END AS by_extension,
      list_has_any(string_split(regexp_replace(lower(file), '/?[^/]*$', ''), '/'), ['node_modules','.git','dist','public','build','bin','obj','wwwroot','out','target','.next','.nuxt','.output',
        '.svelte-kit','.astro','coverage','website','.nx','.angular','.turbo','.vite','.parcel-cache','.cache','.serverless','angular','angular-animate','angular-loader','angular-mocks',
        'angular-resource','angular-route','jquery','bootstrap','html5-boilerplate','stories','storybook','.storybook']) OR regexp_matches(regexp_replace(lower(file), '/?[^/]*$', ''), '(^|/)\.[^./]') AS skipped
    FROM files"""

# ---- runs and audit entries
_RUN = ["run_id", "repo_id", "status", "started_at"]


@_q
def runs_page(t: Tables):
    """Second page of the completed runs of a time range, newest first."""
    r = t.index_runs.filter((F.lower(F.trim("status")) == "completed") & (F.col("started_at") >= 1735689600000)).select(*_RUN).distinct()
    return R.page(r, [F.desc("started_at"), F.col("run_id")], 50, 50)


SQL["runs_page"] = """
    SELECT DISTINCT run_id, repo_id, status, started_at FROM index_runs WHERE lower(trim(status)) = 'completed' AND started_at >= 1735689600000
    ORDER BY started_at DESC, run_id LIMIT 50 OFFSET 50"""


@_q
def runs_has_audit(t: Tables):
    """Runs with flags: audit entries exist, metrics exist."""
    seen = t.audit_log.filter("run_id is not null").select("run_id").distinct().withColumn("has", F.lit(True))
    runs = t.index_runs.select("run_id", "first_wave_metrics").distinct()
    return runs.join(seen, "run_id", "left").select("run_id", F.coalesce("has", F.lit(False)).alias("has_audit"), F.col("first_wave_metrics").isNotNull().alias("has_metrics")).distinct()


SQL["runs_has_audit"] = """
    SELECT DISTINCT run_id, EXISTS (SELECT 1 FROM audit_log a WHERE a.run_id = r.run_id) AS has_audit, first_wave_metrics IS NOT NULL AS has_metrics FROM index_runs r"""


@_q
def runs_due(t: Tables):
    """Runs whose scheduled rerun is due (0 and null are unset)."""
    return t.index_runs.filter("scheduled_rerun_at > 0 and scheduled_rerun_at <= 1760000000000").select("run_id", "repo_id", "scheduled_rerun_at").distinct()


SQL["runs_due"] = "SELECT DISTINCT run_id, repo_id, scheduled_rerun_at FROM index_runs WHERE scheduled_rerun_at > 0 AND scheduled_rerun_at <= 1760000000000"


@_q
def audit_keyset(t: Tables):
    """Audit entries past a cursor, in the order of arrival."""
    return R.after(t.audit_log.select("id", "run_id", "step", F.lower("log_level").alias("log_level")).distinct(), F.col("id"), 500, 1000)


SQL["audit_keyset"] = "SELECT DISTINCT id, run_id, step, lower(log_level) AS log_level FROM audit_log WHERE id > 500 ORDER BY id LIMIT 1000"


@_q
def audit_time_range(t: Tables):
    """Audit entries of a run between two times, both inclusive, with the milliseconds of their payload."""
    a = t.audit_log.filter("logged_at >= timestamp_ntz '2025-03-01 00:00:00' and logged_at <= timestamp_ntz '2025-09-01 00:00:00'")
    return a.select("id", "run_id", "step", F.get_json_object("payload", "$.ms").try_cast("long").alias("ms")).distinct()


SQL["audit_time_range"] = """
    SELECT DISTINCT id, run_id, step, TRY_CAST(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.ms') END AS BIGINT) AS ms
    FROM audit_log WHERE logged_at BETWEEN TIMESTAMP '2025-03-01' AND TIMESTAMP '2025-09-01'"""


@_q
def critical_files(t: Tables):
    """Files whose path or module has a keyword of critical modules."""
    hay = F.lower(F.concat_ws(" ", "file", "module"))
    return t.files.filter(hay.rlike("ledger|invoice|order|tariff")).select("file", "module").distinct()


SQL["critical_files"] = "SELECT DISTINCT file, module FROM files WHERE regexp_matches(lower(concat_ws(' ', file, module)), 'ledger|invoice|order|tariff')"


@_q
def repository_scan(t: Tables):
    """Scanned sources as file versions: path, language, SHA-256 of the content, test flag; declarations and skipped directories left out."""
    s = t.sources.filter(~P.is_declaration("file") & ~P.in_skipped_dir("file") & P.language("file").isNotNull())
    return s.select("file", P.language("file").alias("lang"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"), P.is_test("file").alias("is_test"), F.length("content").cast("long").alias("code_points"))


SQL["repository_scan"] = SQL["test_path_classifier"].replace("SELECT DISTINCT file, is_test,", "SELECT * EXCLUDE (by_path, by_extension, skipped), by_extension AS lang, by_path AS is_test FROM (SELECT file, sha256(coalesce(content, '')) AS sha, length(content) AS code_points,").replace(
    "    FROM files", "    FROM sources) WHERE NOT skipped AND NOT ends_with(lower(trim(file)), '.d.ts') AND by_extension IS NOT NULL"
)
