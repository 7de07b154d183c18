"""Schemas of the relations, for readers and writers that must not infer."""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "symbols": "id string, lang string, kind string, fq_name string, file string, start_line int, end_line int, start_column int, end_column int, signature_json string",
    "edges": "caller_symbol_id string, callee_symbol_id string, edge_type string",
    "files": "file string, sha string, lang string, module string, is_test boolean",
    "chunks": "id string, content string, embedding array<float>, symbol_id string, parent_symbol_id string, file string, lang string, chunk_type string, repo_id string, start_line int, end_line int, chunk_metadata string",
    "index_runs": "run_id string, repo_id string, commit_sha string, status string, started_at bigint, finished_at bigint, last_heartbeat_at bigint, scheduled_rerun_at bigint, current_iteration int, iterations int, stable boolean, first_wave_metrics string",
    "audit_log": "id bigint, run_id string, step string, log_level string, payload string, logged_at timestamp_ntz",
    "configs": "id string, name string, description string",
    "config_revisions": "config_id string, version int, body string, created_by string",
    "audit_exports": "id string, run_id string, format string, state string, created_at bigint",
    "tenants": "id string, name string, max_projects int",
    "projects": "id string, tenant_id string, name string, repo_url string, config_id string, config_revision_id string",
    "run_jobs": "id string, project_id string, config_revision_id string, state string, run_at bigint",
    "run_sessions": "id string, run_id string, repo_id string, project_id string, state string, started_at bigint",
    "gap_sessions": "id string, run_session_id string, symbol_fq_name string, source_file string, layer string, kind string, state string, fingerprint string, iterations_used int, started_at bigint",
    "session_attempts": "id bigint, run_session_id string, gap_session_id string, idx int, tool string, step string, duration_ms bigint, ok boolean, created_at bigint",
    "embedding_provider": "id int, provider string, model string, dimension int",
}
#: One parsed file per line, as the external parsers write it.
PARSED_FILE = (
    "path string, lang string, module string, is_test boolean, "
    "symbols array<struct<kind: string, fq_name: string, start_line: int, end_line: int, start_column: int, end_column: int, signature: string>>, "
    "edges array<struct<caller_fq_name: string, callee_fq_name: string, edge_type: string, signature: string>>"
)
CLASS_RECORD = (
    "kind string, fqName string, filePath string, packageName string, isTest boolean, startLine int, endLine int, javadocSummary string, imports array<string>, "
    "methods array<struct<fqName: string, kind: string, signature: string, startLine: int, endLine: int, visibility: string, isStatic: boolean, calls: array<string>>>"
)


def schema(name: str) -> StructType:
    """StructType of a relation."""
    return StructType.fromDDL(DDL[name])
