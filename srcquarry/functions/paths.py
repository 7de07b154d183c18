"""Column expressions on file paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from srcquarry.functions.text import C, _c

#: Languages by file extension.
LANGUAGES = {
    ".java": "java", ".kt": "java", ".cs": "csharp", ".cshtml": "csharp", ".razor": "csharp", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".html": "html", ".vue": "javascript",
}
#: Directories that are not scanned.
SKIPPED_DIRS = [
    "node_modules", ".git", "dist", "public", "build", "bin", "obj", "wwwroot", "out", "target", ".next", ".nuxt", ".output", ".svelte-kit", ".astro",
    "coverage", "website", ".nx", ".angular", ".turbo", ".vite", ".parcel-cache", ".cache", ".serverless", "angular", "angular-animate",
    "angular-loader", "angular-mocks", "angular-resource", "angular-route", "jquery", "bootstrap", "html5-boilerplate", "stories", "storybook",
    ".storybook",
]


def normal(path: C) -> Column:
    """Forward slashes, no leading ``./`` or ``/``, single slashes, ``x/../`` folded once."""
    p = F.replace(F.trim(_c(path)), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"^(\./|/)+", "")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")


def extension(path: C) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]*)$", 1))


def language(path: C) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    spec = F.lower(_c(path)).rlike(r"(^|/)(openapi|swagger)\.(json|ya?ml)$")
    return F.when(spec, "openapi").otherwise(F.try_element_at(table, extension(path)))


def in_skipped_dir(path: C) -> Column:
    dirs = F.split(F.lower(F.regexp_replace(_c(path), r"/?[^/]*$", "")), "/")
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIPPED_DIRS])) | F.exists(dirs, lambda d: d.rlike(r"^\.[^./]"))


def is_declaration(path: C) -> Column:
    return F.lower(F.trim(_c(path))).endswith(".d.ts")


def is_test(path: C) -> Column:
    """Does the path read like a test? Directory names, names with ``Test``, and endings by extension."""
    p = F.trim(_c(path))
    low = F.lower(p)
    base = F.regexp_extract(p, r"([^/]*)$", 1)
    return (
        low.rlike(r"(^|/)(test|tests|testing|__tests__|it)(/|$)")
        | F.contains(p, F.lit("Test"))
        | low.rlike(r"(^|/)e2e/")
        | base.rlike(r"IT\.java$")
        | F.lower(base).rlike(r"tests?\.(java|kt)$|\.tests?\.(cshtml|razor)$|^tests?\.(tsx?|[mc]?jsx?)$")
        | (low.rlike(r"\.(tsx?|jsx?|mjs|cjs)$") & (F.lower(base).rlike(r"\.(spec|test|cy|e2e|e2e-spec)\.") | low.rlike(r"(^|/)cypress/|playwright")))
    )


def under_prefix(path: C, prefix: str) -> Column:
    return (_c(path) == prefix) | F.startswith(_c(path), F.lit(prefix.rstrip("/") + "/"))


def under_any(path: C, prefixes: list[str]) -> Column:
    """Is the path, or the path with its dots as slashes, at or below one of the prefixes?"""
    p = F.lower(F.replace(_c(path), F.lit("\\"), F.lit("/")))
    clean = [x for x in (q.strip().replace("\\", "/").rstrip("/").lower() for q in prefixes) if x]
    return reduce(lambda a, b: a | b, (under_prefix(q, x) for x in clean for q in (p, F.replace(p, F.lit("."), F.lit("/")))), F.lit(False))


def source_candidates(path: C) -> Column:
    """Paths of the sources a test may belong to, best first."""
    p = _c(path)
    java = F.regexp_replace(F.regexp_replace(p, r"src/(test|it)/java/", "src/main/java/"), r"(Tests|Test|IT)\.java$", ".java")
    script = F.regexp_replace(F.regexp_replace(p, r"\.(spec|test|cy)\.", "."), r"(^|/)(__tests__|tests?)/", "$1")
    beside = F.regexp_replace(p, r"\.(spec|test|cy)\.", ".")
    sharp = F.regexp_replace(F.regexp_replace(p, r"\.?(Tests|Test|IntegrationTests)/", "/"), r"Tests?\.cs$", ".cs")
    out = (
        F.when(extension(p) == ".java", F.array(java))
        .when(extension(p) == ".cs", F.array(sharp, F.regexp_replace(p, r"Tests?\.cs$", ".cs")))
        .otherwise(F.array(beside, script, F.regexp_replace(script, r"(^|/)tests?/", "$1src/")))
    )
    return F.array_distinct(F.filter(out, lambda x: x != p))


def suggested_test(path: C) -> Column:
    """Path at which a unit test of a source would be put."""
    p = _c(path)
    return (
        F.when(extension(p) == ".java", F.regexp_replace(F.regexp_replace(p, "src/main/java/", "src/test/java/"), r"\.java$", "Test.java"))
        .when(extension(p) == ".cs", F.regexp_replace(F.regexp_replace(p, r"^(.*?)src/", "$1tests/"), r"\.cs$", "Tests.cs"))
        .otherwise(F.regexp_replace(p, r"(\.[^./]*)$", ".test$1"))
    )


def doc_kind(path: C, head: C) -> Column:
    """skill, doc, schema, api or null, by path and the first bytes of the file."""
    low = F.lower(F.replace(_c(path), F.lit("\\"), F.lit("/")))
    skill = low.endswith("skill.md") & low.rlike(r"(^|/)\.(cursor|agent)/skills/")
    api = low.rlike(r"\.ya?ml$") & F.substring(_c(head), 1, 4096).rlike("openapi:|swagger:")
    return (
        F.when(skill, "skill")
        .when(low.endswith(".md") & ~F.contains(low, F.lit("/node_modules/")), "doc")
        .when(low.endswith(".sql"), "schema")
        .when(api, "api")
    )
