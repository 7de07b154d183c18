"""Column expressions on code and text. All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def approx_tokens(content: C, chars_per_token: C | int = 4) -> Column:
    """ceil(code points / chars per token); null or not positive counts as 4."""
    cpt = F.lit(chars_per_token) if isinstance(chars_per_token, int) else _c(chars_per_token)
    return F.ceil(F.length(_c(content)) / F.when(cpt > 0, cpt).otherwise(4))


def line_range(content: C, start: C, end: C) -> Column:
    """Lines start..end, 1-based and inclusive, clamped to the text; empty past its end."""
    lines = F.split(_c(content), "\n")
    first = F.greatest(_c(start), F.lit(1))
    size = F.least(_c(end), F.size(lines)) - first + 1
    return F.when(size > 0, F.array_join(F.slice(lines, first, F.greatest(size, F.lit(1))), "\n")).otherwise("")


#: Kinds of symbols whose chunks are not definitions.
CHUNK_TYPES = {
    "route": ["api_route", "page_route"],
    "flow": ["user_flow"],
    "e2e_pattern": ["e2e_spec", "page_object"],
    "page": ["form", "test_selector", "ui_test_hook", "static_template"],
    "api_contract": ["api_client_request"],
}


def chunk_type(kind: C, is_test: C) -> Column:
    k = F.lower(F.trim(_c(kind)))
    out = F.when(F.coalesce(_c(is_test), F.lit(False)), "test")
    for name, kinds in CHUNK_TYPES.items():
        out = out.when(k.isin(kinds), name)
    return out.otherwise("definition")


def strip_block_comments(content: C) -> Column:
    """Remove /* ... */; of an unterminated comment the last character stays."""
    closed = F.regexp_replace(_c(content), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(closed, r"(?s)/\*.*(?=.\z)|/\*\z", "")


def cap_line_comments(content: C, limit: int = 500) -> Column:
    """Cut lines that are // comments after ``limit`` code points and mark the cut."""

    def cap(line: Column) -> Column:
        long = line.rlike(r"^\s*//") & (F.length(line) > limit)
        return F.when(long, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)

    return F.array_join(F.transform(F.split(_c(content), "\n"), cap), "\n")


def sanitize(content: C, block_comments: bool = True, comment_limit: int = 500, whitespace: bool = False) -> Column:
    out = _c(content)
    if block_comments:
        out = strip_block_comments(out)
    if comment_limit > 0:
        out = cap_line_comments(out, comment_limit)
    if whitespace:
        out = F.regexp_replace(out, r"\s+", " ")
    return F.regexp_replace(F.replace(out, F.lit("\0"), F.lit("")), r"^\s+|\s+$", "")


def embedding_input(content: C, limit: int = 30_000) -> Column:
    """Trimmed, a single space if empty, at most ``limit`` code points."""
    t = F.regexp_replace(_c(content), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(" ")).otherwise(F.substring(t, 1, limit))


def canonical_edge_type(t: C) -> Column:
    return F.upper(F.trim(_c(t)))


def import_name(raw: C) -> Column:
    """Name in an import declaration; a star import gives the empty string."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.trim(_c(raw)), r";$", "")), r"(?i)^import\s+(static\s+)?", "")
    return F.when(s.endswith(".*"), "").otherwise(F.trim(s))


def class_of(fq: C) -> Column:
    """Part of a member name before ``#``, or null."""
    return F.when(F.instr(_c(fq), "#") > 1, F.substring_index(_c(fq), "#", 1))


def member_of_signature(sig: C) -> Column:
    """``pkg.C.m(int)`` to ``pkg.C#m``; without parentheses or dot as it is."""
    s = F.trim(_c(sig))
    return F.when(s.rlike(r"^[^(]*\.[^(]*\("), F.regexp_replace(s, r"^([^(]*)\.([^.(]*)\((?s).*$", "$1#$2")).otherwise(s)


def module_of_path(path: C) -> Column:
    p = F.regexp_replace(F.trim(_c(path)), r"\.[^./]*$", "")
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", ".", ".."))
    return F.when(F.size(parts) == 0, "root").otherwise(F.array_join(parts, "."))


def simple_name(fq: C) -> Column:
    return F.regexp_extract(_c(fq), r"([^.#]*)$", 1)


def web_path(prefix: C, suffix: C) -> Column:
    joined = F.concat(F.lit("/"), F.coalesce(_c(prefix), F.lit("")), F.lit("/"), F.coalesce(_c(suffix), F.lit("")))
    out = F.regexp_replace(F.regexp_replace(joined, r"/+", "/"), r"(.)/$", "$1")
    return out


def truncate(s: C, limit: int, trailer: str = "…") -> Column:
    return F.when(F.length(_c(s)) > limit, F.concat(F.substring(_c(s), 1, limit), F.lit(trailer))).otherwise(_c(s))


def head_tail(s: C, limit: int, marker: str = "\n…\n") -> Column:
    """Above ``limit`` code points, three quarters from the head and a quarter from the tail."""
    head, tail = max(512, limit * 3 // 4), max(256, limit // 4)
    return F.when(F.length(_c(s)) > limit, F.concat(F.substring(_c(s), 1, head), F.lit(marker), F.right(_c(s), F.lit(tail)))).otherwise(_c(s))


def word_set(s: C) -> Column:
    """Distinct lower-case ASCII words of at least two characters, underscores at their ends removed."""
    words = F.transform(F.split(F.lower(_c(s)), "[^a-zA-Z0-9_]+"), lambda w: F.regexp_replace(w, "^_+|_+$", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def jaccard(a: C, b: C) -> Column:
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


#: Words of the run query and keywords of the boost.
RUN_WORDS = "test tests spec jest vitest mocha junit mockito playwright cypress documentation jsdoc tsdoc javadoc xmldoc"
BOOST_WORDS = ["test", "tests", "jest", "vitest", "playwright", "cypress", "junit", "mockito", "xunit", "nunit", "mstest", "describe", "it(", "documentation", "jsdoc", "tsdoc", "javadoc", "///", "skill"]


def run_query(*parts: str) -> str:
    return " ".join([*(p.strip().lower() for p in parts if p.strip()), RUN_WORDS])


def keyword_boost(path: C, body: C) -> Column:
    """0.03 for each keyword, 0.02 for a description, at most 0.25."""
    hay = F.lower(F.concat_ws(" ", _c(path), _c(body)))
    score = sum((F.when(F.contains(hay, F.lit(w)), 0.03).otherwise(0.0) for w in BOOST_WORDS), F.when(F.contains(hay, F.lit("description:")), 0.02).otherwise(0.0))
    return F.least(F.lit(0.25), score)


# Word boundaries are those of ASCII, whatever the Java version.
TYPE_TOKEN = r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z0-9]*(?:\.[A-Za-z0-9]+)*)(?![A-Za-z0-9_])"
#: Types of languages and libraries that name no type of a repository.
COMMON_TYPES = [
    "String", "Object", "Integer", "Long", "Boolean", "Double", "Float", "Number", "Byte", "Short", "Character", "Void", "List", "Map", "Set",
    "Collection", "Optional", "Stream", "Iterable", "Iterator", "Array", "ArrayList", "HashMap", "HashSet", "Date", "LocalDate", "LocalDateTime",
    "Instant", "Duration", "BigDecimal", "Exception", "RuntimeException", "Throwable", "Error", "Override", "Test", "Promise", "Record", "Task",
    "IEnumerable", "IList", "IDictionary", "Dictionary", "Guid", "DateTime", "Func", "Action",
]
PRIMITIVES = ["void", "int", "long", "boolean", "double", "float", "byte", "short", "char"]


def signature_types(signature: C) -> Column:
    """Type names of a signature, distinct, in order."""
    found = F.regexp_extract_all(_c(signature), F.lit(TYPE_TOKEN), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(PRIMITIVES)))


def body_types(content: C, limit: int | None = 40) -> Column:
    """Leading segments of the type names in a body, distinct, in order, without common ones; the first ``limit``, all with None."""
    found = F.transform(F.regexp_extract_all(_c(content), F.lit(TYPE_TOKEN), F.lit(1)), lambda t: F.substring_index(t, ".", 1))
    own = F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(PRIMITIVES) & ~t.isin(COMMON_TYPES)))
    return own if limit is None else F.slice(own, 1, limit)


def branch_intents(content: C) -> Column:
    """Sorted names of the branches a body has."""
    s = _c(content)
    has = lambda p: s.rlike(p)
    intents = [
        (has(r"(?i)(<=|>=|<|>|==)\s*(0|1|-1|max|min|length|count|size|limit|timeout)"), "boundary_conditions"),
        (has(r"\b(catch|throws?|throw)\b"), "exception_path"),
        (has(r"\bif\s*\(") & has(r"\belse\b"), "if_false_path"),
        (has(r"\bif\s*\("), "if_true_path"),
        (has(r"(?i)(==\s*null|!=\s*null|\bis\s+null\b|\bnull\b)"), "null_handling"),
        (has(r"\bswitch\s*\("), "switch_case_paths"),
        (has(r"\bswitch\s*\(") & (has(r"\bdefault\s*:") | has(r"\bcase\b")), "switch_default_path"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in intents]))


def covered_intents(content: C) -> Column:
    """Branch intents of a test, with what it checks of errors and empty input."""
    s = F.lower(_c(content))
    extra = F.array_compact(
        F.array(
            F.when(s.rlike("(throws?|exception|error|invalid|fail|timeout|retry)"), F.lit("error_path")),
            F.when(s.rlike("(empty|null|blank|whitespace|zero)"), F.lit("empty_or_null_input")),
        )
    )
    return F.array_sort(F.array_union(branch_intents(content), extra))


#: Endings of names that read as a collaborator.
COLLABORATORS = (
    "Service Repository Client Dao Gateway Provider Mapper Manager Factory Handler Producer Consumer Publisher Listener Store Engine "
    "Validator Resolver Adapter Facade Strategy Broker Dispatcher Scheduler"
).split()


def is_collaborator(kind: C, fq: C) -> Column:
    return (F.lower(F.trim(_c(kind))) == "interface") | simple_name(fq).rlike("(" + "|".join(COLLABORATORS) + ")$")


def under_test_name(fq: C) -> Column:
    """Name of the class a test class is named after, or null."""
    s = F.trim(_c(fq))
    return F.when(s.rlike(r"[^.](Tests|Test|IT)$"), F.regexp_replace(s, r"(Tests|Test|IT)$", ""))


def diagram_id(s: C) -> Column:
    """Identifier usable in a diagram."""
    return F.regexp_replace(_c(s), r"[^A-Za-z0-9_]", "_")


def route_key(fq: C, prefix: str, last_at: bool) -> Column:
    """METHOD:path of a route (split at the last @) or a client call (split at the first), or null."""
    cut = r"^" + prefix + r":([^:@]+):(.+)@[^@]*$" if last_at else r"^" + prefix + r":([^:@]+):([^@]+)@.*$"
    s = _c(fq)
    return F.when(s.rlike(cut), F.concat(F.upper(F.trim(F.regexp_extract(s, cut, 1))), F.lit(":"), F.trim(F.regexp_extract(s, cut, 2))))
