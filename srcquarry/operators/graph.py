"""Joins over the symbol graph: projections, resolution cascades, container ranges, bounded expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcquarry.functions.text import canonical_edge_type, class_of, under_test_name
from srcquarry.operators.rows import latest

#: Priority of an edge type for unit contexts (lower comes first), 6 for all others.
UNIT_PRIORITY = {"CALLS": 0, "INJECTS": 1, "INJECTS_NAMED": 1, "IMPLEMENTS_SERVICE": 1, "EXTENDS": 2, "REGISTERS_SERVICE": 2, "IMPLEMENTS": 3, "CONTAINS": 4, "IMPORTS": 5}
#: Fixed value: links followed between C# projects.
PROJECT_DEPTH = 32
#: Priorities by profile, 100 for all other types; a pair is (reached against the edge, along it).
PROFILE_PRIORITY: dict[str, dict[str, int | tuple[int, int]]] = {
    "http_api": {
        "HANDLER_USES_DTO": 10, "USES_GUARD": 10, "USES_PIPE": 10, "USES_INTERCEPTOR": 10, "INJECTS": 12, "INJECTS_NAMED": 12, "IMPLEMENTS_SERVICE": 12,
        "REGISTERS_SERVICE": 12, "ROUTE_TO_HANDLER": (5, 30), "CALLS": 20, "TARGETS_API_ROUTE": 35, "CONTAINS": 40, "EXTENDS": 40, "IMPLEMENTS": 40, "IMPORTS": 45,
    },
    "e2e_playwright": {"USES_SELECTOR": 10, "TARGETS_API_ROUTE": 10, "ROUTE_TO_HANDLER": (12, 25), "CALLS": 20, "CONTAINS": 40},
    "react_feature": {"RENDERS": 10, "USES_HOOK": 10, "ACCEPTS_PROPS_TYPE": 10, "CALLS": 15, "IMPORTS": (18, 50), "CONTAINS": 35},
    "nest_module": {
        "INJECTS": 10, "INJECTS_NAMED": 10, "IMPLEMENTS_SERVICE": 11, "REGISTERS_SERVICE": 11, "MODULE_IMPORTS": 12, "MODULE_EXPORTS": 12, "MODULE_PROVIDERS": 12,
        "ROUTE_TO_HANDLER": (8, 22), "CONTAINS": 20, "CALLS": 30,
    },
    "full_stack": {
        "ROUTE_TO_HANDLER": (5, 28), "USES_SELECTOR": 9, "HANDLER_USES_DTO": 10, "USES_GUARD": 10, "USES_PIPE": 10, "USES_INTERCEPTOR": 10, "INJECTS": 12,
        "INJECTS_NAMED": 12, "IMPLEMENTS_SERVICE": 12, "REGISTERS_SERVICE": 12, "RENDERS": 10, "USES_HOOK": 10, "ACCEPTS_PROPS_TYPE": 10, "CALLS": 15,
        "IMPORTS": (18, 45), "TARGETS_API_ROUTE": 32, "CONTAINS": 35, "EXTENDS": 35, "IMPLEMENTS": 35,
    },
}
#: Confidence of edge types, 2 for all others.
CONFIDENCE = {
    3: [
        "CALLS", "INJECTS", "INJECTS_NAMED", "ROUTE_TO_HANDLER", "HANDLER_USES_DTO", "USES_GUARD", "USES_PIPE", "USES_INTERCEPTOR", "TARGETS_API_ROUTE",
        "CALLS_API", "USES_SELECTOR", "RENDERS", "USES_HOOK", "ACCEPTS_PROPS_TYPE", "IMPLEMENTS_SERVICE", "REGISTERS_SERVICE",
    ],
    1: ["IMPORTS", "DEPENDS_ON", "DEPENDS_ON_DEV", "PACKAGE_MAIN", "PACKAGE_MODULE", "PACKAGE_EXPORT", "PACKAGE_ENTRY", "PACKAGE_BIN"],
}
#: Names under which a profile is asked for; all others mean java_unit.
PROFILE_ALIASES = {
    "http_api": ["http_api", "http-api", "api", "backend", "nest_api", "spring"],
    "e2e_playwright": ["e2e_playwright", "e2e-playwright", "e2e", "playwright", "ui_test"],
    "react_feature": ["react_feature", "react-feature", "react", "frontend"],
    "nest_module": ["nest_module", "nest-module", "nest", "wiring"],
    "full_stack": ["full_stack", "full-stack", "fullstack", "react_http_api", "react-http-api", "ui_and_api"],
}
#: Chunk types that are similar references of a profile.
SIMILAR_TYPES = {
    "java_unit": ["test"], "http_api": ["test", "route", "api_contract"], "e2e_playwright": ["test", "e2e_pattern", "page", "route"],
    "react_feature": ["test", "definition"], "nest_module": ["test", "route", "definition"],
    "full_stack": ["test", "definition", "route", "api_contract", "e2e_pattern", "page"],
}


def profile(name: str) -> str:
    low = name.strip().lower()
    return next((p for p, names in PROFILE_ALIASES.items() if low in names), "java_unit")


def priority(edge_type: Column, inbound: Column, name: str = "java_unit") -> Column:
    table = UNIT_PRIORITY if profile(name) == "java_unit" else PROFILE_PRIORITY[profile(name)]
    rest = 6 if profile(name) == "java_unit" else 100
    out = None
    for kind, value in table.items():
        v = F.when(inbound, value[0]).otherwise(value[1]) if isinstance(value, tuple) else F.lit(value)
        out = F.when(edge_type == kind, v) if out is None else out.when(edge_type == kind, v)
    return out.otherwise(rest)


def confidence(edge_type: Column) -> Column:
    return F.when(edge_type.isin(CONFIDENCE[3]), 3).when(edge_type.isin(CONFIDENCE[1]), 1).otherwise(2)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("caller_symbol_id", "callee_symbol_id", canonical_edge_type("edge_type").alias("edge_type")).filter("caller_symbol_id is not null and callee_symbol_id is not null").distinct()


def placed_symbols(symbols: DataFrame) -> DataFrame:
    """One row per symbol id."""
    cols = ["id", "lang", "kind", "fq_name", "file", "start_line", "end_line", "signature_json"]
    return symbols.groupBy("id").agg(*[F.min(c).alias(c) for c in cols[1:]])


def one_file(files: DataFrame) -> DataFrame:
    return files.groupBy("file").agg(F.max("is_test").alias("is_test"), F.max("module").alias("module"))


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_file, callee_file, edge_type) of every edge whose two ends are known."""
    s = placed_symbols(symbols).select("id", "file")
    a = distinct_edges(edges).join(s.select(F.col("id").alias("caller_symbol_id"), F.col("file").alias("caller_file")), "caller_symbol_id")
    return a.join(s.select(F.col("id").alias("callee_symbol_id"), F.col("file").alias("callee_file")), "callee_symbol_id").select("caller_file", "callee_file", "edge_type")


def file_pairs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct pairs of different files, ``./`` and case of slashes made alike."""
    clean = lambda c: F.regexp_replace(F.replace(F.col(c), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    p = file_edges(edges, symbols).select(clean("caller_file").alias("from_file"), clean("callee_file").alias("to_file"))
    return p.filter("from_file <> to_file").distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    """Edges that reach a symbol, but those of tests."""
    return distinct_edges(edges).filter("edge_type <> 'TESTS_SOURCE'").groupBy(F.col("callee_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    return distinct_edges(edges).groupBy(F.col("caller_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def tests_source(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(caller, callee) from tests to production: calls and imports across, and classes named after another."""
    s = placed_symbols(symbols).join(one_file(files), "file").select("id", "is_test", "kind", "fq_name")
    e = distinct_edges(edges).filter("edge_type in ('CALLS', 'IMPORTS')").select("caller_symbol_id", "callee_symbol_id").distinct()
    test = s.filter("is_test").select(F.col("id").alias("caller_symbol_id"))
    prod = s.filter("not is_test").select(F.col("id").alias("callee_symbol_id"))
    return e.join(test, "caller_symbol_id").join(prod, "callee_symbol_id").select("caller_symbol_id", "callee_symbol_id").union(named_after(symbols, files)).distinct()


def named_after(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Test classes with the class they are named after (the smallest id among equals)."""
    s = placed_symbols(symbols).filter("lower(kind) = 'class'").join(one_file(files), "file")
    test = s.filter("is_test").select(F.col("id").alias("caller_symbol_id"), under_test_name("fq_name").alias("fq_name"))
    prod = s.filter("not is_test").groupBy("fq_name").agg(F.min("id").alias("callee_symbol_id"))
    return test.join(prod, "fq_name").select("caller_symbol_id", "callee_symbol_id")


#: Kinds that contain others, in whatever case and as they are written.
CONTAINER_KINDS = ["class", "interface", "struct", "record"]
FRAMEWORK_CONTAINER_KINDS = ["REACT_COMPONENT", "ANGULAR_COMPONENT", "ANGULARJS_CONTROLLER", "NEST_CONTROLLER", "NEST_MODULE", "NEST_GATEWAY"]


def is_container(kind: str) -> Column:
    k = F.trim(kind)
    return F.lower(k).isin(CONTAINER_KINDS) | k.isin(FRAMEWORK_CONTAINER_KINDS)


def containers(symbols: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(id, container_id): the innermost container of the same file around each other symbol, by lines.

    With ``edges``, a symbol that no container spans takes the last one of its file that has a CONTAINS edge to it.
    Joined on (file, line block): a container is listed under each block of lines it spans, so a file with
    very many symbols is no single group of pairs.
    """
    block = 64
    placed = placed_symbols(symbols).filter("file is not null")
    s = placed.filter("start_line is not null and end_line >= start_line")
    outer = s.filter(is_container("kind")).select(
        "file", F.col("id").alias("container_id"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"),
        F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("block"),
    )
    inner = s.select("file", "id", "start_line", "end_line", F.floor(F.col("start_line") / block).alias("block"))
    hits = inner.join(outer, ["file", "block"]).filter("cs <= start_line and end_line <= ce and id <> container_id")
    hits = hits.filter("not (cs = start_line and ce = end_line and container_id > id)").select("id", "container_id", F.lit(0).alias("step"), "cs", "ce")
    if edges is not None:
        e = distinct_edges(edges).filter("edge_type = 'CONTAINS' and caller_symbol_id <> callee_symbol_id")
        above = placed.filter(is_container("kind")).select(F.col("id").alias("caller_symbol_id"), "file", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
        below = placed.select(F.col("id").alias("callee_symbol_id"), "file")
        linked = e.join(above, "caller_symbol_id").join(below, ["callee_symbol_id", "file"])
        hits = hits.unionByName(linked.select(F.col("callee_symbol_id").alias("id"), F.col("caller_symbol_id").alias("container_id"), F.lit(1).alias("step"), "cs", "ce"))
    return latest(hits, ["id"], [F.col("step"), F.desc_nulls_last("cs"), F.col("ce").asc_nulls_last(), F.col("container_id")]).select("id", "container_id")


def owning_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, package_dir): the longest directory of a package above each file, by joining its own prefixes."""
    parts = F.split("file", "/")
    up = files.select("file").distinct().filter(F.size(parts) > 1).select(
        "file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("package_dir")
    )
    hit = up.join(packages.select("package_dir").distinct(), "package_dir")
    return hit.groupBy("file").agg(F.max_by("package_dir", F.length("package_dir")).alias("package_dir"))


def resolve_names(names: DataFrame, symbols: DataFrame, limit: int = 8) -> DataFrame:
    """(name, module, id, step): type names by exact name, then module.name, then any package; the first step with a hit wins."""
    s = placed_symbols(symbols).filter(F.lower("kind").isin("class", "interface", "enum", "record", "struct")).select("id", "fq_name")
    n = names.select("name", "module").distinct()
    exact = n.join(s.withColumnRenamed("fq_name", "name"), "name").select("name", "module", "id", F.lit(1).alias("step"))
    near = n.withColumn("fq_name", F.concat_ws(".", "module", "name")).join(s, "fq_name").select("name", "module", "id", F.lit(2).alias("step"))
    simple = s.withColumn("name", F.regexp_extract("fq_name", r"([^.#]*)$", 1))
    far = n.join(simple, "name").withColumn("r", F.row_number().over(Window.partitionBy("name", "module").orderBy(F.length("fq_name"), "fq_name", "id")))
    far = far.filter(F.col("r") <= limit).select("name", "module", "id", F.lit(3).alias("step"))
    every = exact.unionByName(near).unionByName(far)
    best = F.min("step").over(Window.partitionBy("name", "module"))
    return every.withColumn("best", best).filter("step = best").drop("best").distinct()


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(import_name, id, matched): the longest dotted prefix that names a symbol (smallest id among equals)."""
    s = placed_symbols(symbols).filter("fq_name is not null").groupBy("fq_name").agg(F.min("id").alias("id"))
    parts = F.split("import_name", r"\.")
    prefixes = imports.select("import_name").distinct().filter("import_name <> ''").select(
        "import_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("fq_name")
    )
    hit = prefixes.join(s, "fq_name")
    return latest(hit, ["import_name"], [F.desc(F.length("fq_name"))]).select("import_name", "id", F.col("fq_name").alias("matched"))


def both_ways(edges: DataFrame, inbound: bool) -> DataFrame:
    """(node, other, edge_type, inbound) of the distinct edges, one or both ways."""
    e = distinct_edges(edges)
    out = e.select(F.col("caller_symbol_id").alias("node"), F.col("callee_symbol_id").alias("other"), "edge_type", F.lit(False).alias("inbound"))
    if not inbound:
        return out
    return out.unionByName(e.select(F.col("callee_symbol_id").alias("node"), F.col("caller_symbol_id").alias("other"), "edge_type", F.lit(True).alias("inbound")))


def expand(edges: DataFrame, targets: DataFrame, name: str = "java_unit", depth: int = 2) -> DataFrame:
    """(target_id, other_id, depth, edge_type, inbound, path): what is reached from each target within ``depth`` edges.

    Level by level for all targets at once. Per (target, node) the best edge is kept: least depth, then
    priority, confidence, direction, type and the path itself. Nodes are not met twice.
    """
    steps = both_ways(edges, profile(name) != "java_unit")
    pri, conf = priority(F.col("edge_type"), F.col("inbound"), name), confidence(F.col("edge_type"))
    label = F.concat("edge_type", F.when(F.col("inbound"), F.lit("←")).otherwise(F.lit("")))
    front = targets.select(F.col("id").alias("target_id"), F.col("id").alias("node"), F.lit("").alias("path")).distinct()
    seen = front.select("target_id", F.col("node").alias("other"))
    found = None
    for level in range(1, depth + 1):
        cand = front.join(steps, "node").withColumn("path", F.concat("path", F.when(F.col("path") == "", "").otherwise(" -> "), label))
        cand = cand.join(seen, ["target_id", "other"], "left_anti")
        best = latest(cand, ["target_id", "other"], [pri, F.desc(conf), F.col("inbound"), F.col("edge_type"), F.col("path"), F.col("node")])
        best = best.select("target_id", F.col("other").alias("other_id"), F.lit(level).alias("depth"), "edge_type", "inbound", "path")
        found = best if found is None else found.unionByName(best)
        front = best.select("target_id", F.col("other_id").alias("node"), "path")
        seen = seen.union(best.select("target_id", "other_id"))
    return found


def closure(edges: DataFrame, start: DataFrame, a: str, b: str, depth: int | None = None) -> DataFrame:
    """(start, node): everything reached from each start, by rounds to the fixpoint, or up to ``depth`` links; each round is written and cut.

    References between C# projects are bounded: ``depth=PROJECT_DEPTH``.
    """
    from srcquarry.runtime import Scratch

    scratch = Scratch(edges.sparkSession, "closure")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    front, n = scratch.write_counted(start.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct(), "reached/r=0")
    k = 0
    while n and (depth is None or k < depth):
        k += 1
        new = front.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        known = scratch.read("reached", front.schema).drop("r")
        front, n = scratch.write_counted(new.join(known, ["start", "node"], "left_anti"), f"reached/r={k}")
    # Rounds are distinct and do not overlap.
    return scratch.read("reached", front.schema).drop("r")


def link_routes(symbols: DataFrame, route_key, client_key) -> DataFrame:
    """(caller, callee) of client calls and the routes they name, many to many, by METHOD:path."""
    s = placed_symbols(symbols)
    routes = s.select(F.col("id").alias("callee_symbol_id"), route_key.alias("key")).filter("key is not null")
    calls = s.select(F.col("id").alias("caller_symbol_id"), client_key.alias("key")).filter("key is not null")
    return calls.join(routes, "key").select("caller_symbol_id", "callee_symbol_id").distinct()


def class_symbol(fq: str) -> Column:
    return class_of(fq)
