"""File sources: repository trees, document discovery, JSON lines of parsers, OpenAPI."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from srcquarry.functions import paths as P
from srcquarry.functions.python import json_pointer
from srcquarry.schemas import CLASS_RECORD, PARSED_FILE


def hidden_skill_dirs(spark: SparkSession, root: str, depth: int = 3) -> list[str]:
    """Folders of agent skills down to a depth. File sources leave out names that begin with a dot below the
    folder they are given, so these folders are given to them by name (a listing of folders, not of files)."""
    jvm = spark.sparkContext._jvm
    found = []
    for level in range(depth + 1):
        p = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * level + "/{.cursor,.agent}/skills")
        found += [x.getPath().toString() for x in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []]
    return found


def tree(spark: SparkSession, root: str, glob: str = "*", also: list[str] | None = None) -> DataFrame:
    """(file, content binary, size) of the files below a folder and further folders in it, paths relative to it."""
    base = root.rstrip("/").removeprefix("file:")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load([root, *(also or [])])
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^/*" + base.lstrip("/") + "/", "")
    return raw.select(rel.alias("file"), "content", F.col("length").alias("size"))


def repository(spark: SparkSession, root: str, skip: list[str] | None = None) -> DataFrame:
    """(file, lang, sha, is_test, source) of the sources of a repository: skipped directories, declarations and other files left out."""
    t = tree(spark, root)
    t = t.filter(P.language("file").isNotNull() & ~P.in_skipped_dir("file") & ~P.is_declaration("file"))
    if skip:
        t = t.filter(~P.under_any("file", skip))
    text = F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8")
    return t.dropDuplicates(["file"]).select("file", P.language("file").alias("lang"), F.sha2("content", 256).alias("sha"), P.is_test("file").alias("is_test"), text.alias("source"))


#: Documents and bytes of one that a bounded discovery takes.
DOCUMENT_LIMIT, DOCUMENT_BYTES = 4000, 2 << 20


def documents(spark: SparkSession, root: str, prefix: str = "", limit: int | None = None, largest: int | None = None) -> DataFrame:
    """(file, kind, content) of all documents, skills, schemas and API descriptions; on request ``limit`` in path order, up to ``largest`` bytes."""
    t = tree(spark, root, also=hidden_skill_dirs(spark, root))
    t = t if largest is None else t.filter(F.col("size") <= largest)
    t = t.filter(~P.in_skipped_dir(F.regexp_replace("file", r"(^|/)\.(cursor|agent)/", "$1")))
    t = t.withColumn("content", F.col("content").cast("string")).withColumn("kind", P.doc_kind("file", "content")).filter("kind is not null")
    if prefix.strip("/"):
        t = t.filter(P.under_prefix("file", prefix.strip("/")))
    t = t.select("file", "kind", "content")
    return t if limit is None else t.orderBy("file").limit(limit)


def parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of the generic JSON lines; broken lines are dropped."""
    return spark.read.schema(PARSED_FILE).option("mode", "DROPMALFORMED").json(path)


def class_records(spark: SparkSession, path: str) -> DataFrame:
    """Class records of the Java parser; other kinds of records in the same lines are left out."""
    lines = spark.read.text(path).withColumn("kind", F.get_json_object("value", "$.kind")).filter("kind in ('class', 'interface', 'enum', 'record')")
    return lines.select(F.from_json("value", CLASS_RECORD).alias("r")).filter("r is not null").select("r.*")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """(id, lang, kind, fq_name, file, …): ids are digests, so the same input gives the same ids."""
    s = parsed.select("path", "lang", F.explode("symbols").alias("s"))
    key = F.sha2(F.concat_ws("|", "lang", "path", "s.fq_name", "s.start_line", "s.kind"), 256)
    return s.select(
        key.alias("id"), "lang", "s.kind", "s.fq_name", F.col("path").alias("file"), "s.start_line", "s.end_line", "s.start_column", "s.end_column", F.col("s.signature").alias("signature_json")
    ).dropDuplicates(["id"])


def edges_of(parsed: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): names resolved in the own file first, then anywhere if unique by smallest id."""
    e = parsed.select("path", F.explode("edges").alias("e")).select("path", "e.caller_fq_name", "e.callee_fq_name", F.upper(F.trim("e.edge_type")).alias("edge_type")).distinct()
    own = symbols.groupBy("file", "fq_name").agg(F.min("id").alias("own"))
    any_ = symbols.groupBy("fq_name").agg(F.min("id").alias("any"))
    for side in ("caller", "callee"):
        name = f"{side}_fq_name"
        e = e.join(own.select(F.col("file").alias("path"), F.col("fq_name").alias(name), F.col("own").alias(f"{side}_own")), ["path", name], "left").join(any_.select(F.col("fq_name").alias(name), F.col("any").alias(f"{side}_any")), name, "left")
        e = e.withColumn(f"{side}_symbol_id", F.coalesce(f"{side}_own", f"{side}_any"))
    ok = F.col("caller_symbol_id").isNotNull() & F.col("callee_symbol_id").isNotNull()
    edges = e.filter(ok).select("caller_symbol_id", "callee_symbol_id", "edge_type").distinct()
    lost = e.filter(~ok).groupBy(F.substring("edge_type", 1, 64).alias("edge_type")).agg(F.count_if(F.col("caller_symbol_id").isNull()).alias("callers"), F.count_if(F.col("callee_symbol_id").isNull()).alias("callees"))
    return edges, lost


VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def load_description(text: str) -> dict:
    """A JSON or YAML document as a dict, empty if it is neither. Without the yaml package YAML raises ImportError."""
    try:
        value = json.loads(text)
    except ValueError:
        import yaml

        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError:
            value = {}
    return value if isinstance(value, dict) else {}


def api_routes(df: DataFrame, key: str = "file", text: str = "content") -> DataFrame:
    """(file, method, route, name): one row per verb and path of an OpenAPI or Swagger document, references followed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, t in zip(b[key], b[text]):
                doc = load_description(t or "")
                paths = doc.get("paths")
                for route, item in (paths.items() if isinstance(paths, dict) and ("openapi" in doc or "swagger" in doc) else ()):
                    if isinstance(item, dict) and isinstance(item.get("$ref"), str):
                        item = json_pointer(doc, item["$ref"])
                    for verb in item if isinstance(item, dict) else ():
                        if verb.lower() in VERBS:
                            op = item[verb] if isinstance(item[verb], dict) else {}
                            rows.append((f, verb.upper(), route, f"API_ROUTE:{verb.upper()}:{route}@{op.get('operationId') or f}"))
            yield pd.DataFrame(rows, columns=["file", "method", "route", "name"])

    return df.select(key, text).mapInPandas(run, "file string, method string, route string, name string")


def java_outline(df: DataFrame) -> DataFrame:
    """(file, kind, fq_name, start_line, end_line) of Java sources by line patterns and brace counting (a fallback parser)."""
    import re

    package = re.compile(r"^\s*package\s+([\w.]+)\s*;")
    type_ = re.compile(r"\b(class|interface|record|enum)\s+([A-Za-z_]\w*)")
    method = re.compile(r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*[\w<>\[\],.? ]+\s+([a-z_]\w*)\s*\([^;{}]*\)\s*(?:throws [\w., ]+)?\{")

    def one(text: str) -> list[tuple[str, str, int, int]]:
        out, stack, depth, pkg = [], [], 0, ""
        for n, line in enumerate(text.split("\n"), 1):
            code = re.sub(r'"(?:\\.|[^"\\])*"|//.*', "", line)
            if m := package.match(code):
                pkg = m[1]
            hit = None
            if (m := type_.search(code)) and "{" in code:
                hit = (m[1], ".".join([*([pkg] if pkg else []), *(x[1] for x in stack if x[0] != "method"), m[2]]), m[2])
            elif stack and stack[-1][0] != "method" and (m := method.match(code)) and m[1] not in ("if", "for", "while", "switch", "catch", "return", "new"):
                hit = ("method", ".".join([*([pkg] if pkg else []), *(x[1] for x in stack)]) + "#" + m[1], m[1])
            if hit:
                stack.append((hit[0], hit[2], hit[1], n, depth))
            depth += code.count("{") - code.count("}")
            while stack and depth <= stack[-1][4]:
                k, _, fq, a, _ = stack.pop()
                out.append((k, fq, a, n))
        return sorted(out, key=lambda r: (r[2], r[3]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, *r) for f, t in zip(b["file"], b["content"]) for r in one(t or "")], columns=["file", "kind", "fq_name", "start_line", "end_line"])

    return df.select("file", "content").mapInPandas(run, "file string, kind string, fq_name string, start_line int, end_line int")


def packages(spark: SparkSession, root: str) -> DataFrame:
    """(package_dir, name, dependency, dev): workspace packages by their manifests, one row per dependency."""
    t = tree(spark, root, "package.json").filter(~P.in_skipped_dir("file")).withColumn("j", F.col("content").cast("string"))
    m = F.from_json("j", "name string, dependencies map<string,string>, devDependencies map<string,string>")
    p = t.select(F.regexp_replace("file", r"/?package\.json$", "").alias("package_dir"), m.alias("m")).filter("m is not null")
    p = p.withColumn("package_dir", F.when(F.col("package_dir") == "", ".").otherwise(F.col("package_dir")))
    deps = lambda c, dev: p.select("package_dir", "m.name", F.explode_outer(F.map_keys(f"m.{c}")).alias("dependency"), F.lit(dev).alias("dev"))
    return deps("dependencies", False).unionByName(deps("devDependencies", True).filter("dependency is not null"))


#: Test frameworks by the dependency that shows them, best first.
FRAMEWORKS = ["vitest", "jest", "mocha", "jasmine", "ava", "@playwright/test", "cypress"]


def frameworks(deps: DataFrame) -> DataFrame:
    """(package_dir, framework): the first framework of the list among the dependencies."""
    pos = F.array_position(F.array(*[F.lit(f) for f in FRAMEWORKS]), F.col("dependency"))
    return deps.withColumn("pos", pos).filter("pos > 0").groupBy("package_dir").agg(F.min_by("dependency", "pos").alias("framework"))


def primary_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(ecosystem, file): the manifest to build with: least depth, then path; Maven wins over Gradle at equal depth."""
    t = tree(spark, root).filter(~P.in_skipped_dir("file"))
    eco = F.when(F.col("file").endswith("pom.xml"), "maven").when(F.col("file").rlike(r"build\.gradle(\.kts)?$"), "gradle").when(F.col("file").endswith(".csproj"), "dotnet").when(F.col("file").rlike(r"(^|/)package\.json$"), "node")
    m = t.select("file", eco.alias("ecosystem")).filter("ecosystem is not null").withColumn("depth", F.size(F.split("file", "/")))
    return m.groupBy("ecosystem").agg(F.min_by("file", F.struct("depth", "file")).alias("file"))
