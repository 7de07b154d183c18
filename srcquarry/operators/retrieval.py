"""Context bundles: sections, windows, budgets, compaction, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from srcquarry.functions.text import signature_types, truncate
from srcquarry.operators.graph import SIMILAR_TYPES, both_ways, containers, distinct_edges, placed_symbols, priority, profile, resolve_names
from srcquarry.operators.rows import latest, refill, top_per_group

#: Budgets of the sections.
BUDGETS = {"similar": 5, "dependency": 15, "fixture": 5, "config": 5}
SIBLINGS = 12
#: Types of a bundle, their kinds; profiles that take the siblings in the container, and interface contracts.
DOMAIN_MODELS = 8
DOMAIN_KINDS = ["class", "interface", "enum", "record", "struct"]
SIBLING_PROFILES = ["http_api", "nest_module", "full_stack"]
CONTRACT_PROFILES, CONTRACTS = ["http_api", "full_stack"], 8
#: Parts of the paths of fixtures and of configuration.
FIXTURE_PATHS = ["fixture", "helper", "builder"]
CONFIG_PATHS = ["config", "context", "spring", "test-config"]


def budgets(total: int, **given: int) -> dict[str, int]:
    """Section budgets that fit a total: taken from dependencies, then similar, fixtures and configuration, each at least 1."""
    b = BUDGETS | {k: v for k, v in given.items() if v and v > 0}
    over = max(0, sum(b.values()) - total) if total > 0 else 0
    for k in ("dependency", "similar", "fixture", "config"):
        less = min(over, b[k] - 1)
        b[k], over = b[k] - less, over - less
    return b


def segment_windows(chunks: DataFrame, size: int = 3, per_file: int = 2) -> DataFrame:
    """Windows of consecutive segments (idx) of (file, chunk_type, symbol_id), as islands cut every ``size``."""
    keys = ["file", "chunk_type", "symbol_id"]
    one = chunks.withColumn("d", F.row_number().over(Window.partitionBy(*keys, "idx").orderBy("id"))).filter("d = 1")
    island = F.col("idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    runs = one.withColumn("island", island)
    win = F.floor((F.row_number().over(Window.partitionBy(*keys, "island").orderBy("idx")) - 1) / size)
    w = runs.withColumn("win", win).groupBy(*keys, "island", "win").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("segments"))
    return top_per_group(w.drop("island", "win"), ["file"], [F.col("chunk_type"), F.col("symbol_id"), F.col("first_idx")], per_file)


def siblings(chunks: DataFrame, limit: int = SIBLINGS) -> DataFrame:
    """(parent_symbol_id, id, rank): four times the limit in order first, then without the parent's own chunk."""
    order = [F.col("file"), F.col("start_line"), F.col("id")]
    first = top_per_group(chunks, ["parent_symbol_id"], order, 4 * limit, "r").filter(~F.col("symbol_id").eqNullSafe(F.col("parent_symbol_id")))
    return top_per_group(first, ["parent_symbol_id"], [F.col("r")], limit).select("parent_symbol_id", "id", "rank")


def repository_lists(chunks: DataFrame, name: str = "java_unit") -> DataFrame:
    """(repo_id, lang, section, rank, item_id): the chunks that all targets of a repository and language share, a few of each section.

    Similar references and contracts by chunk type; fixtures by type, filled up by path; configuration by path.
    """
    c = chunks.select("id", "repo_id", "lang", "chunk_type", F.lower("file").alias("path"), "file", "start_line").filter("repo_id is not null and lang is not null").distinct()

    def on_path(parts: list[str]) -> F.Column:
        return F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, parts)), lambda x: F.contains(F.col("path"), x)), True), F.lit(False))

    kind = F.coalesce("chunk_type", F.lit(""))
    wanted = {"similar": (kind.isin(SIMILAR_TYPES[profile(name)]), F.lit(0), BUDGETS["similar"]), "fixture": ((kind == "fixture") | on_path(FIXTURE_PATHS), (kind != "fixture").cast("int"), BUDGETS["fixture"])}
    wanted["config"] = on_path(CONFIG_PATHS), F.lit(0), BUDGETS["config"]
    if profile(name) in CONTRACT_PROFILES:
        wanted["contract"] = kind == "api_contract", F.lit(0), CONTRACTS
    out = None
    for section, (condition, first, limit) in wanted.items():
        part = top_per_group(c.filter(condition), ["repo_id", "lang"], [first, F.col("file"), F.col("start_line"), F.col("id")], limit)
        part = part.select("repo_id", "lang", F.lit(section).alias("section"), "rank", F.col("id").alias("item_id"))
        out = part if out is None else out.unionByName(part)
    return out


def domain_types(targets: DataFrame, placed: DataFrame, seen: DataFrame) -> DataFrame:
    """(target_id, rank, item_id): types of the file of a target, then those its signature names, but what is in ``seen`` (target_id, item_id)."""
    t = placed.join(targets.withColumnRenamed("target_id", "id"), "id", "left_semi").select(F.col("id").alias("target_id"), "file", "fq_name", "signature_json")
    # A target has seen itself, a container and its dependencies: of more types than that and the limit together none is reached.
    reach = DOMAIN_MODELS + BUDGETS["dependency"] + 2
    types = placed.filter(F.lower(F.trim("kind")).isin(DOMAIN_KINDS) & F.col("file").isNotNull())
    near = top_per_group(types, ["file"], [F.col("start_line").asc_nulls_last(), F.col("id")], reach, "pos").select("file", F.col("id").alias("item_id"), "pos")
    same = t.join(near, "file").select("target_id", "item_id", F.lit(0).alias("step"), "pos")
    named = t.select("target_id", F.regexp_replace("fq_name", r"\.[^.]*$", "").alias("module"), F.posexplode(signature_types(F.get_json_object("signature_json", "$.type"))).alias("pos", "name"))
    found = resolve_names(named, placed).select("name", "module", F.col("id").alias("item_id"))
    told = named.join(found, ["name", "module"]).select("target_id", "item_id", F.lit(1).alias("step"), "pos")
    every = same.unionByName(told).join(seen, ["target_id", "item_id"], "left_anti")
    one = latest(every, ["target_id", "item_id"], [F.col("step"), F.col("pos")])
    return top_per_group(one, ["target_id"], [F.col("step"), F.col("pos"), F.col("item_id")], DOMAIN_MODELS)


def bundle(targets: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame, name: str = "java_unit") -> DataFrame:
    """(target_id, section, rank, item_id) for all targets at once, in place of one lookup after the other.

    Sections: target, container, dependency (direct edges, for all profiles but java_unit both ways), domain, similar, fixture, config, for
    some profiles sibling and contract, and the chunks and tests of the target. Similar references are listed
    by type here; those of a vector search are ``ranking``'s.
    """
    tg = targets.select(F.col("id").alias("target_id")).distinct()
    e, placed = distinct_edges(edges), placed_symbols(symbols)

    def section(df: DataFrame, label: str, rank: F.Column | None = None) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("target_id").orderBy("item_id")) if rank is None else rank
        return df.select("target_id", F.lit(label).alias("section"), rank.cast("int").alias("rank"), "item_id")

    held = containers(symbols, edges).select(F.col("id").alias("target_id"), F.col("container_id").alias("item_id")).join(tg, "target_id", "left_semi")
    d = both_ways(edges, profile(name) != "java_unit").filter("node <> other").join(tg.withColumnRenamed("target_id", "node"), "node", "left_semi")
    d = d.join(placed.select(F.col("id").alias("other")), "other", "left_semi").withColumn("pri", priority(F.col("edge_type"), F.col("inbound"), name))
    order = [F.col("pri"), F.col("edge_type"), F.col("inbound"), F.col("other")]
    dep = refill(latest(d, ["node", "other"], order[:3]), ["node"], "edge_type", order, BUDGETS["dependency"]).select(F.col("node").alias("target_id"), "rank", F.col("other").alias("item_id"))
    own = tg.withColumn("item_id", F.col("target_id"))
    seen = own.unionByName(held).unionByName(dep.select("target_id", "item_id"))
    ch = chunks.select(F.col("symbol_id").alias("target_id"), F.col("id").alias("item_id")).distinct().join(tg, "target_id", "left_semi")
    te = e.filter("edge_type = 'TESTS_SOURCE'").select(F.col("callee_symbol_id").alias("target_id"), F.col("caller_symbol_id").alias("item_id")).join(tg, "target_id", "left_semi")
    where = chunks.filter("symbol_id is not null").groupBy(F.col("symbol_id").alias("target_id")).agg(F.min("repo_id").alias("repo_id"), F.min("lang").alias("lang")).join(tg, "target_id", "left_semi")
    shared = where.join(repository_lists(chunks, name), ["repo_id", "lang"]).select("target_id", "section", "rank", "item_id")
    out = section(own, "target", F.lit(1)).unionByName(section(held, "container", F.lit(1))).unionByName(section(dep, "dependency", F.col("rank")))
    out = out.unionByName(section(domain_types(tg, placed, seen), "domain", F.col("rank"))).unionByName(shared).unionByName(section(ch, "chunk")).unionByName(section(te, "test"))
    if profile(name) in SIBLING_PROFILES:
        below = chunks.select("id", "symbol_id", "parent_symbol_id", "file", "start_line").distinct().filter("parent_symbol_id is not null")
        first = top_per_group(below, ["parent_symbol_id"], [F.col("file"), F.col("start_line"), F.col("id")], 4 * SIBLINGS, "pos")
        near = held.join(first.withColumnRenamed("parent_symbol_id", "item_id"), "item_id").select("target_id", F.col("symbol_id").alias("item_id"), F.col("id").alias("chunk_id"), "pos")
        left = near.join(own.unionByName(dep.select("target_id", "item_id")), ["target_id", "item_id"], "left_anti")
        sib = top_per_group(left, ["target_id"], [F.col("pos")], SIBLINGS)
        out = out.unionByName(section(sib.select("target_id", "rank", F.col("chunk_id").alias("item_id")), "sibling", F.col("rank")))
    return out


def compact(sections: DataFrame, limit: int = 4096) -> DataFrame:
    """(target_id, section, rank, content): repeated first lines of a target stripped, contents cut at ``limit``."""
    head = F.substring_index("content", "\n", 1)
    seen = F.row_number().over(Window.partitionBy("target_id", head).orderBy("section", "rank")) > 1
    rest = F.when(F.instr("content", "\n") > 0, F.regexp_replace("content", r"^[^\n]*\n", "")).otherwise("")
    return sections.withColumn("content", F.when(seen & (F.length(head) >= 20), rest).otherwise(F.col("content"))).withColumn("content", truncate("content", limit))


def render(sections: DataFrame) -> DataFrame:
    """(target_id, text): the sections of each target as headed lists, in order."""
    parts = F.array_sort(F.collect_list(F.struct("section", "rank", "content")))
    return sections.groupBy("target_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("## "), p["section"], F.lit(" "), p["rank"].cast("string"), F.lit("\n"), p["content"])), "\n\n").alias("text"))
