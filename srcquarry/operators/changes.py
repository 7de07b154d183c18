"""Snapshots: differences, upserts, deletes and state changes as new tables (immutable rewriting)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcquarry.operators.rows import latest


def diff(current: DataFrame, stored: DataFrame, key: str = "file", value: str = "sha") -> DataFrame:
    """(key, change): added, changed, removed; one full outer join on the key."""
    a, b = current.select(key, F.col(value).alias("__a"), F.lit(1).alias("__ina")), stored.select(key, F.col(value).alias("__b"), F.lit(1).alias("__inb"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("__inb").isNull(), "added").when(F.col("__ina").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return j.select(key, change.alias("change")).filter("change is not null")


def delta(changes: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals of a change set: one aggregate over the union of what is counted."""
    live = changes.filter("change <> 'removed'").select("file")
    what = changes.select("change").unionByName(symbols.join(live, "file", "left_semi").select(F.lit("symbols").alias("change")))
    what = what.unionByName(chunks.join(live, "file", "left_semi").select(F.lit("chunks").alias("change")))
    return what.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed", "symbols", "chunks")])


def force_reindex(repos: DataFrame, changed: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo_id, has_changes, first_run, no_chunks, force)."""
    flag = lambda df, name: df.select("repo_id").distinct().withColumn(name, F.lit(True))
    j = repos.join(flag(changed, "c"), "repo_id", "left").join(flag(runs, "r"), "repo_id", "left").join(flag(chunks, "k"), "repo_id", "left")
    has, first, none = F.col("c").isNotNull(), F.col("r").isNull(), F.col("k").isNull()
    return j.select("repo_id", has.alias("has_changes"), first.alias("first_run"), none.alias("no_chunks"), (~has & (first | none)).alias("force"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table with rows put in: of each key the first row in ``order`` stays."""
    return latest(table.unionByName(rows), keys, order)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows put in whose key is new; rows of one key count once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys).distinct(), keys, "left_anti"))


def delete_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without those of some files; an edge needs both ends."""
    left = symbols.join(files.select("file").distinct(), "file", "left_anti")
    ids = left.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "caller_symbol_id"), "caller_symbol_id", "left_semi")
    return left, e.join(ids.withColumnRenamed("id", "callee_symbol_id"), "callee_symbol_id", "left_semi")


def reap(runs: DataFrame, finished_at: int, before: int) -> DataFrame:
    """Running runs last heard of before a time become completed, with a note."""
    heard = F.coalesce(F.nullif("last_heartbeat_at", F.lit(0)), "started_at")
    stale = F.coalesce((F.col("status") == "running") & (heard < before), F.lit(False))
    return (
        runs.withColumn("note", F.when(stale, "no heartbeat").otherwise(""))
        .withColumn("finished_at", F.when(stale, F.lit(finished_at)).otherwise(F.col("finished_at")))
        .withColumn("status", F.when(stale, "completed").otherwise(F.col("status")))
    )


def restart(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """Runs after restarts: status running, end and metrics reset, the rest kept."""
    j = runs.join(starts.select("run_id").distinct().withColumn("__again", F.lit(True)), "run_id", "left")
    again = F.col("__again").isNotNull()
    keep = lambda c: F.when(~again, F.col(c)).alias(c)
    return j.select("run_id", F.when(again, "running").otherwise(F.col("status")).alias("status"), keep("finished_at"), "stable", "current_iteration", keep("first_wave_metrics"))


def complete(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Runs marked completed, only where they still run; stable and iterations are taken where given."""
    d = done.select("run_id", F.col("stable").alias("__s"), F.col("iterations").alias("__i"), F.lit(True).alias("__d"))
    j = runs.join(d, "run_id", "left")
    now = F.coalesce(F.col("__d") & (F.lower("status") == "running"), F.lit(False))
    return (
        j.withColumn("stable", F.when(now, F.coalesce("__s", "stable")).otherwise(F.col("stable")))
        .withColumn("iterations", F.when(now, F.coalesce("__i", "iterations")).otherwise(F.col("iterations")))
        .withColumn("status", F.when(now, "completed").otherwise(F.col("status")))
        .drop("__s", "__i", "__d")
    )


def fail(runs: DataFrame, failed: DataFrame) -> DataFrame:
    """Runs marked failed where they still run; unknown runs are added (repository ``unknown`` unless named)."""
    f = failed.select("run_id", F.coalesce(F.nullif("repo_id", F.lit("")), F.lit("unknown")).alias("__repo")).dropDuplicates(["run_id"])
    j = runs.withColumn("__old", F.lit(True)).join(f, "run_id", "full_outer")
    hit = F.col("__repo").isNotNull() & (F.col("__old").isNull() | (F.lower("status") == "running"))
    return j.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).withColumn("repo_id", F.coalesce("repo_id", "__repo")).drop("__old", "__repo")


def same_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks as they are stored: other dimensions raise, NUL is dropped, the type defaults to definition."""
    ok = F.assert_true(F.coalesce(F.size("embedding") == dim, F.lit(False)), F.lit(f"embedding is not of dimension {dim}"))
    checked = chunks.withColumn("__ok", ok).filter("__ok is null").drop("__ok")
    return checked.withColumn("content", F.make_valid_utf8(F.replace("content", F.lit("\0"), F.lit("")))).withColumn("chunk_type", F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("definition")))


def realign(chunks: DataFrame, dim: int) -> DataFrame:
    """The chunk table for a new dimension: the same rows if all have it, else empty."""
    other = chunks.filter(F.coalesce(F.size("embedding") != dim, F.lit(False))).limit(1)
    return chunks.limit(0) if not other.isEmpty() else chunks
