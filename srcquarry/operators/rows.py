"""Window- and order-based relational operators with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None, default: int = 50, most: int = 200) -> DataFrame:
    """One page: the size defaults and is clamped, a negative offset counts as 0. ``order`` must be total."""
    size = default if not limit or limit <= 0 else min(limit, most)
    return df.orderBy(*order).offset(max(0, offset or 0)).limit(size)


def after(df: DataFrame, cursor: Column, value, limit: int = 10_000) -> DataFrame:
    """Keyset page: rows past a cursor, in its order."""
    return df.filter(cursor > value).orderBy(cursor).limit(limit)


def limit_then_filter(df: DataFrame, order: list[Column], first: int, condition: Column, limit: int) -> DataFrame:
    """The first rows in order, and of these the ones that match: the filter stays above the limit."""
    return df.orderBy(*order).limit(first).filter(condition).orderBy(*order).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given (total) order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def diversify(df: DataFrame, group: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """Scan in order, take a row while its group has fewer than ``cap``, stop at ``limit``."""
    return top_per_group(df, [group], order, cap, "__in_group").orderBy(*order).limit(limit).drop("__in_group")


def refill(df: DataFrame, keys: list[str], kind: str, order: list[Column], limit: int) -> DataFrame:
    """Per key the first ``limit`` rows, but of one kind at most max(2, limit / 2) before rows over that cap refill."""
    cap = max(2, limit // 2)
    within = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    ranked = df.withColumn("__over", (within > cap).cast("int"))
    w = Window.partitionBy(*keys).orderBy("__over", *order)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("__over")


def streaks(df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """Length so far of the run of equal values; an empty value has none and breaks the run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.coalesce(value, F.lit(""))
    changed = df.withColumn("__v", v).withColumn("__new", F.when(F.col("__v") == F.lag("__v").over(w), 0).otherwise(1))
    runs = changed.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(*order))
    return runs.withColumn("streak", F.when(F.col("__v") == "", 0).otherwise(n)).drop("__v", "__new", "__run")


def breaker(df: DataFrame, keys: list[str], order: list[Column], signature: str, magnitude: str, repeat: int = 3, recur: int = 2, idle: int = 5) -> DataFrame:
    """Per attempt: streak of one signature, reappearances of earlier ones, attempts without progress, and the verdict so far.

    All three are running windows over one partitioning, so a key is sorted once.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    s = streaks(df, keys, order, F.col(signature))
    seen = F.row_number().over(Window.partitionBy(*keys, signature).orderBy(*order)) > 1
    s = s.withColumn("__again", (seen & (F.col("streak") == 1)).cast("int"))
    s = s.withColumn("recurrences", F.sum("__again").over(so_far))
    low = F.min(magnitude).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__better", F.when(low.isNull() | (F.col(magnitude) < low), 1).otherwise(0))
    s = s.withColumn("__epoch", F.sum("__better").over(so_far))
    s = s.withColumn("idle", F.row_number().over(Window.partitionBy(*keys, "__epoch").orderBy(*order)) - 1)
    now = (
        F.when(F.col("streak") >= repeat, "repeat").when(F.col("recurrences") >= recur, "oscillation").when(F.col("idle") >= idle, "no progress")
    )
    return s.withColumn("verdict", F.first(now, ignorenulls=True).over(so_far)).drop("__again", "__better", "__epoch")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end) of the unions of intervals that overlap or touch (start at most one past an earlier end)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
    grouped = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def repeated_lines(df: DataFrame, key: str, text: str, threshold: int = 3) -> DataFrame:
    """(key, text): runs of more than ``threshold`` equal lines become the line and a note of how many followed."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    marked = lines.withColumn("__new", F.when(F.col("line") == F.lag("line").over(w), 0).otherwise(1))
    runs = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy(key, "__g").agg(F.min("n").alias("n"), F.first("line").alias("line"), F.count(F.lit(1)).alias("c"))
    note = F.concat("line", F.lit("\n[... "), (F.col("c") - 1).cast("string"), F.lit(" more identical lines]"))
    shown = F.when(F.col("c") > threshold, note).otherwise(F.array_join(F.array_repeat("line", F.col("c").cast("int")), "\n"))
    # The lines of one text are one row already, so the list is bounded by that text.
    parts = F.array_sort(F.collect_list(F.struct("n", shown.alias("s"))))
    return per.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n").alias(text))


def batches(df: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """Number of the batch of at most ``size`` rows within its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def insert_lines(df: DataFrame, key: str, line: str, n_lines: str, tie: str) -> DataFrame:
    """Line at which each insertion lands once those before it are in."""
    w = Window.partitionBy(key).orderBy(line, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("lands_at", F.col(line) + F.coalesce(F.sum(n_lines).over(w), F.lit(0)))


def uncovered_roots(df: DataFrame, path: str) -> DataFrame:
    """Paths of which no proper ancestor is in the table (each path joined with its own prefixes, no theta join)."""
    p = df.select(F.col(path).alias("p")).filter("p is not null").distinct()
    parts = F.split("p", "/")
    ancestors = p.filter(F.size(parts) > 1).select("p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("a"))
    covered = ancestors.join(p.select(F.col("p").alias("a")), "a", "left_semi").select("p").distinct()
    return p.join(covered, "p", "left_anti").select(F.col("p").alias(path))
