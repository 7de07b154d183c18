"""Budgeted lists, gists, batches by size, manifests: running sums instead of loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcquarry.functions.text import truncate

#: Signs of a line that states an error.
ERROR_LINE = r"(?i)\[error\]|error:|failed|failure|exception|cannot find|symbol not found|undefined|assertionerror|expected.*but got"


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The first rows of each key, in order, whose running size stays within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(size).over(w)).filter(F.col("__sum") <= budget).drop("__sum")


def manifest(df: DataFrame, key: str, name: str, budget: int) -> DataFrame:
    """(key, listed, omitted, body): sorted names of a key, one a line, as many as fit the budget."""
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    kept = within_budget(df.select(key, name), [key], [F.col(name)], F.length(name) + 3, budget)
    body = kept.groupBy(key).agg(F.count(F.lit(1)).alias("listed"), F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: F.concat(F.lit("- "), x)), "\n").alias("body"))
    j = total.join(body, key, "left")
    return j.select(key, F.coalesce("listed", F.lit(0)).alias("listed"), (F.col("n") - F.coalesce("listed", F.lit(0))).alias("omitted"), F.coalesce("body", F.lit("")).alias("body"))


def extract(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, summary): headings and list lines as far as they fit, other lines until a third of the budget is used.

    The first line that does not fit, or the first other line past the third, ends the summary.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).filter(F.trim("line") != "")
    lines = lines.withColumn("plain", ~F.ltrim("line").rlike(r"^[#*-]")).withColumn("size", F.length("line") + 1)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumn("sum", F.sum("size").over(w))
    over = run.withColumn("over", (F.col("sum") > budget).cast("int")).withColumn("third", (F.col("plain") & (F.col("sum") > budget // 3)).cast("int"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    kept = over.filter("over = 0").withColumn("done", F.coalesce(F.sum("third").over(before), F.lit(0))).filter("done = 0")
    parts = F.array_sort(F.collect_list(F.struct("n", "line")))
    out = kept.groupBy(key).agg(F.trim(F.array_join(F.transform(parts, lambda p: p["line"]), "\n")).alias("summary"))
    return df.select(key).distinct().join(out, key, "left").select(key, F.coalesce("summary", F.lit("")).alias("summary"))


def gist(log: Column | str, head: int, tail: int) -> Column:
    """A log as it is up to ``head`` code points, else its head and tail with a note between."""
    s = F.col(log) if isinstance(log, str) else log
    long = F.length(s) > head
    both = F.concat(F.substring(s, 1, head), F.lit("\n\n[... cut ...]\n\n"), F.right(s, F.lit(tail)))
    return F.when(long & (F.length(s) - tail <= head), F.concat(F.substring(s, 1, head), F.lit("\n\n[cut]\n"))).when(long, both).otherwise(s)


def first_error(log: Column | str) -> Column:
    """First trimmed line that states an error, at most 200 code points."""
    s = F.col(log) if isinstance(log, str) else log
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(ERROR_LINE))
    return F.coalesce(truncate(F.get(lines, 0), 200, "..."), F.lit(""))


def narrative(text: Column | str, marker: str, headings: list[str]) -> Column:
    """Part of a document before its appendix: the marker, else the first of some headings."""
    s = F.col(text) if isinstance(text, str) else text
    cut = F.when(F.instr(s, marker) > 0, F.substring_index(s, marker, 1))
    places = [F.when(F.instr(s, "\n" + h) > 0, F.instr(s, "\n" + h)) for h in headings]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.regexp_replace(F.coalesce(cut, F.when(first.isNotNull(), F.substring(s, F.lit(1), first - 1)), s), r"^\s+|\s+$", "")


def bisected(sizes: list[tuple[str, int]], limit: int) -> list[list[str]]:
    """Batches halved until each fits the limit or holds one file (a driver-side plan over names and sizes of one batch)."""
    if not sizes or sum(n for _, n in sizes) <= limit or len(sizes) == 1:
        return [[f for f, _ in sizes]] if sizes else []
    half = max(1, len(sizes) // 2)
    return bisected(sizes[:half], limit) + bisected(sizes[half:], limit)


def earliest(df: DataFrame, key: str, text: str, candidates: DataFrame, name: str) -> DataFrame:
    """(key, name, position): of the candidates that occur as a word of the text the one that occurs first."""
    words = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./-]+)"), F.lit(1))).alias("position", name))
    hit = words.join(candidates.select(name).distinct(), name, "left_semi")
    return hit.groupBy(key).agg(F.min_by(name, "position").alias(name), F.min("position").alias("position"))
