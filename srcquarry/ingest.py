"""Indexing of a repository into a store: difference, cascade, symbols, edges, chunks, vectors, totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from srcquarry.functions import text as X
from srcquarry.functions.python import embedded
from srcquarry.operators import changes as C
from srcquarry.sources.scan import edges_of, symbols_of
from srcquarry.store import Store


def indexable(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Scanned files that the parsers know, by path with or without ``./`` and with either slash."""
    clean = lambda c: F.regexp_replace(F.replace(F.col(c), F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")
    known = parsed.select(clean("path").alias("__p")).distinct()
    return files.withColumn("__p", clean("file")).join(known, "__p", "left_semi").drop("__p")


def merge_parsed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Parsed files of two parsers; a path of the first is not overwritten."""
    return first.unionByName(second.join(first.select("path").distinct(), "path", "left_anti"))


def chunk_rows(symbols: DataFrame, sources: DataFrame, repo_id: str, max_tokens: int = 800, chars_per_token: int = 4, header: int = 160) -> DataFrame:
    """Chunks of (id, lang, kind, fq_name, file, lines, is_test): one per symbol, or pieces of max(5, max * cpt / 80) lines above the limit.

    Files are joined with their sources once; the text of a piece is cut out of the lines of its file.
    """
    step = max(5, max_tokens * chars_per_token // 80)
    j = symbols.join(sources.select("file", "source"), "file")
    whole = X.line_range("source", "start_line", "end_line")
    big = X.approx_tokens(whole, chars_per_token) > max_tokens
    starts = F.when(big, F.sequence(F.col("start_line"), F.greatest("start_line", "end_line"), F.lit(step))).otherwise(F.array("start_line"))
    p = j.withColumn("big", big).select("*", F.posexplode(starts).alias("piece", "first"))
    p = p.withColumn("last", F.when(F.col("big"), F.least(F.col("first") + step - 1, "end_line")).otherwise(F.col("end_line")))
    body = X.sanitize(X.line_range("source", "first", "last"))
    head = X.truncate(F.concat(F.lit("[symbol_kind="), F.lower("kind"), F.lit(" fq_name="), "fq_name", F.lit("]")), header)
    meta = F.to_json(F.struct(F.lower("kind").alias("symbol_kind"), F.col("piece").alias("chunk_index"), F.get_json_object("signature_json", "$.visibility").alias("visibility")))
    return p.filter(F.length(body) > 0).select(
        F.sha2(F.concat_ws("|", F.lit(repo_id), "id", "piece"), 256).alias("id"), F.concat(head, F.lit("\n\n"), body).alias("content"), F.col("id").alias("symbol_id"),
        F.lit(None).cast("string").alias("parent_symbol_id"), "file", "lang", X.chunk_type("kind", "is_test").alias("chunk_type"), F.lit(repo_id).alias("repo_id"),
        F.col("first").alias("start_line"), F.col("last").alias("end_line"), meta.alias("chunk_metadata"),
    )


def index(store: Store, repo_id: str, files: DataFrame, parsed: DataFrame, provider: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64, scope: bool = False) -> dict[str, int]:
    """Bring a store up to date with ``files`` (file, lang, sha, is_test, source) and their parsed records.

    Only added and changed files are read again. Without a change everything is, if the store has no chunks of the repository. With
    ``scope`` only files below ``repo_id`` count as removed; otherwise all stored files that are not scanned.
    """
    current = indexable(files, parsed)
    stored = store.files.filter(F.startswith("file", F.lit(repo_id + "/"))) if scope else store.files
    changes = C.diff(current.select("file", "sha"), stored.select("file", "sha")).persist()
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    force = not counts and store.chunks.filter(F.col("repo_id") == repo_id).limit(1).isEmpty()
    todo = current.select("file") if force else changes.filter("change <> 'removed'").select("file")
    if counts or force:
        gone = changes.select("file").union(todo).distinct()
        fresh = current.join(todo, "file", "left_semi")
        new_parsed = parsed.join(todo.withColumnRenamed("file", "path"), "path", "left_semi")
        symbols = symbols_of(new_parsed)
        store.delete_files(gone)
        store.insert_symbols(symbols)
        edges, lost = edges_of(new_parsed, store.symbols)
        store.insert_edges(edges)
        counts["unresolved"] = sum(r["callers"] + r["callees"] for r in lost.collect())  # one row per edge type
        module = parsed.groupBy(F.col("path").alias("file")).agg(F.max("module").alias("module"))
        store.upsert_files(fresh.join(module, "file", "left").select("file", "sha", "lang", "module", "is_test"))
        chunks = chunk_rows(symbols.join(fresh.select("file", "is_test"), "file"), fresh, repo_id)
        vectors = embedded(chunks.withColumn("input", X.embedding_input("content")), "id", "input", provider)
        # A text that the provider refuses as too large comes back in pieces, which become chunks of their own.
        full = chunks.join(vectors, "id")
        cut = F.col("pieces") > 1
        full = full.withColumn("content", F.when(cut, F.col("piece")).otherwise(F.col("content"))).withColumn("id", F.when(cut, F.concat_ws("-", "id", "nth")).otherwise(F.col("id")))
        store.insert_chunks(full.drop("nth", "pieces", "piece"), dim)
        counts["tests_source"] = store.materialize_tests()
    changes.unpersist()
    return {"added": 0, "changed": 0, "removed": 0} | counts | {"symbols": store.symbols.count(), "edges": store.edges.count(), "chunks": store.chunks.filter(F.col("repo_id") == repo_id).count(), "forced": int(force)}
