"""Lookups, listings, searches and table changes over a catalog, with optional predicates.

Reads return DataFrames with a total order where they are cut; changes rewrite snapshots.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from srcquarry.catalog import Catalog
from srcquarry.functions import paths as P, python as Y, text as X
from srcquarry.operators import changes as C, graph as G, ranking as K, rows as R

TYPE_KINDS = ["class", "interface", "enum", "record", "struct", "type", "type_alias", "trait"]


def conditions(**parts: Column | None) -> Column:
    """Conjunction of the predicates that are given."""
    return reduce(lambda a, b: a & b, (p for p in parts.values() if p is not None), F.lit(True))


def equal(column: str, value: Any) -> Column | None:
    return None if value in (None, "") else F.col(column) == value


class Store(Catalog):
    """A catalog with the operations of a code-intelligence store."""

    # ---- symbols, files, edges
    def symbol(self, id: str) -> DataFrame:
        return self.symbols.filter(F.col("id") == id).limit(1)

    def symbols_by_file(self, file: str) -> DataFrame:
        return self.symbols.filter(F.col("file") == file).orderBy("start_line", "id")

    def symbols_by_fq(self, fq: str) -> DataFrame:
        return self.symbols.filter(F.col("fq_name") == fq).orderBy("file", "start_line", "id")

    def symbols_by_fq_substring(self, needle: str, limit: int = 50) -> DataFrame:
        return R.page(self.symbols.filter(F.contains(F.lower("fq_name"), F.lit(needle.lower()))), [F.col("fq_name"), F.col("id")], limit)

    def types_by_simple_name(self, name: str, limit: int = 20) -> DataFrame:
        """Types named X or p.X; ``_`` and ``%`` in the name are wildcards, as in LIKE."""
        hit = F.lower("kind").isin(TYPE_KINDS) & ((F.col("fq_name") == name) | F.col("fq_name").like("%." + name))
        return R.page(self.symbols.filter(hit), [F.length("fq_name"), F.col("fq_name"), F.col("id")], limit, default=20, most=100)

    def symbols_by_lang(self, lang: str, kind: str | None = None) -> DataFrame:
        return self.symbols.filter(conditions(lang=equal("lang", lang), kind=equal("kind", kind)))

    def symbols_by_test(self, lang: str, kind: str, is_test: bool) -> DataFrame:
        s = self.symbols.filter((F.lower("lang") == lang.lower()) & (F.col("kind") == kind) & ~P.is_declaration("file"))
        return s.join(self.files.filter(F.col("is_test") == is_test).select("file"), "file", "left_semi")

    def list_files(self, lang: str | None = None, is_test: bool | None = None) -> DataFrame:
        return self.files.filter(conditions(lang=equal("lang", lang), test=None if is_test is None else F.col("is_test") == is_test)).orderBy("file")

    def edges_from(self, id: str) -> DataFrame:
        return self.edges.filter(F.col("caller_symbol_id") == id)

    def edges_to(self, id: str) -> DataFrame:
        return self.edges.filter(F.col("callee_symbol_id") == id)

    # ---- chunks
    def _chunk_filter(self, file=None, prefix=None, symbol=None, parent=None, repo=None, chunk_type=None, lang=None, module=None, contains: dict | None = None) -> Column:
        if file and prefix:
            raise ValueError("either a file or a prefix")
        return conditions(
            file=equal("file", file), prefix=F.startswith("file", F.lit(prefix)) if prefix else None, symbol=equal("symbol_id", symbol), parent=equal("parent_symbol_id", parent),
            repo=equal("repo_id", repo), type=equal("chunk_type", chunk_type), lang=equal("lang", lang),
            module=None if not module else F.coalesce(F.get_json_object("chunk_metadata", "$.module"), F.lit("")) == module,
            contains=Y.json_contains("chunk_metadata", contains) if contains else None,
        )

    def list_chunks(self, limit: int = 0, **options) -> DataFrame:
        """Chunks by optional predicates in file and line order; a limit of 0 is none."""
        c = self.chunks.filter(self._chunk_filter(**options)).orderBy("file", "start_line", "id")
        return c.limit(limit) if limit > 0 else c

    def search(self, query: list[float], k: int = 10, **options) -> DataFrame:
        """The k chunks nearest to a vector by L2, after the predicates; the distance is computed before contents are read."""
        c = self.chunks.filter(self._chunk_filter(**options))
        if not c.filter(F.size("embedding") != len(query)).limit(1).isEmpty():
            raise ValueError(f"stored vectors are not of dimension {len(query)}")
        near = K.nearest(c.select("id", "embedding"), query, k, None, "id").select("id", "distance")
        return self.chunks.join(near, "id").orderBy("distance", "id")

    def insert_chunks(self, rows: DataFrame, dim: int) -> None:
        self.write("chunks", C.same_dimension(rows, dim), "append")

    def delete_chunks(self, file: str | None = None, repo: str | None = None) -> None:
        gone = conditions(file=equal("file", file), repo=equal("repo_id", repo))
        self.write("chunks", self.chunks.filter(~F.coalesce(gone, F.lit(False))))

    def align(self, dim: int, provider: str = "", model: str = "") -> None:
        """Keep the chunk table if it has the dimension, else empty it; the provider record follows."""
        self.write("chunks", C.realign(self.chunks, dim))
        self.write("embedding_provider", self.spark.createDataFrame([(1, provider, model, dim)], self.embedding_provider.schema))

    # ---- runs, audit
    def list_runs(self, repo=None, status=None, since=None, until=None, scheduled=False, limit=50, offset=0) -> tuple[DataFrame, int]:
        """(page, number of all): newest first, or by schedule for scheduled runs."""
        r = self.index_runs.filter(conditions(
            repo=equal("repo_id", repo), status=None if not status else F.lower(F.trim("status")) == status.lower(), since=None if since is None else F.col("started_at") >= since,
            until=None if until is None else F.col("started_at") <= until, scheduled=F.col("scheduled_rerun_at") > 0 if scheduled else None,
        ))
        order = [F.col("scheduled_rerun_at"), F.col("run_id")] if scheduled else [F.desc("started_at"), F.col("run_id")]
        return R.page(r, order, limit, offset), r.count()

    def due(self, now: int) -> DataFrame:
        return self.index_runs.filter((F.col("scheduled_rerun_at") > 0) & (F.col("scheduled_rerun_at") <= now))

    def list_audit(self, run=None, since=None, until=None, after: int = 0, limit: int = 10_000) -> DataFrame:
        a = self.audit_log.filter(conditions(run=equal("run_id", run), since=None if since is None else F.col("logged_at") >= since, until=None if until is None else F.col("logged_at") <= until))
        return R.after(a, F.col("id"), after, limit)

    # ---- changes
    def upsert_files(self, rows: DataFrame) -> None:
        both = self.files.withColumn("seq", F.lit(1)).unionByName(rows.withColumn("seq", F.lit(2)))
        self.write("files", R.latest(both, ["file"], [F.desc("seq"), F.col("sha")]))

    def insert_symbols(self, rows: DataFrame) -> None:
        self.write("symbols", C.insert_ignore(self.symbols, rows.select(*self.symbols.columns), ["id"]))

    def insert_edges(self, rows: DataFrame) -> None:
        self.write("edges", C.insert_ignore(self.edges, rows.select(*self.edges.columns), self.edges.columns))

    def delete_files(self, gone: DataFrame) -> None:
        """Files with their symbols, edges at both ends, and chunks."""
        symbols, edges = C.delete_files(self.symbols, self.edges, gone)
        self.write("edges", edges)
        self.write("symbols", symbols)
        self.write("chunks", self.chunks.join(gone.select("file").distinct(), "file", "left_anti"))
        self.write("files", self.files.join(gone.select("file").distinct(), "file", "left_anti"))

    def materialize_tests(self) -> int:
        """Replace the TESTS_SOURCE edges by derived ones; returns their number."""
        new = G.tests_source(self.edges, self.symbols, self.files).withColumn("edge_type", F.lit("TESTS_SOURCE"))
        self.write("edges", self.edges.filter(X.canonical_edge_type("edge_type") != "TESTS_SOURCE").unionByName(new).distinct())
        return self.edges.filter("edge_type = 'TESTS_SOURCE'").count()
