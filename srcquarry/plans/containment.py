"""Containment trees of symbols (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcquarry.operators import hierarchy as h


def _links(spark: SparkSession, d: str) -> DataFrame:
    return h.contains_edges(spark.read.parquet(f"{d}/edges.parquet"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return h.hierarchy(_links(spark, d)).select("symbol_id", "root_symbol_id", "depth")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path from the root of each symbol."""
    tree = h.hierarchy(_links(spark, d), keep_path=True)
    return tree.select("symbol_id", "root_symbol_id", "depth", F.array_join("path", "/").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return h.descendants(h.hierarchy(_links(spark, d), keep_path=True))


def p6_loops(spark: SparkSession, d: str) -> DataFrame:
    """Symbols on loops, with the smallest symbol of their loop."""
    links = _links(spark, d)
    return h.loops(links, h.hierarchy(links))


QUERIES = {f.__name__: f for f in (p6_found, p6_paths, p6_descendants, p6_loops)}

_TREE = r"""
    WITH RECURSIVE named AS (
        SELECT DISTINCT caller_symbol_id AS parent, callee_symbol_id AS child FROM edges WHERE upper(regexp_replace(edge_type, '^\s+|\s+$', '', 'g')) = 'CONTAINS'),
    link AS (SELECT child, min(parent) AS parent FROM named WHERE parent IS NOT NULL AND child IS NOT NULL GROUP BY 1),
    node AS (SELECT child AS id FROM named WHERE child IS NOT NULL UNION SELECT parent FROM named WHERE parent IS NOT NULL),
    tree AS (
        SELECT id AS symbol_id, id AS root_symbol_id, 0 AS depth, id AS path FROM node WHERE id NOT IN (SELECT child FROM link)
        UNION ALL
        SELECT l.child, t.root_symbol_id, t.depth + 1, t.path || '/' || l.child FROM tree t JOIN link l ON l.parent = t.symbol_id)
"""
SQL = {
    "p6_found": _TREE
    + """SELECT symbol_id, root_symbol_id, depth FROM tree
         UNION ALL SELECT id, '', -1 FROM node WHERE id NOT IN (SELECT symbol_id FROM tree)""",
    "p6_paths": _TREE
    + """SELECT symbol_id, root_symbol_id, depth, path FROM tree
         UNION ALL SELECT id, '', -1, '' FROM node WHERE id NOT IN (SELECT symbol_id FROM tree)""",
    "p6_descendants": _TREE
    + """, up AS (
            SELECT l.child AS symbol_id, l.parent AS ancestor_id, 1 AS distance FROM link l WHERE l.child IN (SELECT symbol_id FROM tree)
            UNION ALL SELECT u.symbol_id, l.parent, u.distance + 1 FROM up u JOIN link l ON l.child = u.ancestor_id)
         SELECT ancestor_id, symbol_id, distance FROM up""",
    "p6_loops": _TREE
    + """, walk AS (SELECT child AS start, parent AS node FROM link WHERE child NOT IN (SELECT symbol_id FROM tree) UNION SELECT w.start, l.parent FROM walk w JOIN link l ON l.child = w.node)
         SELECT start AS symbol_id, min(node) AS loop_id FROM walk GROUP BY start HAVING bool_or(node = start)""",
}
