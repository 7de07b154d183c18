"""Named queries with their SQL counterparts, one module per operator family."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("containment", "lookups", "joins", "aggregates", "ranks", "texts", "extras", "transitions")


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    """All core queries and the SQL of those that have one."""
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"srcquarry.plans.{name}")
        found.update(module.QUERIES)
        sql.update(module.SQL)
    return found, sql
