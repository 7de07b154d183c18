"""Every registered query with SQL against DuckDB at the smallest scale, if the test data is there."""

import ast
import os
import pathlib

import pytest

import __spark_entry__ as e
from srcquarry.plans import registry

CORE, CORE_SQL = registry()
DATA = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def rows(frame):
    def cell(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 6))
        return str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_query_equals_sql(spark, con, name):
    df = CORE[name](spark, DATA)
    sql = con.sql(CORE_SQL[name])
    assert {f.name: KINDS.get(f.dataType.simpleString()) for f in df.schema} == dict(zip(sql.columns, map(str, sql.types)))
    assert rows(df.toPandas()) == rows(sql.df())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL)))
def test_query_without_sql_runs(spark, con, name):
    df = CORE[name](spark, DATA)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark, con):
    assert e.entry(spark).count() > 0
    assert set(CORE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_the_training_data_subpackage():
    root = pathlib.Path(e.__file__).parent / "srcquarry"
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] == "llm":
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("srcquarry.llm") for n in names), p
