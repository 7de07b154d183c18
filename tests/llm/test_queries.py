"""The registered queries over the smallest test data."""

import os

import pytest

from srcquarry.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id"], "p2_found": ["id_a", "id_b"], "p3_found": ["id_a", "id_b"], "p4_found": ["file"], "p5_found": ["file", "start_line"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    n = df.count()
    assert n > 0
    if name.endswith("_found"):
        assert df.distinct().count() == n
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for t in ("chunks", "chunk_limits"):
            c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = c.sql(SQL[name])
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
