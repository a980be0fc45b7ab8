"""Each query of the engine against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from bandweave import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name, tmp_path):
    queries.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    assert name in queries.ORACLE
    db.execute(f"create or replace temp table a as select * from '{tmp_path}/out/*.parquet'")
    db.execute(f"create or replace temp table b as {queries.ORACLE[name]}")
    columns = ", ".join(f'"{c[0]}"' for c in db.execute("select column_name from (describe a) order by 1").fetchall())
    for x, y in (("a", "b"), ("b", "a")):
        assert db.execute(f"select {columns} from {x} except all select {columns} from {y} limit 3").fetchall() == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 52
    assert set(entry.oracle_sql()) <= set(entry.queries())
