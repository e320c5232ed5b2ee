"""Every query with a SQL twin agrees with DuckDB on the smallest data; the others run and keep their schema."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from tidemark import queries as memory  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(memory.queries()))
def test_query(spark, duck, name):
    got = memory.queries()[name](spark, DATA)
    found = got.collect()
    if name not in memory.oracle_sql():
        assert got.columns
        return
    cursor = duck.execute(memory.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, found) == rows(columns, cursor.fetchall())
