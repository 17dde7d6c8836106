"""Every core query runs on the smallest tables and equals its SQL."""

import os

import duckdb
import pytest

from strataloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return c


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    rows = sorted(tuple(plain(r[i]) for i in order) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall()) == rows


def test_entry_points_are_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p4_found" in entry.queries()
