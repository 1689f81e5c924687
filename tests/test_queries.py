"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from gridloom.plans import registry

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.01")


def tidy(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=repr), sorted(columns)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query(spark, oracle, name):
    frame = registry.QUERIES[name](spark, SF)
    got = rows_of(frame.columns, frame.collect())
    found = oracle.execute(registry.ORACLE_SQL[name])
    want = rows_of([d[0] for d in found.description], found.fetchall())
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0])
    assert got[0] == want[0]
    assert got[0]
