"""Every registered query of the document engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from paperloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.6g}"
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name in catalog.oracle_sql():
        found = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in found.description]
        want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
        assert sorted(names) == columns and rows == want
    else:
        assert rows
