"""Every registered query beside its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
NAMES = [n for m in entry.MODULES if not m.__name__.startswith("loglattice.llm") for n in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        return f"{v:.6f}" if isinstance(v, float) else repr(v)

    return sorted("|".join(show(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    if name not in entry.oracle_sql():
        assert got.columns
        return
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert canon(got.columns, rows) == canon(columns, cur.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(n in entry.queries() for n in ("p1_found", "p2_found", "p4_found", "p5_found"))


def test_entry(spark):
    assert entry.entry(spark).columns == ["measure", "heavy_key"]
