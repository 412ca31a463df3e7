"""Every registered query on the smallest tables, and those with an SQL text against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") and v is not None else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("p8")))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    if name in ORACLES:
        r = db.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, r.fetchall())


def test_smoke(spark):
    assert entry.entry(spark).count() > 0
