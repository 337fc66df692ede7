"""The second catalogue's queries against their SQL on the smallest scale."""

import os

import duckdb
import pytest

from graphloom import catalogue_more
from graphloom.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if n in ORACLE_SQL and getattr(f, "__module__", "") == catalogue_more.__name__)


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        yield c


def plain(v):
    return float(f"{v:.6g}") if isinstance(v, float) else sorted(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(x) for x in r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str) == want
