"""Every catalogued query over the smallest tables, against DuckDB where SQL can express it."""

import math
import os

import duckdb
import pytest

from chatquarry.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in key) for r in rows), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in key) for r in cur.fetchall()), key=repr)
    assert got == want
