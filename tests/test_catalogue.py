"""Every query with SQL against that SQL."""

import math
import os
import sys

import pytest

from keyloom.plans import catalogue

D = "/root/testdata/sf0.001"
for place in ("/opt/oracle",):
    if os.path.isdir(place):
        sys.path.append(place)
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{D}/{f}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    r = con.execute(catalogue.ORACLE_SQL[name])
    theirs = [x[0] for x in r.description]
    assert sorted(theirs) == cols
    want = sorted(str([plain(x[theirs.index(c)]) for c in cols]) for x in r.fetchall())
    assert got == want


def test_without_sql(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, D).count() > 0
