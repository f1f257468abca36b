"""Every registered query against its SQL in another engine, on the smallest tables."""

import math

import duckdb
import pytest

from queuelake.operators import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, other, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    rows = df.collect()
    if not q.sql:
        return
    got = other.execute(q.sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want
