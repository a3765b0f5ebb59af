import os

import duckdb
import pytest

import __spark_entry__ as entry
from txscore.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def same(spark, name, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[p]) for p in places) for r in found.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.oracle_sql()])
def test_oracle(spark, name):
    same(spark, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry_and_stats(spark):
    assert entry.entry(spark).count() == 1000
    rows = entry.queries()["probe_stats"](spark, SF).collect()
    assert sum(r.queries for r in rows) == 1000
    leaves = entry.queries()["index_leaves"](spark, SF).collect()
    assert sum(r.n for r in leaves) == 1000 and max(r.n for r in leaves) <= 256
