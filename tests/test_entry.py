"""The driver's contract: each query runs, and equals its SQL where there is some."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslab.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return repr(float(v)) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
