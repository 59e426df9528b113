"""The driver's contract: every query runs, and equals its SQL where it has any."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans import catalogue, round_trips  # noqa: F401  the second adds to the first's queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows, sql = df.collect(), catalogue.ORACLES.get(name)
    if sql is None:
        return
    got = db.execute(sql)
    cols, want = [c[0] for c in got.description], got.fetchall()
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    assert sorted((tuple(clean(r[c]) for c in order) for r in rows), key=str) == sorted((tuple(clean(r[cols.index(c)]) for c in order) for r in want), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
