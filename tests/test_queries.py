"""Every registered chart query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

from tracewright.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(x) if not isinstance(x, (int, float)) else "", x if isinstance(x, (int, float)) else 0) for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    got = sorted((tuple(clean(r[c]) for c in want.columns) for r in df.collect()), key=_key)
    assert got == sorted(want.fetchall(), key=_key)


def test_flagship_and_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 * 30
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) <= set(e.queries())
