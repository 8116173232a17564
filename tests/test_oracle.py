"""Each query of the fact operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from veritab.plans.oracle import ORACLE_SQL
from veritab.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    return f"{float(x):.10g}" if isinstance(x, float | np.floating) else str(x)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    """Of the columns that have values throughout (pandas turns integers with nulls into floats)."""
    return {c: frame[c].dtype.kind.replace("u", "i") for c in frame if len(frame) and not frame[c].isna().any()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert kinds(got) == kinds(want)
    rows = [sorted(tuple(map(plain, r)) for r in f[columns].itertuples(index=False)) for f in (got, want)]
    assert rows[0] == rows[1]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
