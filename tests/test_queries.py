"""Every engine query against its DuckDB SQL."""

import math
import os

import duckdb
import numpy as np
import pytest

from myospark import file_queries, queries

QUERIES, ORACLES = queries.QUERIES | file_queries.QUERIES, queries.ORACLES | file_queries.ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "nan"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return repr(round(float(x), 6) + 0.0) if isinstance(x, (float, np.floating)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted("|".join(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "embeddings", "events", "lineitem", "orders", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
