"""Driver contract: entry() runs; every registered query matches its DuckDB
oracle on sf0.001 (the driver does the same at sf0.01)."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from clausewise.sources.tables import TABLES

from conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v if math.isinf(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "standard_ratio" in df.columns


def test_every_query_has_a_check():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(frame, con, name):
    df = frame(name)
    cols = sorted(df.columns)
    mine = Counter(tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect())
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = {c: i for i, c in enumerate(rel.columns)}
    theirs = Counter(tuple(_norm(r[idx[c]]) for c in cols) for r in rel.fetchall())
    assert mine == theirs
