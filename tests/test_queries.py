"""Every query with SQL against DuckDB on the smallest tables, the others for a result at all."""

import math
import numbers
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from basisweave.plans.registry import ORACLE_SQL_BY_QUERY, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def canonical(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, numbers.Real):
        return f"{float(v):.9g}" if abs(v) > 1e-9 else "0"
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(canonical(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF)).toPandas()
    if name in ORACLE_SQL_BY_QUERY:
        assert rows(got) == rows(duck.sql(ORACLE_SQL_BY_QUERY[name]).df())
    else:
        assert len(got.columns) > 1
