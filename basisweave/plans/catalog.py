"""Where queries register: a name, the Spark plan and, where SQL can express it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL_BY_QUERY: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL_BY_QUERY[name] = sql
        return f

    return add


def r(c: str | Column, digits: int = 4) -> Column:
    """Rounded under its own name: sums of doubles come in any order."""
    if isinstance(c, str):
        return F.round(c, digits).alias(c)
    return F.round(c, digits)
