"""All queries of the venue operators."""

from __future__ import annotations

from basisweave.plans import aggregates, features, jobs, learning, records, relational, replays, states, sweeps, trading, windows  # noqa: F401  the modules register on import
from basisweave.plans.catalog import ORACLE_SQL_BY_QUERY, QUERIES

__all__ = ["ORACLE_SQL_BY_QUERY", "QUERIES"]
