"""All registered queries of the time-series operators and their DuckDB SQL."""

from __future__ import annotations

from tidemark.plans import event_queries, grid_queries, ingest_queries, model_queries, relational_queries
from tidemark.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "regrid_linear_10min"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "event_queries", "grid_queries", "ingest_queries", "model_queries", "relational_queries"]
