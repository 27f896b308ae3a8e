"""Runnable queries over the given tables, each with the SQL that must give the same rows."""

from logtarn.catalog import (  # noqa: F401
    event_queries,
    hard_queries,
    lake_queries,
    log_queries,
    report_queries,
)
from logtarn.catalog import state_queries  # noqa: E402, F401, isort: skip
from logtarn.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
