"""A log lake built on Spark DataFrames.

Two streams, ``logs`` and ``events``, are normalised into flat string records, landed as
row-oriented *raw* objects, compacted into Parquet, and queried through one ``SOURCES`` view.
Everything is DataFrame and SQL expressions: no Python code runs per row.
"""

from logtarn.operators.cloudevents import normalize_events
from logtarn.operators.logs import normalize_logs
from logtarn.plans.inspect import available_dates, dataset_schema, schema_profile
from logtarn.plans.query import dump, json_rows, query
from logtarn.plans.reports import REPORTS, run_report
from logtarn.sources.lake import Lake
from logtarn.streaming.compaction import compact_stream
from logtarn.streaming.ingest import ingest_stream

__all__ = [
    "Lake",
    "REPORTS",
    "available_dates",
    "compact_stream",
    "dataset_schema",
    "dump",
    "ingest_stream",
    "json_rows",
    "normalize_events",
    "normalize_logs",
    "query",
    "run_report",
    "schema_profile",
]
