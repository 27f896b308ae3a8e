"""Periodic compaction: raw tier to compacted tier."""

from pyspark.sql import SparkSession

from logtarn.operators.compact import clear_compacted, compact_raw
from logtarn.operators.merge import merge_small
from logtarn.schemas import STREAMS
from logtarn.sources.lake import Lake

CLEAN_MODES = ("archive", "delete", "off")


def compact_stream(
    spark: SparkSession,
    lake: Lake,
    stream: str,
    clean: str = "archive",
    salvage: bool = False,
    merge: bool = True,
) -> None:
    """Compact the raw objects of a stream that are not compacted yet.

    Objects that earlier runs have compacted are cleared away first, those of this run by the next:
    queries that began before it can go on reading them. With ``merge``, small files that several
    runs have left for a day are then put together.
    """
    if clean not in CLEAN_MODES:
        raise ValueError(f"unknown clean mode: {clean!r}, expected one of {CLEAN_MODES}")
    if clean != "off":
        clear_compacted(spark, lake, stream, archive=clean == "archive")
    compact_raw(spark, lake, stream, salvage=salvage)
    if merge:
        merge_small(spark, lake, stream)


def run_compaction(spark: SparkSession, lake: Lake, **options) -> None:
    """One run over both streams; the first failure ends it. An empty stream is skipped."""
    for stream in STREAMS:
        compact_stream(spark, lake, stream, **options)
