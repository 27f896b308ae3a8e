"""Totals kept by run, so that reports over all time read no records.

A run of compaction stores, besides its records, how many of them there are for each day, service,
component and kind, with the first and the last time. Rows so grouped add up: the totals of several
runs, and of the raw tier, give the very rows of the reports over all records, distinct services too.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.times import iso_text
from logtarn.plans.reports import ERROR_LEVELS
from logtarn.sources.lake import Lake, load, read_raw, unfinished
from logtarn.sources.marks import folders

#: Only logs have services and levels.
STREAM = "logs"
GROUPS = ("service", "xname", "error")
SCHEMA = "service string, xname string, error boolean, n long, first timestamp, last timestamp, date date, batch string"


def added_up(records: DataFrame) -> DataFrame:
    """The totals of records with ``date`` and ``event_ts``; partial sums before the shuffle."""
    error = F.coalesce(F.col("level").isin(*ERROR_LEVELS), F.lit(False))
    return records.groupBy("date", "service", "xname", error.alias("error")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("first"), F.max("event_ts").alias("last")
    )


def write_totals(spark: SparkSession, lake: Lake, stream: str, batch: str) -> None:
    """Store the totals of what a run has written, in place of any it has. Four columns are read."""
    if stream != STREAM:
        return
    schema = "level string, service string, xname string, event_ts timestamp, date date"
    stored = load(spark, schema, f"{lake.compacted(stream)}/batch={batch}", "parquet")
    added_up(stored).coalesce(1).write.mode("overwrite").parquet(f"{lake.totals(stream)}/batch={batch}")


def totals(spark: SparkSession, lake: Lake) -> DataFrame:
    """The totals of all complete runs and of the raw tier.

    Merged runs have none of their own: those of the runs they stand for stay right. A run without
    totals, of another program or an older lake, is an error.
    """
    begun = unfinished(spark, lake, STREAM)
    runs = {name for name in folders(spark, lake.compacted(STREAM)) if not name.startswith("batch=merge-")}
    missing = runs - {*folders(spark, lake.totals(STREAM)), *(f"batch={name}" for name in begun)}
    if missing:
        raise ValueError(f"no totals of {', '.join(sorted(missing))}")
    kept = load(spark, SCHEMA, lake.totals(STREAM), "parquet")
    kept = kept.where(~F.col("batch").isin(*begun)).drop("batch") if begun else kept.drop("batch")
    raw = read_raw(spark, lake, STREAM).withColumn("event_ts", F.col("ts").try_cast("timestamp"))
    return kept.unionByName(added_up(raw))


def errors_by_service(spark: SparkSession, lake: Lake) -> DataFrame:
    """The report of that name over all time."""
    return totals(spark, lake).where("error").groupBy("service").agg(
        F.sum("n").alias("errors"), iso_text(F.min("first")).alias("first_ts"),
        iso_text(F.max("last")).alias("last_ts"),
    )


def xname_groups(spark: SparkSession, lake: Lake) -> DataFrame:
    """The report of that name over all time."""
    return totals(spark, lake).where("xname IS NOT NULL").groupBy("xname").agg(
        F.sum("n").alias("records"), F.count_distinct("service").alias("services"),
        F.sum(F.when(F.col("error"), F.col("n")).otherwise(0)).alias("errors"),
        iso_text(F.max("last")).alias("last_ts"),
    )
