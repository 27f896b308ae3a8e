"""Runs that die, writers of several kinds, and what the lake keeps by run."""

import json

from pyspark.sql import functions as F

from logtarn.catalog.derive import LAKE_LOGS_SQL, LOGS_SQL, log_input
from logtarn.catalog.lake_queries import (
    OBJECTS_SQL,
    flawed_objects,
    lake_logs,
    object_key,
    two_tier_lake,
)
from logtarn.catalog.registry import ORACLES, catalogued
from logtarn.operators.compact import compact_raw, read_quarantine, retry_quarantine
from logtarn.operators.merge import merge_small, stored_sizes
from logtarn.operators.relay import ALLOWED_SERVICES, allow_listed_by, read_allow_list
from logtarn.plans import totals
from logtarn.plans.query import query
from logtarn.session import work_area
from logtarn.sources.lake import CATALOGUED, Lake, catalogue_fields, read_compacted, read_raw
from logtarn.sources.marks import marks, put_mark
from logtarn.sources.sinks import write_raw

STORED_AND_SET_ASIDE = f"""
WITH {OBJECTS_SQL}
SELECT slot, count(*) AS lines, count(*) - count(reason) AS stored, count(reason) AS quarantined
FROM lines GROUP BY 1"""


def _stored_and_set_aside(spark, lake):
    stored = read_compacted(spark, lake, "logs", extra_fields=("source_file",))
    rejected = read_quarantine(spark, lake, "logs")
    found = stored.select(*object_key(), F.lit(1).alias("stored")).unionByName(
        rejected.select(*object_key(), F.lit(0).alias("stored"))
    )
    return found.groupBy("slot").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("stored").alias("stored"),
        F.sum(1 - F.col("stored")).alias("quarantined"),
    )


@catalogued(STORED_AND_SET_ASIDE)
def salvage_crash(spark, sf_dir):
    """A salvaging run dies before its last step, one of the other kind makes it good, and the lines
    that this rejects are salvaged: each line once."""
    lake = flawed_objects(spark, sf_dir)
    compact_raw(spark, lake, "logs", "dead", salvage=True)
    put_mark(spark, lake.attempts("logs"), "dead")
    compact_raw(spark, lake, "logs", "whole objects")
    compact_raw(spark, lake, "logs", "lines", salvage=True)
    return _stored_and_set_aside(spark, lake)


@catalogued(STORED_AND_SET_ASIDE)
def retry_crash(spark, sf_dir):
    """A retry of what was set aside dies before its last step and is made twice more: each line once."""
    lake = flawed_objects(spark, sf_dir)
    compact_raw(spark, lake, "logs", "first", salvage=True)
    retry_quarantine(spark, lake, "logs")
    (dead,) = marks(spark, lake.replaced("logs"))
    put_mark(spark, lake.attempts("logs"), dead)
    for _ in range(2):
        retry_quarantine(spark, lake, "logs")
    return _stored_and_set_aside(spark, lake)


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT ts, service, level, CASE WHEN event_id % 3 = 0 THEN 'json.gz' ELSE 'ndjson.zst' END AS kind,
  strftime(event_time, '%Y-%m-%d') AS date, strftime(event_time, '%H') AS hour
FROM lake""")
def raw_codecs(spark, sf_dir):
    """Objects of two codecs in the same folders, each record from an object of its kind."""
    lake, records = Lake(work_area(spark, "codecs")), lake_logs(spark, sf_dir)
    write_raw(records.where("event_id % 3 > 0"), lake.raw("logs"), "zstd")
    write_raw(records.where("event_id % 3 = 0"), lake.raw("logs"), "gzip", compression="gzip")
    kind = F.regexp_extract("source_file", r"\.((?:nd)?json\.\w+)$", 1)
    return read_raw(spark, lake, "logs", extra_fields=("source_file",)).select(
        "ts", "service", "level", kind.alias("kind"), F.col("date").cast("string").alias("date"), "hour"
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT strftime(event_time, '%Y-%m-%d') AS date, count(*) AS records, sum(event_id)::BIGINT AS ids,
  CAST(1 AS BIGINT) AS files
FROM lake GROUP BY 1""")
def merged_runs(spark, sf_dir):
    """Four runs over the same days, merged: one file for each day, each record once."""
    lake, records = Lake(work_area(spark, "merged")), lake_logs(spark, sf_dir)
    for run in range(4):
        # A day's records in one object: this is about the compacted files.
        part = records.where(F.col("event_id") % 4 == run).withColumns({
            "date": F.substring("ts", 1, 10), "hour": F.lit("00"),
        })
        write_raw(part, lake.raw("logs"), f"part-{run}")
        compact_raw(spark, lake, "logs", f"run{run}")
    merge_small(spark, lake, "logs")
    merge_small(spark, lake, "logs")  # deletes what the first has replaced
    files = stored_sizes(spark, lake, "logs").groupBy(F.col("day").alias("date")).agg(F.sum("files").alias("files"))
    stored = read_compacted(spark, lake, "logs", extra_fields=("event_id",))
    return stored.groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("event_id").cast("long")).alias("ids")
    ).join(files, "date")


@catalogued("""
SELECT event_id % 3 AS writer, count(*) AS records, count(*) FILTER (event_id % 3 = 0) AS user_id,
  count(*) FILTER (event_id % 3 = 1) AS kind, count(*) FILTER (event_id % 3 = 2) AS Amount
FROM events GROUP BY 1""")
def union_by_name(spark, sf_dir):
    """Three writers with fields of their own, two of them compacted; all fields are columns."""
    lake = Lake(work_area(spark, "by-name"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = ("user_id", "event_type AS kind", "coalesce(value, 0) AS Amount")
    for writer, field in enumerate(own):
        records = events.where(F.col("event_id") % 3 == writer).selectExpr(
            "date_format(ts, \"yyyy-MM-dd'T'00:00:00'Z'\") AS ts", "cast(event_id AS string) AS request_id", field
        )
        if writer < 2:
            write_raw(records, lake.raw("logs"), f"writer-{writer}")
        else:  # another program's objects
            records.select(F.to_json(F.struct("*")).alias("value")).coalesce(2).write.mode("append").text(
                f"{lake.raw('logs')}/date=2024-01-01"
            )
        if writer == 1:
            compact_raw(spark, lake, "logs", "older")
    catalogue_fields(spark, lake, "logs")
    wide = query(spark, lake, "SELECT * FROM SOURCES", extra_fields=CATALOGUED)
    return wide.groupBy((F.col("request_id").cast("long") % 3).alias("writer")).agg(
        F.count(F.lit(1)).alias("records"), *[F.count(name).alias(name) for name in ("user_id", "kind", "Amount")]
    )


@catalogued(f"""
WITH {LOGS_SQL}
SELECT service, count(*) AS records FROM found WHERE service NOT IN ('sshd', 'hydra') GROUP BY 1""")
def allowlist_table(spark, sf_dir):
    """The relay by a lookup table in which one program is switched off."""
    path = work_area(spark, "lookup")
    entries = [{"index": name, "value": "0" if name == "hydra" else "1"} for name in ALLOWED_SERVICES]
    table = json.dumps({"version": 1, "nomatch": "0", "type": "string", "table": entries})
    spark.createDataFrame([(table,)], "value string").coalesce(1).write.text(path)
    kept = allow_listed_by(log_input(spark, sf_dir), read_allow_list(spark, path), "appname")
    return kept.groupBy(F.col("appname").alias("service")).agg(F.count(F.lit(1)).alias("records"))


@catalogued(ORACLES["errors_by_service"])
def errors_by_service_totals(spark, sf_dir):
    """The report from the totals that runs keep, and the raw tier."""
    return totals.errors_by_service(spark, two_tier_lake(spark, sf_dir))


@catalogued(ORACLES["xname_groups"])
def xname_groups_totals(spark, sf_dir):
    """The report from the totals that runs keep, and the raw tier."""
    return totals.xname_groups(spark, two_tier_lake(spark, sf_dir))
