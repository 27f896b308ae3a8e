"""Sinks, compaction and the tiers of the lake."""

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.catalog.derive import (
    EVENTS_SQL,
    LAKE_LOGS_SQL,
    LOGS_SQL,
    http_requests,
    log_input,
    syslog_lines,
)
from logtarn.catalog.event_queries import EXPECTED_FIELDS, member
from logtarn.catalog.log_queries import FOUND_FIELDS_SQL, ROOT_FIELDS, failed
from logtarn.catalog.registry import catalogued
from logtarn.operators.cloudevents import normalize_events
from logtarn.operators.compact import compact_lines, compact_raw, read_quarantine
from logtarn.operators.logs import normalize_logs
from logtarn.operators.relay import allow_listed
from logtarn.plans.inspect import schema_profile
from logtarn.session import work_area
from logtarn.sources.lake import (
    Lake,
    read_compacted,
    read_raw,
    read_raw_lines,
    read_status,
    sources,
)
from logtarn.sources.sinks import with_raw_partition, write_raw, write_result
from logtarn.streaming.compaction import compact_stream
from logtarn.streaming.ingest import ingest_stream

#: Derived records of earlier days are compacted, those from this day on are still raw.
FIRST_RECENT_DAY = "2024-01-16"


def lake_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_logs(allow_listed(log_input(spark, sf_dir)))


def lake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(http_requests(spark, sf_dir))


def two_tier_lake(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake with both streams, the older days compacted; written once per application."""
    return _two_tier_lake(spark.sparkContext.applicationId, sf_dir)


@cache
def _two_tier_lake(application: str, sf_dir: str) -> Lake:
    spark = SparkSession.active()
    lake = Lake(work_area(spark, "lake"))
    for stream, records in (
        ("logs", lake_logs(spark, sf_dir)), ("events", lake_events(spark, sf_dir))
    ):
        dated = with_raw_partition(records)
        write_raw(dated.where(F.col("date") < FIRST_RECENT_DAY), lake.raw(stream), "older")
        compact_raw(spark, lake, stream, "first")
        write_raw(dated.where(F.col("date") >= FIRST_RECENT_DAY), lake.raw(stream), "newer")
    return lake


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT {FOUND_FIELDS_SQL}, failed, CAST(event_id AS VARCHAR) AS event_id,
  strftime(event_time, '%Y-%m-%d') AS date, strftime(event_time, '%H') AS hour
FROM lake""")
def raw_roundtrip_logs(spark, sf_dir):
    """Log records through the raw tier: NDJSON by day and hour, with an extra field."""
    lake = Lake(work_area(spark, "raw-logs"))
    write_raw(lake_logs(spark, sf_dir), lake.raw("logs"), "all")
    return read_raw(spark, lake, "logs", extra_fields=("event_id",)).select(
        *ROOT_FIELDS, failed(), "event_id", F.col("date").cast("string").alias("date"), "hour"
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT {', '.join(EXPECTED_FIELDS)}, data_k, strftime(event_time, '%Y-%m-%d') AS date,
  strftime(event_time, '%H') AS hour
FROM expected""")
def raw_roundtrip_events(spark, sf_dir):
    """Event records through the raw tier."""
    lake = Lake(work_area(spark, "raw-events"))
    write_raw(lake_events(spark, sf_dir), lake.raw("events"), "all")
    return read_raw(spark, lake, "events", extra_fields=("source_type",)).select(
        *EXPECTED_FIELDS, member("cloudevent", "data.k", "data_k"),
        F.col("date").cast("string").alias("date"), "hour",
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT {FOUND_FIELDS_SQL}, failed, CAST(event_id AS VARCHAR) AS payload_event_id,
  service AS payload_service, strftime(event_time, '%Y-%m-%d') AS date
FROM lake""")
def compacted_roundtrip(spark, sf_dir):
    """Log records through raw tier and compaction; unknown fields live on in the payload."""
    lake = Lake(work_area(spark, "compacted"))
    write_raw(lake_logs(spark, sf_dir), lake.raw("logs"), "all")
    compact_raw(spark, lake, "logs", "all")
    return read_compacted(spark, lake, "logs").select(
        *ROOT_FIELDS, failed(), member("payload_json", "event_id", "payload_event_id"),
        member("payload_json", "service", "payload_service"),
        F.col("date").cast("string").alias("date"),
    )


def flawed_objects(spark, sf_dir, mended: bool = False, write: bool = True):
    """A lake of raw objects, one per day and slot; slots 3 and 5 hold bad lines among good ones.

    In slot 3 every error record has a number for ``node_id``; in slot 5 the records of users
    divisible by 20 are cut short. ``mended`` gives the lines without these faults; with ``write``
    off, the lines themselves.
    """
    lake = Lake(work_area(spark, "flawed"))
    slot = F.col("event_id") % 8
    records = log_input(spark, sf_dir, "user_id", "event_type")
    odd_type = (slot == 3) & (F.col("event_type") == "error")
    line = F.to_json(F.struct(F.col("timestamp").alias("ts"), F.col("appname").alias("service"),
                              F.col("severity").alias("level"), F.col("message").alias("msg"), "event_id"))
    cut = F.substring(line, F.lit(1), F.length(line) - 1)
    value = (
        F.when(odd_type, F.concat(cut, F.lit(',"node_id":7}')))
        .when((slot == 5) & (F.col("user_id") % 20 == 0), cut)
        .otherwise(line)
    )
    objects = records.select(
        (line if mended else value).alias("value"), F.substring("timestamp", 1, 10).alias("date"), slot.alias("slot")
    )
    if not write:
        return objects
    # One object per day and slot, so that it is known which lines share an object.
    objects.repartition("date", "slot").write.partitionBy("date", "slot").text(lake.raw("logs"))
    return lake


OBJECTS_SQL = f"""{LOGS_SQL},
lines AS (
  SELECT *, strftime(event_time, '%Y-%m-%d') AS date, event_id % 8 AS slot,
    CASE WHEN event_id % 8 = 3 AND event_type = 'error' THEN 'field node_id is not text'
      WHEN event_id % 8 = 5 AND user_id % 20 = 0 THEN 'not one JSON object' END AS reason
  FROM found
),
objects AS (
  SELECT date, slot, count(*) AS lines, count(reason) AS bad_lines FROM lines GROUP BY 1, 2
)"""


def object_key():
    path = F.col("source_file")
    return [
        F.regexp_extract(path, r"date=([0-9-]+)", 1).alias("date"),
        F.regexp_extract(path, r"slot=(\d+)", 1).cast("bigint").alias("slot"),
    ]


@catalogued(f"""
WITH {OBJECTS_SQL},
rejected AS (
  SELECT date, slot, coalesce(reason, '') AS reason, count(*) AS quarantined
  FROM lines JOIN objects USING (date, slot) WHERE objects.bad_lines > 0 GROUP BY 1, 2, 3
)
SELECT date, slot, lines, bad_lines, CASE WHEN bad_lines = 0 THEN lines ELSE 0 END AS stored,
  coalesce(sum(quarantined), 0)::BIGINT AS quarantined,
  coalesce(max(CASE WHEN reason <> '' THEN reason END), '') AS reason
FROM objects LEFT JOIN rejected USING (date, slot) GROUP BY ALL""")
def compact_quarantine(spark, sf_dir):
    """All or nothing per object: what was stored and what was set aside, object by object."""
    lake = flawed_objects(spark, sf_dir)
    compact_raw(spark, lake, "logs", "all")
    status = read_status(spark, lake, "logs").select(*object_key(), "lines", "bad_lines")
    stored = (
        read_compacted(spark, lake, "logs", extra_fields=("source_file",))
        .groupBy(*object_key()).agg(F.count(F.lit(1)).alias("stored"))
    )
    rejected = (
        read_quarantine(spark, lake, "logs")
        .groupBy(*object_key())
        .agg(F.count(F.lit(1)).alias("quarantined"), F.max("reason").alias("reason"))
    )
    return (
        status.join(stored, ["date", "slot"], "left")
        .join(rejected, ["date", "slot"], "left")
        .fillna({"stored": 0, "quarantined": 0, "reason": ""})
    )


@catalogued(f"""
WITH {OBJECTS_SQL}
SELECT slot, count(*) AS lines, count(*) - count(reason) AS stored, count(reason) AS quarantined
FROM lines GROUP BY 1""")
def compact_salvage(spark, sf_dir):
    """Line by line instead: sound lines of flawed objects are stored as well."""
    lake = flawed_objects(spark, sf_dir)
    compact_raw(spark, lake, "logs", "all", salvage=True)
    counts = (
        read_compacted(spark, lake, "logs", extra_fields=("source_file",))
        .select(*object_key(), F.lit(1).alias("stored"), F.lit(0).alias("quarantined"))
        .unionByName(
            read_quarantine(spark, lake, "logs").select(
                *object_key(), F.lit(0).alias("stored"), F.lit(1).alias("quarantined")
            )
        )
    )
    return counts.groupBy("slot").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("stored").alias("stored"),
        F.sum("quarantined").alias("quarantined"),
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL},
days AS (SELECT strftime(event_time, '%Y-%m-%d') AS date, count(*) AS records FROM lake GROUP BY 1)
SELECT run, date, records FROM days, (VALUES ('first'), ('second'), ('repeated')) AS runs(run)""")
def compact_replay(spark, sf_dir):
    """Rows per day after one run of the compaction job, a second run, and a repeated batch."""
    lake = Lake(work_area(spark, "replay"))
    write_raw(lake_logs(spark, sf_dir), lake.raw("logs"), "all")

    def counted(run: str) -> DataFrame:
        path = work_area(spark, f"replay-{run}")
        days = read_compacted(spark, lake, "logs").groupBy(F.col("date").cast("string").alias("date"))
        days.agg(F.count(F.lit(1)).alias("records")).write.parquet(path)
        return spark.read.parquet(path).withColumn("run", F.lit(run))

    results = []
    for run in ("first", "second"):
        compact_stream(spark, lake, "logs", clean="off")
        results.append(counted(run))
    batch = spark.read.parquet(lake.compacted("logs")).select("batch").first()["batch"]
    compact_lines(read_raw_lines(spark, lake, "logs"), lake, "logs", batch)
    results.append(counted("repeated"))
    return results[0].unionByName(results[1]).unionByName(results[2])


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT {FOUND_FIELDS_SQL.replace('level,', "CASE WHEN level = 'error' THEN 'err' ELSE level END AS level,")},
  failed, strftime(event_time, '%Y-%m-%d') AS date, strftime(event_time, '%H') AS hour
FROM lake""")
def ingest_logs(spark, sf_dir):
    """Syslog lines from a landing folder to the raw tier by a streaming job."""
    landing, lake = work_area(spark, "landing-logs"), Lake(work_area(spark, "ingested-logs"))
    syslog_lines(spark, sf_dir).select("value").write.text(landing)
    ingest_stream(spark, lake, "logs", landing, available_now=True).awaitTermination()
    return read_raw(spark, lake, "logs").select(
        *ROOT_FIELDS, failed(), F.col("date").cast("string").alias("date"), "hour"
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT {', '.join(EXPECTED_FIELDS)}, data_k, strftime(event_time, '%Y-%m-%d') AS date,
  strftime(event_time, '%H') AS hour
FROM expected""")
def ingest_events(spark, sf_dir):
    """HTTP requests from a landing folder to the raw tier by a streaming job."""
    landing, lake = work_area(spark, "landing-events"), Lake(work_area(spark, "ingested-events"))
    http_requests(spark, sf_dir).drop("event_id").write.json(landing)
    ingest_stream(spark, lake, "events", landing, available_now=True).awaitTermination()
    return read_raw(spark, lake, "events", extra_fields=("source_type",)).select(
        *EXPECTED_FIELDS, member("cloudevent", "data.k", "data_k"),
        F.col("date").cast("string").alias("date"), "hour",
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT {FOUND_FIELDS_SQL}, failed, strftime(event_time, '%Y-%m-%d') AS date,
  CASE WHEN event_time < TIMESTAMP '{FIRST_RECENT_DAY}' THEN 'compacted' ELSE 'recent' END AS tier
FROM lake""")
def scope_union(spark, sf_dir):
    """Both tiers as one relation, each record once."""
    lake = two_tier_lake(spark, sf_dir)
    tier = F.when(F.col("hour").isNull(), "compacted").otherwise("recent")
    return sources(spark, lake, "logs", "all").select(
        *ROOT_FIELDS, failed(), F.col("date").cast("string").alias("date"), tier.alias("tier")
    )


@catalogued(f"""
WITH {EVENTS_SQL},
tiers AS (
  SELECT *, event_time < TIMESTAMP '{FIRST_RECENT_DAY}' AS older FROM expected
)
SELECT 'all' AS scope, parse_error, count(*) AS records FROM tiers GROUP BY 2
UNION ALL SELECT 'compacted', parse_error, count(*) FROM tiers WHERE older GROUP BY 2
UNION ALL SELECT 'recent', parse_error, count(*) FROM tiers WHERE NOT older GROUP BY 2""")
def scope_events(spark, sf_dir):
    """Event records in each scope."""
    lake = two_tier_lake(spark, sf_dir)
    frames = [
        sources(spark, lake, "events", scope).groupBy("parse_error")
        .agg(F.count(F.lit(1)).alias("records")).withColumn("scope", F.lit(scope))
        for scope in ("all", "compacted", "recent")
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


EXPORT_SQL = f"""
WITH {LAKE_LOGS_SQL}
SELECT ts, service, level, msg, trace_id, request_uri FROM lake"""


def _export(spark, sf_dir) -> DataFrame:
    return sources(spark, two_tier_lake(spark, sf_dir), "logs").select(
        "ts", "service", "level", "msg", "trace_id", "request_uri"
    )


@catalogued(EXPORT_SQL)
def result_ndjson(spark, sf_dir):
    """A result exported as NDJSON and read back."""
    result, path = _export(spark, sf_dir), work_area(spark, "ndjson")
    write_result(result, path, "ndjson")
    return spark.read.schema(result.schema).json(path)


@catalogued(EXPORT_SQL)
def result_csv(spark, sf_dir):
    """A result exported as CSV and read back."""
    result, path = _export(spark, sf_dir), work_area(spark, "csv")
    write_result(result, path, "csv")
    return spark.read.schema(result.schema).options(
        header="true", quote='"', escape='"', multiLine="true"
    ).csv(path)


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT ts || chr(9) || service || chr(9) || level || chr(9) || replace(msg, '\\', '\\\\') || chr(9)
  || coalesce(trace_id, '') || chr(9) || coalesce(request_uri, '') AS value
FROM lake""")
def result_text(spark, sf_dir):
    """A result exported as tab-separated text and read back."""
    path = work_area(spark, "text")
    write_result(_export(spark, sf_dir), path, "text")
    return spark.read.text(path)


def _profile_row(field: str, types: str, present: str = "count(*)", nulls: str = "0") -> str:
    return (
        f"SELECT '{field}' AS field, '{types}' AS types, {present} AS records, "
        f"CAST({nulls} AS BIGINT) AS nulls FROM lake"
    )


PROFILE_SQL = f"WITH {LAKE_LOGS_SQL} " + " UNION ALL ".join([
    _profile_row("event_id", "BIGINT"),
    *[_profile_row(f, "STRING") for f in ("ts", "service", "host", "level", "msg", "data")],
    *[
        _profile_row(f, "STRING", nulls=f"sum(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END)")
        for f in ("xname", "node_id", "trace_id", "request_id", "request_uri")
    ],
    *[_profile_row(f, "", nulls="count(*)") for f in ("component_id", "request_user")],
    _profile_row("parse_error", "STRING", nulls="sum(CASE WHEN failed THEN 0 ELSE 1 END)"),
])


@catalogued(PROFILE_SQL)
def inspect_schema_profile(spark, sf_dir):
    """Fields, types and nulls found in the raw objects."""
    lake = Lake(work_area(spark, "profile"))
    write_raw(lake_logs(spark, sf_dir), lake.raw("logs"), "all")
    return schema_profile(read_raw_lines(spark, lake, "logs"))
