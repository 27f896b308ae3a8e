"""The lake under harder input: odd JSON, rejected and mended objects, other writers, other zones."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.catalog.derive import EVENTS_SQL, LAKE_LOGS_SQL, events_table, log_input
from logtarn.catalog.lake_queries import (
    OBJECTS_SQL,
    flawed_objects,
    lake_events,
    lake_logs,
    object_key,
    two_tier_lake,
)
from logtarn.catalog.registry import catalogued
from logtarn.functions.times import ISO_MICROS
from logtarn.operators.cloudevents import normalize_events
from logtarn.operators.compact import check_lines, compact_raw
from logtarn.operators.logs import normalize_logs
from logtarn.plans.query import dump, json_rows, payload, query
from logtarn.plans.reports import run_report
from logtarn.session import work_area
from logtarn.sources.lake import Lake, load, read_compacted, read_raw, read_status, sources
from logtarn.sources.landing import read_requests, syslog_records
from logtarn.sources.sinks import write_raw, write_result
from logtarn.schemas import strings
from logtarn.streaming.compaction import compact_stream, run_compaction

# Text by event number: what it is, how it is written, whether it is one JSON value.
_SHAPES = (
    ("object", '{"n":#}', True),
    ("single quotes", "{'n':#}", False),
    ("not a number", "NaN", False),
    ("infinite member", '{"n":#,"x":Infinity}', False),
    ("trailing text", '{"n":#} tail lost', False),
    ("two objects", '{"n":#}{"n":1}', False),
    ("array of two", '[{"n":#},{"n":1}]', True),
    ("cut short", '{"n":#', False),
)


def _shape(k: int) -> Column:
    """The text of each event, its number in place of ``#``; or a property of its shape."""
    chosen = F.get(F.array(*[F.lit(s[k]) for s in _SHAPES]), (F.col("event_id") % len(_SHAPES)).cast("int"))
    return F.replace(chosen, F.lit("#"), F.col("event_id").cast("string")) if k == 1 else chosen


def _shape_sql(k: int) -> str:
    cases = []
    for n, shape in enumerate(_SHAPES):
        value = "replace('{}', '#', CAST(event_id AS VARCHAR))".format(shape[1].replace("'", "''")) if k == 1 else str(shape[k])
        cases.append(f"WHEN {n} THEN {value}")
    return f"CASE event_id % {len(_SHAPES)} {' '.join(cases)} END"


@catalogued(f"""
SELECT event_id, NOT {_shape_sql(2)} AS failed,
  CASE WHEN {_shape_sql(2)} THEN {_shape_sql(1)} ELSE '{{}}' END AS data
FROM events""")
def logs_json_strict(spark, sf_dir):
    """Messages of a JSON route: only exactly one JSON value is taken for data."""
    records = log_input(spark, sf_dir).withColumns({"appname": F.lit("opaal"), "message": _shape(1)})
    return normalize_logs(records).select(
        "event_id", F.col("parse_error").isNotNull().alias("failed"), "data"
    )


@catalogued(f"""
SELECT event_id, NOT {_shape_sql(2)} AS failed,
  CASE WHEN {_shape_sql(2)} THEN '{{"data":' || {_shape_sql(1)} || '}}' ELSE '{{"data":{{}}}}' END AS cloudevent
FROM events""")
def events_body_strict(spark, sf_dir):
    """Request bodies: only exactly one JSON value is merged into the event."""
    requests = events_table(spark, sf_dir).select(
        "event_id", F.lit("http_server").alias("source_type"), F.date_format("ts", ISO_MICROS).alias("timestamp"),
        F.create_map(F.lit("path"), F.lit("/")).alias("headers"), _shape(1).alias("message"),
    )
    return normalize_events(requests).select(
        "event_id", F.col("parse_error").isNotNull().alias("failed"), "cloudevent"
    )


@catalogued(f"""
SELECT event_id, CASE WHEN event_id % {len(_SHAPES)} <> 0 THEN 'not one JSON object' END AS reason
FROM events""")
def compact_strict(spark, sf_dir):
    """Raw lines: only exactly one JSON object can be stored."""
    lines = events_table(spark, sf_dir).select("event_id", _shape(1).alias("value"))
    return check_lines(lines, "logs").select("event_id", "reason")


@catalogued(f"""
SELECT event_id, {_shape_sql(2)} AS nested, {_shape_sql(1)} AS shown FROM events""")
def payload_tail(spark, sf_dir):
    """Payloads for output: JSON nests, other text stays as it is, to its end."""
    shown = payload(_shape(1))
    kind = F.schema_of_variant(shown)
    return events_table(spark, sf_dir).select(
        "event_id", (kind != "STRING").alias("nested"),
        F.when(kind == "STRING", shown.cast("string")).otherwise(F.to_json(shown)).alias("shown"),
    )


def _at_midnight(records: DataFrame) -> DataFrame:
    """The records moved to the first hour of their day, so that a lake has one object a day."""
    return records.withColumn("ts", F.concat(F.substring("ts", 1, 11), F.lit("00:00:00Z")))


def _text_objects(lines: DataFrame, lake: Lake, stream: str = "logs") -> None:
    """Objects of another writer: text under ``date=/hour=`` without a batch folder."""
    lines.repartition("date", "hour").write.mode("append").partitionBy("date", "hour").text(lake.raw(stream))


@catalogued(f"""
SELECT {_shape_sql(1)} AS line, event_id % {len(_SHAPES)} <> 0 AS failed,
  CASE WHEN event_id % {len(_SHAPES)} = 0 THEN CAST(event_id AS VARCHAR) END AS n, '07' AS hour
FROM events""")
def raw_odd_lines(spark, sf_dir):
    """Raw lines of any shape are one record each; those that are no object say so."""
    lake = Lake(work_area(spark, "odd-lines"))
    _text_objects(events_table(spark, sf_dir).select(
        _shape(1).alias("value"), F.lit("2024-01-03").alias("date"), F.lit("07").alias("hour")
    ), lake)
    return read_raw(spark, lake, "logs", ("n",)).select(
        F.col("payload_json").alias("line"), F.col("parse_error").isNotNull().alias("failed"), "n", "hour"
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT ts, CAST(event_id AS VARCHAR) AS event_id, CAST(event_id AS VARCHAR) AS by_path FROM lake""")
def raw_unknown_fields(spark, sf_dir):
    """A field outside the schema, in both tiers: as a column, and by path in the line."""
    return query(
        spark, two_tier_lake(spark, sf_dir),
        "SELECT ts, event_id, json_extract_string(payload_json, '$.event_id') AS by_path FROM SOURCES",
        extra_fields=("event_id",),
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT strftime(event_time, '%Y-%m-%dT00:00:00Z') AS ts, service, event_id % 2 = 0 AS ours, strftime(event_time, '%Y-%m-%d') AS date,
  '00' AS hour
FROM lake""")
def raw_mixed_layout(spark, sf_dir):
    """Batches of this package and objects of another writer in the same folders."""
    lake, records = Lake(work_area(spark, "mixed")), _at_midnight(lake_logs(spark, sf_dir))
    write_raw(records.where("event_id % 2 = 0"), lake.raw("logs"), "ours")
    others = records.where("event_id % 2 <> 0")
    _text_objects(others.select(
        F.to_json(F.struct("ts", "service")).alias("value"),
        F.substring("ts", 1, 10).alias("date"), F.substring("ts", 12, 2).alias("hour"),
    ), lake)
    return read_raw(spark, lake, "logs", ("event_id",)).select(
        "ts", "service", F.col("event_id").isNotNull().alias("ours"),
        F.col("date").cast("string").alias("date"), "hour",
    )


@catalogued(f"""
WITH {OBJECTS_SQL}
SELECT date, slot, CASE WHEN bad_lines = 0 THEN 'compacted' ELSE 'recent' END AS tier, objects.lines AS records,
  (SELECT count(*) FROM lines WHERE lines.date = objects.date AND lines.slot = objects.slot
    AND reason = 'not one JSON object') AS malformed
FROM objects""")
def compact_rejected_visible(spark, sf_dir):
    """After three runs that delete what they have stored, rejected objects are all still there."""
    lake = flawed_objects(spark, sf_dir)
    for _ in range(3):
        compact_stream(spark, lake, "logs", clean="delete")
    found = sources(spark, lake, "logs", extra_fields=("source_file",))
    compacted = load(spark, strings(("source_file",)), lake.compacted("logs"), "parquet").distinct()
    tier = F.when(F.col("compacted"), "compacted").otherwise("recent")
    return (
        found.join(compacted.withColumn("compacted", F.lit(True)), "source_file", "left")
        .groupBy(*object_key(), tier.alias("tier"))
        .agg(F.count(F.lit(1)).alias("records"), F.count("parse_error").alias("malformed"))
    )


@catalogued(f"""
WITH {OBJECTS_SQL}
SELECT date, slot, lines AS stored, lines AS distinct_lines, CAST(0 AS BIGINT) AS set_aside FROM objects""")
def compact_retry(spark, sf_dir):
    """Bad objects are tried again as they are, then mended, and in the end stored once."""
    lake = flawed_objects(spark, sf_dir)
    compact_raw(spark, lake, "logs", "first")
    compact_raw(spark, lake, "logs", "second")
    rejected = read_status(spark, lake, "logs").where("bad_lines > 0").select(*object_key()).distinct()
    lines = flawed_objects(spark, sf_dir, mended=True, write=False)
    rejected = rejected.withColumn("slot", F.col("slot").cast("bigint"))
    (
        lines.join(rejected, ["date", "slot"], "left_semi").repartition("date", "slot")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "slot").text(lake.raw("logs"))
    )
    compact_raw(spark, lake, "logs", "third")
    compact_raw(spark, lake, "logs", "fourth")
    left = sources(spark, lake, "logs", "recent").agg(F.count(F.lit(1)).alias("set_aside"))
    return (
        read_compacted(spark, lake, "logs", ("source_file", "event_id")).groupBy(*object_key())
        .agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("event_id").alias("distinct_lines"))
        .withColumn("set_aside", F.lit(left.first()[0]))
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT strftime(event_time, '%Y-%m-%d') AS date, count(*) AS records FROM lake GROUP BY 1""")
def compact_mixed_runs(spark, sf_dir):
    """A named run, the periodic job, more objects and the job again: each record once."""
    lake, records = Lake(work_area(spark, "mixed-runs")), _at_midnight(lake_logs(spark, sf_dir))
    write_raw(records.where("event_id % 3 = 0"), lake.raw("logs"), "one")
    compact_raw(spark, lake, "logs", "by-hand")
    run_compaction(spark, lake, clean="off")
    write_raw(records.where("event_id % 3 = 1"), lake.raw("logs"), "two")
    write_raw(records.where("event_id % 3 = 1"), lake.raw("logs"), "two")
    run_compaction(spark, lake)
    write_raw(records.where("event_id % 3 = 2"), lake.raw("logs"), "three")
    return sources(spark, lake, "logs").groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("records")
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}, {EVENTS_SQL.replace('found', 'read_requests')}
SELECT 'logs' AS stream, strftime(event_time, '%Y-%m-%d') AS date, count(*) AS compacted,
  CAST(0 AS BIGINT) AS raw_left FROM lake GROUP BY ALL
UNION ALL
SELECT 'events', strftime(event_time, '%Y-%m-%d'), count(*), 0 FROM expected GROUP BY ALL""")
def compact_both_streams(spark, sf_dir):
    """The periodic job over both streams, twice: all is compacted and the raw tier cleared."""
    lake = Lake(work_area(spark, "both"))
    write_raw(_at_midnight(lake_logs(spark, sf_dir)), lake.raw("logs"), "all")
    write_raw(_at_midnight(lake_events(spark, sf_dir)), lake.raw("events"), "all")
    run_compaction(spark, lake)
    run_compaction(spark, lake)
    found = []
    for stream in ("logs", "events"):
        left = read_raw(spark, lake, stream, skip_compacted=False).agg(F.count(F.lit(1))).first()[0]
        found.append(
            read_compacted(spark, lake, stream).groupBy(F.col("date").cast("string").alias("date"))
            .agg(F.count(F.lit(1)).alias("compacted"))
            .select(F.lit(stream).alias("stream"), "date", "compacted", F.lit(left).alias("raw_left"))
        )
    return found[0].unionByName(found[1])


_TIED = "'{\"ts\":\"' || strftime(ts, '%Y-%m-%dT00:00:00Z') || '\",\"service\":\"s' || (event_id % 3) || '\",\"trace_id\":\"t' || (user_id % 5) || '\",\"n\":' || event_id || '}'"


@catalogued(f"""
WITH tied AS (
  SELECT 't' || (user_id % 5) AS trace_id, 's' || (event_id % 3) AS service, {_TIED} AS line,
    CAST(ts AS DATE) AS day FROM events),
hops AS (
  SELECT trace_id, service, row_number() OVER (PARTITION BY trace_id ORDER BY day, line) AS hop FROM tied)
SELECT tier, trace_id, hop, service AS service_or_type FROM hops, (VALUES ('raw'), ('compacted')) AS tiers(tier)""")
def trace_walk_ties(spark, sf_dir):
    """Records of one time have the same hops before and after compaction."""
    lake = Lake(work_area(spark, "ties"))
    line = F.expr(_TIED.replace("strftime(ts, '%Y-%m-%dT00:00:00Z')", "date_format(ts, \"yyyy-MM-dd'T'00:00:00'Z'\")"))
    _text_objects(events_table(spark, sf_dir).select(
        line.alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("00").alias("hour")
    ), lake)

    def walked(tier: str) -> DataFrame:
        path = work_area(spark, f"hops-{tier}")
        run_report("trace-walk", sources(spark, lake, "logs")).write.parquet(path)
        return spark.read.parquet(path).select(F.lit(tier).alias("tier"), "trace_id", "hop", "service_or_type")

    raw = walked("raw")
    compact_raw(spark, lake, "logs")
    return raw.unionByName(walked("compacted"))


_ZONED = "strftime(CAST(ts AS DATE) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00'"


@catalogued(f"""
SELECT {_ZONED} AS ts, strftime(ts, '%Y-%m-%d') AS date FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""")
def report_params_offsets(spark, sf_dir):
    """A time range over records written in another zone, across both tiers: by instant.

    All are of 03:00 UTC, which is 22:00 of the day before where they were written.
    """
    lake = Lake(work_area(spark, "zoned"))
    local = F.date_trunc("day", "ts") - F.expr("INTERVAL 2 HOURS")
    shifted = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'-05:00'")
    records = events_table(spark, sf_dir).select(
        shifted.alias("ts"), F.lit("smd").alias("service"), F.lit("err").alias("level"), "event_id"
    )
    write_raw(records.where("event_id % 2 = 0"), lake.raw("logs"), "one")
    compact_raw(spark, lake, "logs")
    write_raw(records.where("event_id % 2 = 1"), lake.raw("logs"), "two")
    return run_report(
        "find-all-service-errors", sources(spark, lake, "logs"), since="2024-01-05T02:00:00Z",
        until="2024-01-08T22:30:00-05:00", from_date="2024-01-05",
    ).select("ts", F.col("date").cast("string").alias("date"))


@catalogued("""
SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-21 12:00:00' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000000Z')
  ELSE strftime(ts - INTERVAL 1 YEAR, '%Y-%m-%dT%H:%M:%S.000000Z') END AS timestamp, 'smd' AS appname
FROM events""")
def syslog_bsd(spark, sf_dir):
    """The older syslog format: the year is the last that is not after receipt."""
    received = F.lit("2024-01-20T12:00:00Z").cast("timestamp")
    stamp = F.concat(F.lit("<27>Jan "), F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss"))
    lines = events_table(spark, sf_dir).select(
        "event_id", F.concat(stamp, F.lit(" host smd[7]: a message\r")).alias("value")
    )
    return syslog_records(lines, received=received).select("event_id", "timestamp", "appname")


@catalogued("""
SELECT event_id % 3 <> 0 AS failed,
  CASE event_id % 3 WHEN 1 THEN 'no request ' || event_id WHEN 2 THEN '[{"message":"' || event_id || '"}]' END AS raw
FROM events""")
def requests_malformed(spark, sf_dir):
    """Landed lines that are no request keep their text in ``raw`` and are marked."""
    landing = work_area(spark, "malformed")
    number = F.col("event_id").cast("string")
    events_table(spark, sf_dir).select(
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("no request "), number))
        .when(F.col("event_id") % 3 == 2, F.concat(F.lit('[{"message":"'), number, F.lit('"}]')))
        .otherwise('{"source_type":"http_server","headers":{"path":"/"},"message":"{}"}').alias("value")
    ).write.text(landing)
    failed = F.col("parse_error").isNotNull()
    return normalize_events(read_requests(spark, landing)).select(
        failed.alias("failed"), F.when(failed, F.col("raw")).alias("raw")
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT ts, service, CASE WHEN branch = 'json' THEN msg ELSE NULL END AS data, request_id FROM lake""")
def dump_nested(spark, sf_dir):
    """All records as JSON rows; the payload nests."""
    rows = json_rows(dump(spark, two_tier_lake(spark, sf_dir), nested=False))
    member = lambda path: F.get_json_object("json", path)
    return rows.select(
        member("$.ts").alias("ts"), member("$.service").alias("service"),
        F.when(member("$.data.request_id").isNotNull(), member("$.data")).alias("data"),
        member("$.data.request_id").alias("request_id"),
    )


@catalogued("""
SELECT doc_id, text AS msg, '{"text":"' || n_chars || '"}' AS data FROM documents""")
def result_free_text(spark, sf_dir):
    """Free text with quotes and line ends through raw tier, compaction and NDJSON export."""
    lake, path = Lake(work_area(spark, "free-text")), work_area(spark, "free-text-result")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.lit("2024-01-01T00:00:00Z").alias("ts"), F.col("text").alias("msg"), "doc_id",
        F.to_json(F.struct(F.col("n_chars").cast("string").alias("text"))).alias("data"),
    )
    write_raw(docs, lake.raw("logs"), "all")
    compact_raw(spark, lake, "logs")
    result = sources(spark, lake, "logs", extra_fields=("doc_id",)).select("doc_id", "msg", "data")
    write_result(result, path, "ndjson")
    back = spark.read.schema("doc_id string, msg string, data struct<text:string>").json(path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "msg", F.to_json("data").alias("data"))
