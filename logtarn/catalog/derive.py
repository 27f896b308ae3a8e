"""Log records and HTTP requests derived from the ``events`` table.

The derivation is stated twice, for Spark here and for the oracle engine in the ``*_SQL`` texts.
The oracles never run a parser: they state what the parsers must find, from the base columns.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.times import ISO_MICROS

ESC = "\x1b"
SERVICE_BY_DIGIT = (
    "smd", "hydra", "opaal", "registry", "step-ca", "bss", "coresmd-coredns", "sshd",
    "cloud-init-server", "postgres",
)
UNPARSED_DIGITS = (5, 7, 9)


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _iso(name: str) -> Column:
    return F.date_format(name, ISO_MICROS)


def log_input(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """Decoded syslog records; ``event_id`` rides along as one more syslog field."""
    digit = F.col("event_id") % 10
    rack = F.concat(F.lit("c0s"), (F.col("user_id") % 8).cast("string"))
    json_text = F.concat(
        F.lit('{"request_id":"r'), _text("event_id"),
        F.lit('","trace_id":"t'), _text("user_id"),
        F.lit('","xname":"x1000'), rack, F.lit('b0n0"}'),
    )
    plain = F.concat(
        F.lit(f"{ESC}[31mNode NID="), _text("user_id"),
        F.lit(f"{ESC}[0m XNAME X1000"), F.upper(rack),
    )
    logfmt = F.concat(
        F.lit("level=info nid="), _text("user_id"),
        F.lit(' request_uri="/api/'), F.col("event_type"),
        F.lit('" msg="hello \\"q\\" world" flag'),
    )
    kind = F.col("event_type")
    return events_table(spark, sf_dir).select(
        _iso("ts").alias("timestamp"),
        F.get(F.array(*[F.lit(s) for s in SERVICE_BY_DIGIT]), digit.cast("int")).alias("appname"),
        F.when((kind == "error") & (F.col("event_id") % 2 == 0), "err")
        .when(kind == "error", "error")
        .when(kind == "purchase", "warning")
        .when(kind == "signup", "notice")
        .otherwise("info").alias("severity"),
        F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string")).alias("host"),
        F.when(F.col("event_id") % 50 == 2, F.concat(F.lit("not json "), kind))
        .when(digit == 2, json_text)
        .when(digit.isin(*UNPARSED_DIGITS), plain)
        .otherwise(logfmt).alias("message"),
        "event_id",
        *kept,
    )


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as syslog text lines."""
    kind = F.col("event_type")
    code = F.when(kind == "error", 3).when(kind == "purchase", 4).when(kind == "signup", 5)
    return log_input(spark, sf_dir, "event_type").select(
        F.concat(
            F.lit("<"), (F.coalesce(code, F.lit(6)) + 24).cast("string"), F.lit(">1 "),
            F.col("timestamp"), F.lit(" "), F.col("host"), F.lit(" "), F.col("appname"),
            F.lit(" - - - "), F.col("message"),
        ).alias("value"),
        "event_id",
    )


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed CloudEvents requests; ``event_id`` rides along."""
    number, kind, props = F.col("event_id"), F.col("event_type"), F.col("props")
    even = number % 2 == 0
    host = F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string"))
    event_name = F.concat(F.lit("e"), _text("event_id"))
    source = F.concat(F.lit("/users/"), _text("user_id"))
    binary = F.create_map(
        F.lit("ce-id"), event_name,
        F.lit("ce-source"), source,
        F.lit("ce-type"), kind,
        F.lit("ce-specversion"), F.lit("1.0"),
        F.lit("content-type"), F.lit("application/json"),
        F.lit("user-agent"), F.lit("agent/1"),
        F.lit("host"), host,
        F.lit("path"), F.lit("/"),
    )
    structured = F.create_map(
        F.lit("content-type"), F.lit("application/cloudevents+json"),
        F.lit("host"), host,
        F.lit("path"), F.lit("/"),
    )
    whole = F.concat(
        F.lit('{"id":"'), event_name, F.lit('","source":"'), source, F.lit('","type":"'), kind,
        F.lit('","specversion":"1.0","data":'), props, F.lit("}"),
    )
    message = (
        F.when(number % 7 == 0, '{"id":')
        .when(number % 20 == 10, "")
        .when(
            number % 4 == 0,
            F.concat(F.lit('{"data":'), props, F.lit(',"type":"over.'), kind, F.lit('"}')),
        )
        .when(even, props)
        .when(
            number % 5 == 0,
            F.concat(F.lit('{"id":"'), event_name, F.lit('","type":"'), kind, F.lit('"}')),
        )
        .otherwise(whole)
    )
    return events_table(spark, sf_dir).select(
        F.when(number % 11 == 0, "file").otherwise("http_server").alias("source_type"),
        _iso("ts").alias("timestamp"),
        F.when(even, binary).otherwise(structured).alias("headers"),
        message.alias("message"),
        "event_id",
    )


#: What normalisation must find in each derived log record.
LOGS_SQL = """
logs AS (
  SELECT event_id, user_id, event_type, ts AS event_time,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
    CASE event_id % 10 WHEN 0 THEN 'smd' WHEN 1 THEN 'hydra' WHEN 2 THEN 'opaal'
      WHEN 3 THEN 'registry' WHEN 4 THEN 'step-ca' WHEN 5 THEN 'bss'
      WHEN 6 THEN 'coresmd-coredns' WHEN 7 THEN 'sshd' WHEN 8 THEN 'cloud-init-server'
      ELSE 'postgres' END AS service,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'err'
      WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warning'
      WHEN event_type = 'signup' THEN 'notice' ELSE 'info' END AS level,
    'host' || (user_id % 7) AS host,
    CASE WHEN event_id % 50 = 2 THEN 'broken' WHEN event_id % 10 = 2 THEN 'json'
      WHEN event_id % 10 IN (5, 7, 9) THEN 'plain' ELSE 'logfmt' END AS branch
  FROM events
),
found AS (
  SELECT *,
    CASE branch WHEN 'broken' THEN 'not json ' || event_type
      WHEN 'json' THEN '{"request_id":"r' || event_id || '","trace_id":"t' || user_id
        || '","xname":"x1000c0s' || (user_id % 8) || 'b0n0"}'
      WHEN 'plain' THEN 'Node NID=' || user_id || ' XNAME X1000C0S' || (user_id % 8)
      ELSE 'level=info nid=' || user_id || ' request_uri="/api/' || event_type
        || '" msg="hello \\"q\\" world" flag' END AS msg,
    CASE branch WHEN 'json' THEN 'x1000c0s' || (user_id % 8) || 'b0n0'
      WHEN 'plain' THEN 'x1000c0s' || (user_id % 8) END AS xname,
    CASE WHEN branch IN ('plain', 'logfmt') THEN CAST(user_id AS VARCHAR) END AS node_id,
    CASE WHEN branch = 'json' THEN 't' || user_id END AS trace_id,
    CASE WHEN branch = 'json' THEN 'r' || event_id END AS request_id,
    CASE WHEN branch = 'logfmt' THEN '/api/' || event_type END AS request_uri,
    branch = 'broken' AS failed
  FROM logs
)"""

#: The same for the records that pass the allow-list.
LAKE_LOGS_SQL = LOGS_SQL + """,
lake AS (SELECT * FROM found WHERE service <> 'sshd')"""

#: What normalisation must find in each derived request.
EVENTS_SQL = """
requests AS (
  SELECT event_id, user_id, event_type, props, ts AS event_time,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
    CASE WHEN event_id % 11 = 0 THEN 'file' ELSE 'http_server' END AS source_type,
    event_id % 2 = 0 AS is_binary,
    CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN event_id % 20 = 10 THEN 'empty'
      WHEN event_id % 4 = 0 THEN 'override' WHEN event_id % 2 = 0 THEN 'bare'
      WHEN event_id % 5 = 0 THEN 'no_data' ELSE 'full' END AS body
  FROM events
),
found AS (
  SELECT *, source_type = 'http_server' AND body <> 'malformed' AS readable,
    CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS VARCHAR) AS k
  FROM requests
),
expected AS (
  SELECT *,
    CASE WHEN readable THEN 'http' END AS transport_method,
    CASE WHEN readable AND is_binary THEN 'binary' WHEN readable THEN 'structured' END
      AS cloudevent_binding,
    CASE WHEN readable AND (is_binary OR body = 'full') THEN 'e' || event_id END AS cloudevent_id,
    CASE WHEN readable AND (is_binary OR body = 'full') THEN '/users/' || user_id END
      AS cloudevent_source,
    CASE WHEN readable AND body = 'override' THEN 'over.' || event_type
      WHEN readable AND (is_binary OR body = 'full') THEN event_type END AS cloudevent_type,
    CASE WHEN readable AND (is_binary OR body = 'full') THEN '1.0' END AS cloudevent_specversion,
    CASE WHEN NOT readable THEN 'no sanitization path for the received cloudevent exists' END
      AS parse_error,
    CASE WHEN readable AND body IN ('override', 'bare', 'full') THEN k END AS data_k,
    CASE WHEN readable AND body = 'no_data' THEN 'e' || event_id END AS data_id
  FROM found
)"""
