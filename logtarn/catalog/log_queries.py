"""Log ingestion and normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtarn.catalog.derive import LAKE_LOGS_SQL, LOGS_SQL, log_input, syslog_lines
from logtarn.catalog.registry import catalogued
from logtarn.operators import logs
from logtarn.operators.relay import allow_listed
from logtarn.session import work_area
from logtarn.sources.landing import read_syslog, syslog_records

ROOT_FIELDS = (
    "ts", "service", "host", "level", "msg", "xname", "component_id", "node_id", "trace_id",
    "request_id", "request_uri", "request_user",
)
FOUND_FIELDS_SQL = (
    "ts, service, host, level, msg, xname, CAST(NULL AS VARCHAR) AS component_id, node_id, "
    "trace_id, request_id, request_uri, CAST(NULL AS VARCHAR) AS request_user"
)


def failed() -> Column:
    return F.col("parse_error").isNotNull().alias("failed")


def json_member(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}").alias(f"data_{name}")


@catalogued(f"""
WITH {LOGS_SQL}
SELECT ts AS timestamp, host, service AS appname,
  CASE event_type WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'warning'
    WHEN 'signup' THEN 'notice' ELSE 'info' END AS severity,
  'daemon' AS facility,
  CASE WHEN branch = 'plain' THEN chr(27) || '[31mNode NID=' || user_id || chr(27)
    || '[0m XNAME X1000C0S' || (user_id % 8) ELSE msg END AS message
FROM found""")
def syslog_parse(spark, sf_dir):
    """Syslog lines, landed as text files, decoded into their fields."""
    landing = work_area(spark, "syslog")
    syslog_lines(spark, sf_dir).select("value").write.text(landing)
    return read_syslog(spark, landing).select(
        "timestamp", "host", "appname", "severity", "facility", "message"
    )


@catalogued(f"""
WITH {LOGS_SQL}
SELECT event_id, service AS appname FROM logs
WHERE service IN ('smd', 'hydra', 'opaal', 'registry', 'step-ca', 'bss', 'coresmd-coredns',
  'cloud-init-server', 'postgres')""")
def allowlist_relay(spark, sf_dir):
    """Records of listed programs only."""
    return allow_listed(log_input(spark, sf_dir)).select("event_id", "appname")


@catalogued(f"""
WITH {LOGS_SQL}
SELECT event_id, {FOUND_FIELDS_SQL.split(', xname')[0]}, '{{}}' AS data, 8 AS null_fields
FROM found""")
def logs_prepare(spark, sf_dir):
    """Renamed fields, empty data, null domain fields and error."""
    prepared = logs.prepare(log_input(spark, sf_dir))
    empty = [F.col(c).isNull().cast("int") for c in (*logs.DOMAIN_FIELDS, "parse_error")]
    return prepared.select(
        "event_id", "ts", "service", "host", "level", "msg",
        "data",
        sum(empty, F.lit(0)).alias("null_fields"),
    )


@catalogued(f"""
WITH {LOGS_SQL}
SELECT event_id, msg, branch = 'plain' AS had_escapes FROM found""")
def logs_strip_ansi(spark, sf_dir):
    """Messages without terminal escapes."""
    records = log_input(spark, sf_dir)
    prepared = logs.prepare(records.withColumn("original", F.col("message")))
    return prepared.select(
        "event_id", "msg", (F.col("original") != F.col("msg")).alias("had_escapes")
    )


@catalogued(f"""
WITH {LOGS_SQL}
SELECT CASE WHEN service IN ('bss', 'sshd', 'postgres') THEN '_unmatched'
  ELSE replace(service, '-', '_') END AS route, count(*) AS records
FROM logs GROUP BY 1""")
def logs_route(spark, sf_dir):
    """Records per route."""
    routed = logs.route(logs.prepare(log_input(spark, sf_dir)))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("records"))


def _sanitized(spark, sf_dir):
    return logs.sanitize(logs.prepare(log_input(spark, sf_dir)))


@catalogued(f"""
WITH {LOGS_SQL}
SELECT event_id, failed, request_id AS data_request_id, trace_id AS data_trace_id,
  xname AS data_xname, CASE WHEN failed THEN '{{}}' END AS data_if_failed
FROM found WHERE service = 'opaal'""")
def logs_json(spark, sf_dir):
    """JSON messages parsed into data; the others flagged."""
    parsed = _sanitized(spark, sf_dir).where("service = 'opaal'")
    return parsed.select(
        "event_id", failed(), json_member("request_id"), json_member("trace_id"),
        json_member("xname"), F.when(F.col("parse_error").isNotNull(), F.col("data"))
        .alias("data_if_failed"),
    )


@catalogued(f"""
WITH {LOGS_SQL}
SELECT event_id, failed, 'info' AS data_level, CAST(user_id AS VARCHAR) AS data_nid,
  request_uri AS data_request_uri, 'hello "q" world' AS data_msg, 'true' AS data_flag
FROM found WHERE branch = 'logfmt'""")
def logs_logfmt(spark, sf_dir):
    """logfmt messages parsed into data."""
    parsed = _sanitized(spark, sf_dir).where(
        F.col("service").isin(*logs.LOGFMT_SERVICES)
    )
    return parsed.select(
        "event_id", failed(), json_member("level"), json_member("nid"),
        json_member("request_uri"), json_member("msg"), json_member("flag"),
    )


@catalogued(f"""
WITH {LOGS_SQL}
SELECT branch, count(*) AS records, count(DISTINCT event_id) AS distinct_records FROM logs
GROUP BY 1""")
def logs_join_routes(spark, sf_dir):
    """Every record comes out of the parsing step exactly once, whatever its route."""
    parsed = _sanitized(spark, sf_dir)
    branch = (
        F.when(F.col("parse_error").isNotNull(), "broken")
        .when(F.col("service") == "opaal", "json")
        .when(F.col("data") == "{}", "plain")
        .otherwise("logfmt")
    )
    return parsed.groupBy(branch.alias("branch")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("event_id").alias("distinct_records")
    )


@catalogued(f"""
WITH {LOGS_SQL}
SELECT event_id, request_uri, request_id, trace_id, CAST(NULL AS VARCHAR) AS component_id,
  CAST(NULL AS VARCHAR) AS node_id, CASE WHEN branch = 'json' THEN xname END AS xname
FROM found""")
def logs_promote(spark, sf_dir):
    """Domain fields taken from parsed data."""
    promoted = logs.promote(_sanitized(spark, sf_dir))
    return promoted.select("event_id", *logs.PROMOTED)


@catalogued(f"WITH {LOGS_SQL} SELECT event_id, node_id, xname FROM found")
def logs_best_effort(spark, sf_dir):
    """Domain fields searched for in the message."""
    searched = logs.best_effort(logs.promote(_sanitized(spark, sf_dir)))
    return searched.select("event_id", "node_id", "xname")


@catalogued(f"""
WITH {LOGS_SQL}
SELECT event_id, branch IN ('plain', 'broken') AS is_empty, request_id AS data_request_id,
  request_uri AS data_request_uri,
  CASE WHEN branch = 'logfmt' THEN CAST(user_id AS VARCHAR) END AS data_nid
FROM found""")
def logs_encode(spark, sf_dir):
    """Data as JSON text."""
    encoded = _sanitized(spark, sf_dir)
    return encoded.select(
        "event_id", (F.col("data") == "{}").alias("is_empty"), json_member("request_id"),
        json_member("request_uri"), json_member("nid"),
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT event_id, {FOUND_FIELDS_SQL}, failed FROM lake""")
def logs_normalized(spark, sf_dir):
    """The whole log chain behind the allow-list."""
    records = logs.normalize_logs(allow_listed(log_input(spark, sf_dir)))
    return records.select("event_id", *ROOT_FIELDS, failed())


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT {FOUND_FIELDS_SQL.replace('level,', "CASE WHEN level = 'error' THEN 'err' ELSE level END AS level,")},
  failed FROM lake""")
def syslog_to_logs(spark, sf_dir):
    """From syslog text to lake records in one stage."""
    lines = syslog_lines(spark, sf_dir).select("value")
    records = logs.normalize_logs(allow_listed(syslog_records(lines)))
    return records.select(*ROOT_FIELDS, failed())
