"""Ad-hoc SQL, reports and inspection over a lake with both tiers."""

from pyspark.sql import functions as F

from logtarn.catalog.derive import EVENTS_SQL, LAKE_LOGS_SQL
from logtarn.catalog.lake_queries import two_tier_lake
from logtarn.catalog.log_queries import FOUND_FIELDS_SQL, ROOT_FIELDS, failed
from logtarn.catalog.registry import catalogued
from logtarn.plans.inspect import available_dates
from logtarn.plans.query import between_dates, dump, expand_payload, json_rows, query
from logtarn.plans.reports import run_report
from logtarn.sources.lake import sources


def _logs(spark, sf_dir, scope="all"):
    return sources(spark, two_tier_lake(spark, sf_dir), "logs", scope)


def _events(spark, sf_dir, scope="all"):
    return sources(spark, two_tier_lake(spark, sf_dir), "events", scope)


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT service, level, count(*) AS records, max(ts) AS last_ts FROM lake
WHERE level <> 'info' GROUP BY service, level""")
def adhoc_sql(spark, sf_dir):
    """Free SQL over SOURCES."""
    return query(
        spark, two_tier_lake(spark, sf_dir),
        "SELECT service, level, count(*) AS records, max(ts) AS last_ts FROM SOURCES "
        "WHERE level <> :quiet GROUP BY service, level;",
        args={"quiet": "info"},
    )


@catalogued(f"WITH {LAKE_LOGS_SQL} SELECT {FOUND_FIELDS_SQL}, failed FROM lake")
def dump_all(spark, sf_dir):
    """Every log record of both tiers."""
    return dump(spark, two_tier_lake(spark, sf_dir)).select(*ROOT_FIELDS, failed())


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT ts, cloudevent_id AS event_id, CAST(data_k AS BIGINT) AS k, parse_error IS NOT NULL AS failed
FROM expected""")
def payload_expand(spark, sf_dir):
    """The payload as nested data: its members are read by path and keep their type."""
    expanded = expand_payload(_events(spark, sf_dir), "events")
    return expanded.select(
        "ts", F.variant_get("cloudevent", "$.id", "string").alias("event_id"),
        F.variant_get("cloudevent", "$.data.k", "bigint").alias("k"), failed(),
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT ts, service, trace_id, branch = 'json' AS nested_request,
  CASE WHEN xname IS NULL THEN true ELSE false END AS xname_is_null
FROM lake""")
def row_json(spark, sf_dir):
    """Each record as one JSON object, nulls kept, payload nested."""
    rows = json_rows(_logs(spark, sf_dir), "logs")
    whole = F.from_json("json", "ts string, service string, trace_id string, data variant")
    return rows.select(
        F.get_json_object("json", "$.ts").alias("ts"),
        F.get_json_object("json", "$.service").alias("service"),
        F.get_json_object("json", "$.trace_id").alias("trace_id"),
        F.variant_get(whole["data"], "$.request_id", "string").isNotNull().alias("nested_request"),
        F.contains("json", F.lit('"xname":null')).alias("xname_is_null"),
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT ts, cloudevent_type FROM expected WHERE cloudevent_specversion = '1.0'""")
def json_path_filter(spark, sf_dir):
    """Events chosen by a member of their payload."""
    return query(
        spark, two_tier_lake(spark, sf_dir),
        "SELECT ts, cloudevent_type FROM SOURCES "
        "WHERE json_extract_string(cloudevent, '$.specversion') = '1.0'",
        stream="events",
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT ts, service, msg FROM lake
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-17'""")
def date_filter(spark, sf_dir):
    """Records of a range of days, across both tiers."""
    return between_dates(_logs(spark, sf_dir), "2024-01-14", "2024-01-17").select(
        "ts", "service", "msg"
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}, {EVENTS_SQL.replace('found', 'read_requests')}
SELECT 'logs' AS stream, ts, msg AS input FROM lake WHERE failed
UNION ALL SELECT 'events', ts, source_type FROM expected WHERE parse_error IS NOT NULL""")
def report_parse_errors(spark, sf_dir):
    """Report find-all-parse-errors over both streams."""
    logs = run_report("find-all-parse-errors", _logs(spark, sf_dir))
    events = run_report("find-all-parse-errors", _events(spark, sf_dir))
    return logs.select(F.lit("logs").alias("stream"), "ts", F.col("msg").alias("input")).unionByName(
        events.select(
            F.lit("events").alias("stream"), "ts",
            F.get_json_object("raw", "$.source_type").alias("input"),
        )
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT {FOUND_FIELDS_SQL}, failed FROM lake WHERE level = 'error' OR level = 'err'
ORDER BY ts DESC""")
def report_service_errors(spark, sf_dir):
    """Report find-all-service-errors."""
    return run_report("find-all-service-errors", _logs(spark, sf_dir)).select(
        *ROOT_FIELDS, failed()
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT ts, service, level, host FROM lake
WHERE level = 'err' AND service = 'smd' AND ts >= '2024-01-05T12:00:00.000000Z'
  AND ts < '2024-01-20T00:00:00.000000Z'""")
def report_params(spark, sf_dir):
    """A report with parameters."""
    return run_report(
        "find-all-service-errors", _logs(spark, sf_dir),
        since="2024-01-05T12:00:00Z", until="2024-01-20T00:00:00Z",
        from_date="2024-01-05", to_date="2024-01-20", service="smd", level="err",
    ).select("ts", "service", "level", "host")


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT service, count(*) AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM lake
WHERE level IN ('err', 'error') GROUP BY service""")
def errors_by_service(spark, sf_dir):
    """Report errors-by-service."""
    return run_report("errors-by-service", _logs(spark, sf_dir))


@catalogued(f"""
WITH {LAKE_LOGS_SQL},
hops AS (
  SELECT trace_id, ts, service,
    row_number() OVER w AS hop,
    epoch_us(event_time) - lag(epoch_us(event_time)) OVER w AS gap
  FROM lake WHERE trace_id IS NOT NULL
  WINDOW w AS (PARTITION BY trace_id ORDER BY event_time, event_id)
)
SELECT trace_id, hop, 'logs' AS stream, service AS service_or_type, ts,
  floor((gap + 500) / 1000.0) / 1000 AS gap_seconds
FROM hops""")
def trace_walk(spark, sf_dir):
    """Report trace-walk over both streams."""
    return run_report("trace-walk", _logs(spark, sf_dir), events=_events(spark, sf_dir))


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT xname, count(*) AS records, count(DISTINCT service) AS services,
  count(CASE WHEN level IN ('err', 'error') THEN 1 END) AS errors, max(ts) AS last_ts
FROM lake WHERE xname IS NOT NULL GROUP BY xname""")
def xname_groups(spark, sf_dir):
    """Report xname-groups."""
    return run_report("xname-groups", _logs(spark, sf_dir))


@catalogued(f"""
WITH {LAKE_LOGS_SQL} SELECT DISTINCT CAST(event_time AS DATE) AS date FROM lake ORDER BY date""")
def inspect_dates(spark, sf_dir):
    """Days with records."""
    return available_dates(_logs(spark, sf_dir))


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT l.trace_id, l.service, c.c_name FROM lake l JOIN customer c
  ON c.c_custkey = CAST(substr(l.trace_id, 2) AS BIGINT)""")
def adhoc_join(spark, sf_dir):
    """Free SQL that joins SOURCES with a table of the user's."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return query(
        spark, two_tier_lake(spark, sf_dir),
        "SELECT l.trace_id, l.service, c.c_name FROM SOURCES l JOIN customer c "
        "ON c.c_custkey = CAST(substr(l.trace_id, 2) AS BIGINT)",
    )


SELF_JOIN = """
SELECT a.host, a.records, b.errors FROM
  (SELECT host, count(*) AS records FROM {table} GROUP BY host) a
  JOIN (SELECT host, count(*) AS errors FROM {table} WHERE level = 'err' GROUP BY host) b
  ON a.host = b.host"""


@catalogued(f"WITH {LAKE_LOGS_SQL} {SELF_JOIN.format(table='lake')}")
def adhoc_self_join(spark, sf_dir):
    """Free SQL that mentions SOURCES twice."""
    return query(spark, two_tier_lake(spark, sf_dir), SELF_JOIN.format(table="SOURCES"))


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT host, ts, service, count(*) OVER (PARTITION BY host, service ORDER BY ts) AS seen
FROM lake WHERE level IN ('err', 'error')""")
def adhoc_window(spark, sf_dir):
    """Free SQL with a window."""
    return query(
        spark, two_tier_lake(spark, sf_dir),
        "SELECT host, ts, service, count(*) OVER (PARTITION BY host, service ORDER BY ts) AS seen "
        "FROM SOURCES WHERE level IN ('err', 'error')",
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL} SELECT ts, service, msg FROM lake ORDER BY ts DESC LIMIT 20""")
def adhoc_topk(spark, sf_dir):
    """Free SQL for the latest records."""
    return query(
        spark, two_tier_lake(spark, sf_dir),
        "SELECT ts, service, msg FROM SOURCES ORDER BY ts DESC LIMIT 20",
    )


@catalogued(f"""
WITH {LAKE_LOGS_SQL}
SELECT host, service, count(*) AS records FROM lake GROUP BY ROLLUP (host, service)""")
def adhoc_rollup(spark, sf_dir):
    """Free SQL with subtotals."""
    return query(
        spark, two_tier_lake(spark, sf_dir),
        "SELECT host, service, count(*) AS records FROM SOURCES GROUP BY ROLLUP (host, service)",
    )
