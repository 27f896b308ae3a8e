"""Event ingestion and normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtarn.catalog.derive import EVENTS_SQL, http_requests
from logtarn.catalog.registry import catalogued
from logtarn.operators import cloudevents
from logtarn.session import work_area
from logtarn.sources.landing import read_requests

EXPECTED_FIELDS = (
    "ts", "source_type", "transport_method", "cloudevent_id", "cloudevent_source",
    "cloudevent_type", "cloudevent_specversion", "cloudevent_binding", "parse_error",
)


def member(column: str, path: str, name: str) -> Column:
    return F.get_json_object(column, f"$.{path}").alias(name)


def _sanitized(spark, sf_dir):
    return cloudevents.sanitize(cloudevents.prepare(http_requests(spark, sf_dir)))


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT source_type, ts AS timestamp, CASE WHEN is_binary THEN 8 ELSE 3 END AS header_count,
  'h' || (user_id % 7) AS host, CASE WHEN is_binary THEN 'e' || event_id END AS ce_id,
  CASE body WHEN 'malformed' THEN '{{"id":' WHEN 'empty' THEN ''
    WHEN 'override' THEN '{{"data":' || props || ',"type":"over.' || event_type || '"}}'
    WHEN 'bare' THEN props
    WHEN 'no_data' THEN '{{"id":"e' || event_id || '","type":"' || event_type || '"}}'
    ELSE '{{"id":"e' || event_id || '","source":"/users/' || user_id || '","type":"' || event_type
      || '","specversion":"1.0","data":' || props || '}}' END AS message
FROM requests""")
def cloudevent_requests(spark, sf_dir):
    """HTTP requests, landed as JSON files and read back with all headers."""
    landing = work_area(spark, "requests")
    http_requests(spark, sf_dir).drop("event_id").write.json(landing)
    return read_requests(spark, landing).select(
        "source_type", "timestamp", F.size("headers").alias("header_count"),
        F.col("headers")["host"].alias("host"), F.col("headers")["ce-id"].alias("ce_id"), "message",
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, source_type, ts, '{{}}' AS transport_metadata,
  '{{"data":{{}}}}' AS cloudevent, 12 AS null_fields, source_type AS raw_source_type,
  'h' || (user_id % 7) AS raw_host, CASE WHEN is_binary THEN event_type END AS raw_ce_type,
  body = 'empty' AS raw_message_empty
FROM requests""")
def events_prepare(spark, sf_dir):
    """The request moved into raw, event fields at their defaults."""
    records = cloudevents.prepare(http_requests(spark, sf_dir))
    defaults = (
        "transport_method", "cloudevent_binding", "cloudevent_id", "cloudevent_source",
        "cloudevent_type", "xname", "component_id", "node_id", "trace_id", "request_id",
        "request_uri", "parse_error",
    )
    return records.select(
        "event_id", "source_type", "ts", "transport_metadata", "cloudevent",
        sum([F.col(c).isNull().cast("int") for c in defaults], F.lit(0)).alias("null_fields"),
        member("raw", "source_type", "raw_source_type"),
        member("raw", "host", "raw_host"),
        F.get_json_object("raw", "$['ce-type']").alias("raw_ce_type"),
        (F.get_json_object("raw", "$.message") == "").alias("raw_message_empty"),
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT CASE source_type WHEN 'http_server' THEN 'http' ELSE '_unmatched' END AS route,
  count(*) AS records
FROM requests GROUP BY 1""")
def events_route(spark, sf_dir):
    """Records per route."""
    routed = cloudevents.route(cloudevents.prepare(http_requests(spark, sf_dir)))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("records"))


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, transport_method,
  CASE WHEN readable AND is_binary THEN 'application/json'
    WHEN readable THEN 'application/cloudevents+json' END AS content_type,
  CASE WHEN readable AND is_binary THEN 'agent/1' END AS user_agent,
  CASE WHEN readable THEN 'h' || (user_id % 7) END AS host,
  CASE WHEN readable THEN '/' END AS path, CAST(NULL AS VARCHAR) AS accept_encoding
FROM expected""")
def events_transport(spark, sf_dir):
    """Transport metadata taken from the headers."""
    records = _sanitized(spark, sf_dir)
    names = ("content_type", "user_agent", "host", "path", "accept_encoding")
    return records.select(
        "event_id", "transport_method", *[member("transport_metadata", n, n) for n in names]
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, CASE WHEN is_binary THEN 4 ELSE 0 END AS attribute_count,
  CASE WHEN is_binary THEN 'e' || event_id END AS id,
  CASE WHEN is_binary THEN '/users/' || user_id END AS source,
  CASE WHEN is_binary THEN event_type END AS type,
  CASE WHEN is_binary THEN '1.0' END AS specversion
FROM requests""")
def events_ce_headers(spark, sf_dir):
    """Event attributes carried in headers."""
    attributes = cloudevents.attributes(F.col("headers"))
    records = http_requests(spark, sf_dir).select("event_id", attributes.alias("attributes"))
    return records.select(
        "event_id", F.size("attributes").alias("attribute_count"),
        *[F.col("attributes")[name].alias(name) for name in cloudevents.PROMOTED],
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT cloudevent_binding, count(*) AS records FROM expected GROUP BY 1""")
def events_binding(spark, sf_dir):
    """Records per content mode; none for records that were not read."""
    return _sanitized(spark, sf_dir).groupBy("cloudevent_binding").agg(
        F.count(F.lit(1)).alias("records")
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, cloudevent_id AS id, cloudevent_type AS type, data_k, data_id,
  CASE WHEN NOT readable OR body = 'empty' THEN '{{}}' END AS empty_data
FROM expected""")
def events_body(spark, sf_dir):
    """Body merged into the event."""
    records = _sanitized(spark, sf_dir)
    data = F.get_json_object("cloudevent", "$.data")
    return records.select(
        "event_id", member("cloudevent", "id", "id"), member("cloudevent", "type", "type"),
        member("cloudevent", "data.k", "data_k"), member("cloudevent", "data.id", "data_id"),
        F.when(data == "{}", data).alias("empty_data"),
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, '{{}}' AS transport_metadata, '{{"data":{{}}}}' AS cloudevent
FROM expected WHERE transport_method IS NULL""")
def events_malformed(spark, sf_dir):
    """Records whose body is not JSON, and unmatched ones, keep every default."""
    records = _sanitized(spark, sf_dir).where("transport_method IS NULL")
    return records.select("event_id", "transport_metadata", "cloudevent")


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, cloudevent_id, cloudevent_source, cloudevent_type, cloudevent_specversion
FROM expected""")
def events_promote(spark, sf_dir):
    """Event columns taken from the event."""
    records = cloudevents.promote(_sanitized(spark, sf_dir))
    return records.select("event_id", *[f"cloudevent_{n}" for n in cloudevents.PROMOTED])


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT parse_error, body, count(*) AS records FROM expected GROUP BY 1, 2""")
def events_last_error(spark, sf_dir):
    """The error of records that no parser has read, by kind of body."""
    records = cloudevents.flag_unparsed(_sanitized(spark, sf_dir))
    number = F.col("event_id")
    body = (
        F.when(number % 7 == 0, "malformed").when(number % 20 == 10, "empty")
        .when(number % 4 == 0, "override").when(number % 2 == 0, "bare")
        .when(number % 5 == 0, "no_data").otherwise("full")
    )
    return records.groupBy("parse_error", body.alias("body")).agg(
        F.count(F.lit(1)).alias("records")
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, transport_method IS NULL AS unread,
  CASE WHEN readable THEN 'h' || (user_id % 7) END AS metadata_host, 'h' || (user_id % 7) AS raw_host,
  ts AS raw_timestamp, cloudevent_source AS event_source
FROM expected""")
def events_encode(spark, sf_dir):
    """Nested members as JSON text."""
    records = _sanitized(spark, sf_dir)
    return records.select(
        "event_id", F.col("transport_method").isNull().alias("unread"),
        member("transport_metadata", "host", "metadata_host"), member("raw", "host", "raw_host"),
        member("raw", "timestamp", "raw_timestamp"), member("cloudevent", "source", "event_source"),
    )


@catalogued(f"""
WITH {EVENTS_SQL}
SELECT event_id, {', '.join(EXPECTED_FIELDS)}, data_k, data_id FROM expected""")
def events_normalized(spark, sf_dir):
    """The whole event chain."""
    records = cloudevents.normalize_events(http_requests(spark, sf_dir))
    return records.select(
        "event_id", *EXPECTED_FIELDS, member("cloudevent", "data.k", "data_k"),
        member("cloudevent", "data.id", "data_id"),
    )
