"""Record shapes of the two streams."""

from pyspark.sql.types import MapType, StringType, StructField, StructType

STREAMS = ("logs", "events")
SCOPES = ("all", "compacted", "recent")

# Column names and order of the compacted records.
LOG_FIELDS = (
    "ts", "service", "host", "level", "msg", "data", "xname", "component_id", "node_id",
    "trace_id", "request_id", "request_uri", "request_user", "parse_error", "payload_json",
)
EVENT_FIELDS = (
    "ts", "transport_method", "transport_metadata", "cloudevent", "cloudevent_id",
    "cloudevent_source", "cloudevent_type", "cloudevent_specversion", "cloudevent_binding",
    "xname", "component_id", "node_id", "trace_id", "request_id", "request_uri", "request_user",
    "raw", "parse_error", "payload_json",
)
# The columns that hold JSON text.
PAYLOAD_COLUMN = {"logs": "data", "events": "cloudevent"}


def strings(names) -> StructType:
    return StructType([StructField(name, StringType(), True) for name in names])


LOGS = strings(LOG_FIELDS)
EVENTS = strings(EVENT_FIELDS)

#: A landed HTTP request: the body as text and every header.
HTTP_REQUEST = StructType([
    StructField("source_type", StringType(), True),
    StructField("timestamp", StringType(), True),
    StructField("headers", MapType(StringType(), StringType()), True),
    StructField("message", StringType(), True),
])


def check_stream(stream: str) -> str:
    if stream not in STREAMS:
        raise ValueError(f"invalid data stream: {stream!r}, expected one of {STREAMS}")
    return stream


def check_scope(scope: str) -> str:
    if scope not in SCOPES:
        raise ValueError(f"invalid data scope: {scope!r}, expected one of {SCOPES}")
    return scope


def record_schema(stream: str) -> StructType:
    return LOGS if check_stream(stream) == "logs" else EVENTS


def record_fields(stream: str) -> tuple[str, ...]:
    return LOG_FIELDS if check_stream(stream) == "logs" else EVENT_FIELDS
