"""Normalisation of CloudEvents received over HTTP."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtarn.functions.json_text import (
    members,
    object_fields,
    only_object,
    only_value,
    trimmed,
    with_members,
)
from logtarn.schemas import EVENT_FIELDS

# Request headers kept as transport metadata, and their stored names.
TRANSPORT_HEADERS = {
    "accept-encoding": "accept_encoding",
    "content-length": "content_length",
    "content-type": "content_type",
    "user-agent": "user_agent",
    "host": "host",
    "path": "path",
}
# Prefix of the headers that carry event attributes.
ATTRIBUTE_PREFIX = "ce-"
# Event attributes that get a column of their own.
PROMOTED = ("id", "source", "type", "specversion")
# The source type that has a parser, and the error of records that were not parsed.
HTTP_SOURCE = "http_server"
NO_PATH = "no sanitization path for the received cloudevent exists"

_REQUEST_FIELDS = ("source_type", "timestamp", "message")
_GIVEN = dict.fromkeys(PROMOTED, "string")


def prepare(landed: DataFrame) -> DataFrame:
    """Move the whole request into ``raw`` and start the event fields at their defaults.

    ``raw``, ``transport_metadata`` and ``cloudevent`` are JSON text from the start, so they never
    have to be encoded.
    """
    null = F.lit(None).cast("string")
    known = {name: null for name in EVENT_FIELDS if name != "payload_json"}
    known |= {
        "ts": F.col("timestamp"),
        "transport_metadata": F.lit("{}"),
        "cloudevent": F.lit('{"data":{}}'),
        "raw": _request(),
    }
    if "unread" in landed.columns:  # a landed line that is no request: nothing of it is lost
        known["raw"] = F.coalesce(F.col("unread"), known["raw"])
    carried = [c for c in landed.columns if c not in ("timestamp", "unread", *known, "payload_json")]
    return landed.select(*[value.alias(name) for name, value in known.items()], *carried)


def is_routed(source_type: Column) -> Column:
    """Whether a record has a parser; all others are unmatched."""
    return F.coalesce(source_type == HTTP_SOURCE, F.lit(False))


def route(records: DataFrame) -> DataFrame:
    """Add the ``route`` of each record."""
    return records.withColumn(
        "route", F.when(is_routed(F.col("source_type")), "http").otherwise("_unmatched")
    )


def transport_metadata(headers: Column) -> Column:
    """The transport headers that are present, under their stored names, as JSON."""
    return F.to_json(
        F.struct(*[headers[header].alias(name) for header, name in TRANSPORT_HEADERS.items()]),
        {"ignoreNullFields": "true"},
    )


def attributes(headers: Column) -> Column:
    """Event attributes carried in headers, without their prefix."""
    carried = F.map_filter(headers, lambda k, v: F.startswith(k, F.lit(ATTRIBUTE_PREFIX)))
    return F.transform_keys(
        carried, lambda k, v: F.substring(k, F.lit(len(ATTRIBUTE_PREFIX) + 1), F.length(k))
    )


def binding(attrs: Column) -> Column:
    """``binary`` when attributes travel in headers, else ``structured``."""
    return F.when(F.size(attrs) > 0, "binary").otherwise("structured")


def merged_event(attrs: Column, body: Column, body_keys: Column) -> Column:
    """The event as JSON: attributes from headers, overlaid with a checked body.

    ``body_keys`` are the members of a body that is an object, else null. Members of a body that
    has ``data`` replace attributes of the same name. A body without ``data`` is itself the data.
    Without a body the data is empty unless a header gives it.
    """
    wraps_data = F.coalesce(F.array_contains(body_keys, F.lit("data")), F.lit(False))
    kept = F.map_filter(attrs, lambda k, v: ~F.array_contains(body_keys, k))
    no_data = F.map_filter(attrs, lambda k, v: k != "data")
    return (
        F.when(wraps_data, with_members(F.to_json(kept), members(body)))
        .when(
            body.isNotNull(),
            with_members(F.to_json(no_data), F.concat(F.lit('"data":'), body)),
        )
        .when(F.map_contains_key(attrs, "data"), F.to_json(attrs))
        .otherwise(with_members(F.to_json(attrs), F.lit('"data":{}')))
    )


def sanitize(records: DataFrame) -> DataFrame:
    """Read the event out of headers and body.

    A record of another source, or one whose body is not JSON, keeps every default: nothing is
    taken from its headers either.
    """
    return _sanitize(records).drop("_given")


def _sanitize(records: DataFrame) -> DataFrame:
    """The same with the attributes to be promoted in ``_given``."""
    message, routed = F.col("message"), is_routed(F.col("source_type"))
    read = records.withColumns({
        "_read": F.when(routed & (message != ""), only_object(message, _GIVEN)),
        "_attrs": F.when(routed, attributes(_headers())),
    })
    # An object is read once, for the check and its attributes; other values are checked alone.
    staged = read.withColumn(
        "_body",
        F.when(F.col("_read").isNotNull(), trimmed(message)).when(
            routed & (message != ""), only_value(message)
        ),
    )
    attrs, body, top = F.col("_attrs"), F.col("_body"), F.col("_read")
    readable = routed & F.coalesce((message == "") | body.isNotNull(), F.lit(False))
    keyed = staged.withColumn("_keys", F.json_object_keys(F.when(top.isNotNull(), body)))
    keys = F.col("_keys")
    wraps_data = F.coalesce(F.array_contains(keys, F.lit("data")), F.lit(False))

    def when_read(value: Column, name: str) -> Column:
        return F.when(readable, value).otherwise(F.col(name))

    given = F.struct(*[
        F.when(wraps_data & F.array_contains(keys, F.lit(name)), top[name])
        .otherwise(attrs[name]).alias(name)
        for name in PROMOTED
    ])
    return keyed.withColumns({
        "transport_method": when_read(F.lit("http"), "transport_method"),
        "transport_metadata": when_read(transport_metadata(_headers()), "transport_metadata"),
        "cloudevent": when_read(merged_event(attrs, body, keys), "cloudevent"),
        "cloudevent_binding": when_read(binding(attrs), "cloudevent_binding"),
        "_given": F.when(readable, given),
    }).drop("_read", "_body", "_attrs", "_keys")


def promote(records: DataFrame) -> DataFrame:
    """Fill the event columns that are null from the event's members."""
    return _promote(
        records.withColumn("_given", object_fields(F.col("cloudevent"), _GIVEN))
    )


def _promote(records: DataFrame) -> DataFrame:
    return records.withColumns({
        f"cloudevent_{name}": F.coalesce(f"cloudevent_{name}", f"_given.{name}")
        for name in PROMOTED
    }).drop("_given")


def flag_unparsed(records: DataFrame) -> DataFrame:
    """Note an error on records that no parser has read."""
    return records.withColumn(
        "parse_error",
        F.when(
            F.col("transport_method").isNull() & F.col("parse_error").isNull(), F.lit(NO_PATH)
        ).otherwise(F.col("parse_error")),
    )


def normalize_events(landed: DataFrame) -> DataFrame:
    """Landed HTTP requests to lake records. The request itself lives on in ``raw`` only."""
    records = _promote(_sanitize(prepare(landed)))
    return flag_unparsed(records).drop("headers", "message")


def _headers() -> Column:
    return F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))


def _request() -> Column:
    """The request as one flat JSON object: its own fields and every header."""
    own = F.create_map(*[part for name in _REQUEST_FIELDS for part in (F.lit(name), F.col(name))])
    # A header named like one of the request's own fields gives way to it. Hardly any is, and
    # looking is cheaper than filtering.
    headers = _headers()
    clash = reduce(or_, [F.map_contains_key(headers, name) for name in _REQUEST_FIELDS])
    others = F.map_filter(headers, lambda k, v: ~k.isin(*_REQUEST_FIELDS))
    return F.when(clash, F.to_json(F.map_concat(others, own))).otherwise(
        F.to_json(F.map_concat(headers, own))
    )
