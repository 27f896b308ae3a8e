import json

import pytest

from logtarn.operators.cloudevents import NO_PATH, normalize_events, promote
from logtarn.schemas import EVENT_FIELDS, HTTP_REQUEST

BINARY = {"ce-id": "1", "ce-source": "/s", "ce-type": "t", "ce-specversion": "1.0",
          "content-type": "application/json", "accept-encoding": "gzip"}


def event(spark, headers, message, source="http_server"):
    frame = spark.createDataFrame([(source, "2024-01-01T00:00:00Z", headers, message)], HTTP_REQUEST)
    records = normalize_events(frame)
    assert records.columns == [*EVENT_FIELDS[:-1], "source_type"]
    return records.first()


def body(row):
    return json.loads(row.cloudevent)


def test_binary_event(spark):
    row = event(spark, BINARY, '{"k": 1}')
    assert (row.cloudevent_id, row.cloudevent_source, row.cloudevent_type) == ("1", "/s", "t")
    assert (row.cloudevent_binding, row.transport_method) == ("binary", "http")
    assert body(row) == {"id": "1", "source": "/s", "type": "t", "specversion": "1.0", "data": {"k": 1}}
    assert json.loads(row.transport_metadata) == {
        "accept_encoding": "gzip", "content_type": "application/json"}
    raw = json.loads(row.raw)
    assert raw["message"] == '{"k": 1}' and raw["ce-id"] == "1" and raw["source_type"] == "http_server"


def test_structured_event(spark):
    row = event(spark, {"host": "h"}, ' {"id":"9","data":{"x":[1,{"y":null}]},"ext":{"n":1}} ')
    assert body(row) == {"id": "9", "data": {"x": [1, {"y": None}]}, "ext": {"n": 1}}
    assert (row.cloudevent_id, row.cloudevent_binding, row.cloudevent_type) == ("9", "structured", None)


def test_body_members_replace_headers(spark):
    row = event(spark, BINARY, '{"data":null,"type":"over","id":7}')
    assert body(row) == {"source": "/s", "specversion": "1.0", "data": None, "type": "over", "id": 7}
    assert (row.cloudevent_type, row.cloudevent_id) == ("over", "7")


def test_null_member_hides_the_header(spark):
    assert event(spark, BINARY, '{"data":1,"id":null}').cloudevent_id is None


def test_structured_body_without_data_is_the_data(spark):
    row = event(spark, {}, '{"id":"9"}')
    assert body(row) == {"data": {"id": "9"}} and row.cloudevent_id is None


@pytest.mark.parametrize("message", ["5", '"x"', "[1, 2]", "true", "null"])
def test_body_of_another_kind_is_the_data(spark, message):
    row = event(spark, BINARY, message)
    assert body(row)["data"] == json.loads(message) and row.cloudevent_id == "1"


def test_empty_body(spark):
    assert body(event(spark, {"ce-id": "1"}, "")) == {"id": "1", "data": {}}
    assert body(event(spark, {"ce-data": "d"}, "")) == {"data": "d"}
    assert body(event(spark, {"ce-data": "d"}, "1")) == {"data": 1}
    assert body(event(spark, {}, "")) == {"data": {}}


@pytest.mark.parametrize("message", ['{"id":', '{"data":1} x', '{"data":1},{"a":2}', None, " "])
def test_unreadable_body_keeps_defaults(spark, message):
    row = event(spark, BINARY, message)
    assert (row.parse_error, row.transport_method, row.cloudevent_id) == (NO_PATH, None, None)
    assert (row.transport_metadata, row.cloudevent) == ("{}", '{"data":{}}')
    assert json.loads(row.raw)["message"] == message


def test_other_sources_are_not_read(spark):
    row = event(spark, BINARY, '{"k":1}', source="file")
    assert (row.parse_error, row.cloudevent_binding) == (NO_PATH, None)
    assert event(spark, None, "", source=None).parse_error == NO_PATH


def test_header_that_clashes_with_a_request_field(spark):
    raw = json.loads(event(spark, {"message": "header", "a": "b"}, "1").raw)
    assert raw["message"] == "1" and raw["a"] == "b"


def test_prefix_is_case_sensitive(spark):
    assert event(spark, {"CE-id": "1"}, "").cloudevent_binding == "structured"


def test_promotion_from_event_text(spark):
    row = spark.createDataFrame(
        [('{"id":"e","type":null}', None, "kept", None, None)],
        "cloudevent string, cloudevent_id string, cloudevent_source string, cloudevent_type string,"
        "cloudevent_specversion string",
    )
    out = promote(row).first()
    assert (out.cloudevent_id, out.cloudevent_source, out.cloudevent_type) == ("e", "kept", None)
