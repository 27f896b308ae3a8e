import json

import pytest
from pyspark.sql import functions as F

from logtarn.functions.logfmt import full_json, plain_json
from logtarn.operators import logs
from logtarn.operators.relay import ALLOWED_SERVICES, allow_listed
from logtarn.sources.landing import syslog_records

INPUT = "timestamp string, appname string, severity string, host string, message string"


def normalized(spark, service, message):
    rows = [("2024-01-01T00:00:00Z", service, "info", "h", message)]
    return logs.normalize_logs(spark.createDataFrame(rows, INPUT)).first()


@pytest.mark.parametrize("message, stripped", [
    ("#033[1mb", "b"),
    ("\x1b[31mred\x1b[0m plain", "red plain"),
    ("\x1b[38;5;1mx #033[Ky", "x y"),
    ("no escapes [31m", "no escapes [31m"),
])
def test_terminal_escapes_are_stripped(spark, message, stripped):
    assert normalized(spark, "postgres", message).msg == stripped


@pytest.mark.parametrize("message, node_id, xname", [
    ("anynid=5", "5", None),
    ("NID \t 7A, xname=x1000-c0", "7a", "x1000"),
    ("nid: 5", None, None),
    ("nid==\n9 nid=8", "9", None),
    ("XName\u00a0X3000C0", None, "x3000c0"),
    ("nid=4\u212a!", "4k", None),
    ("", None, None),
])
def test_message_is_searched(spark, message, node_id, xname):
    row = normalized(spark, "postgres", message)
    assert (row.node_id, row.xname, row.parse_error) == (node_id, xname, None)


@pytest.mark.parametrize("message, data, failed", [
    ('{"a": 1.50, "b": [1]}', {"a": 1.5, "b": [1]}, False),
    ("5", 5, False),
    ('"x"', "x", False),
    ("null", None, False),
    ("", {}, False),
    ("not json", {}, True),
    ('{"a":1} junk', {}, True),
    ('{"a":1},{"b":2}', {}, True),
    ('{"a":1}]', {}, True),
    ('{"a":1', {}, True),
])
def test_json_messages(spark, message, data, failed):
    row = normalized(spark, "opaal", message)
    assert json.loads(row.data) == data
    assert (row.parse_error is not None) == failed


def test_json_values_that_are_not_text_are_promoted_as_text_unless_the_message_has_better(spark):
    assert normalized(spark, "opaal", '{"node_id":7}').node_id == "7"
    assert normalized(spark, "opaal", '{"node_id":7,"m":"nid=x9"}').node_id == "x9"
    assert normalized(spark, "opaal", '{"node_id":"7","m":"nid=x9"}').node_id == "7"
    assert normalized(spark, "opaal", '{"request_id":null,"request_user":"u"}').request_user is None
    assert normalized(spark, "opaal", '{"trace_id":{"a":1}}').trace_id == '{"a":1}'
    assert normalized(spark, "opaal", '{"trace_\\u0069d":"t"}').trace_id == "t"
    assert normalized(spark, "opaal", '[{"trace_id":"t"}]').trace_id is None


@pytest.mark.parametrize("message, data", [
    ('level=info msg="hello \\"q\\" world" flag', {"level": "info", "msg": 'hello "q" world', "flag": True}),
    ("a=1 a=2", {"a": ["1", "2"]}),
    ("b a=1 a a=3 b", {"b": [True, True], "a": ["1", True, "3"]}),
    ("x=", {"x": ""}),
    ("user= msg=hi", {"user": "msg=hi"}),
    ("a = b c", {"a": "b", "c": True}),
    ('a="x"y b', {"a": '"x"y', "b": True}),
    ('a="unclosed b=1', {"a": '"unclosed', "b": "1"}),
    ('"quoted key"=v', {"quoted key": "v"}),
    ('"quoted key" v', {'"quoted': True, 'key"': True, "v": True}),
    ("path=C:\\new", {"path": "C:\\new"}),
    ('m="one\\ntwo \\\\n"', {"m": "one\ntwo \\n"}),
    ("a=b=c", {"a": "b=c"}),
    ("tab\there=1", {"tab\there": "1"}),
    ("  lead=1   trail=2  ", {"lead": "1", "trail": "2"}),
    ("k=\u00fc\u4e2d flag\u00e9", {"k": "\u00fc\u4e2d", "flag\u00e9": True}),
    ("mark=\x01 bare", {"mark": "\x01", "bare": True}),
    ('a="" b', {"a": "", "b": True}),
    ("a,b:c d=1,", {"a,b:c": True, "d": "1,"}),
])
def test_logfmt_messages(spark, message, data):
    row = normalized(spark, "smd", message)
    assert json.loads(row.data) == data
    assert row.parse_error is None


@pytest.mark.parametrize("message", ["=x", "a=1 =b", "   ", "a =  =b ="])
def test_text_that_is_not_logfmt(spark, message):
    row = normalized(spark, "smd", message)
    if row.parse_error is not None:
        assert row.data == "{}"
    else:
        assert message.startswith("a =")


def test_both_ways_through_logfmt_agree_on_words_of_real_text(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = documents.select(F.posexplode(F.split("text", r"\s+")).alias("n", "w")).where("w <> ''")
    value = (
        F.when(F.col("n") % 4 == 0, F.col("w"))
        .when(F.col("n") % 4 == 1, F.concat(F.lit("k="), F.col("w")))
        .when(F.col("n") % 4 == 2, F.concat(F.col("w"), F.lit('="a \\"b\\" = c"')))
        .otherwise(F.concat(F.col("w"), F.lit("=1 flag z=")))
    )
    messages = words.select(value.alias("m")).distinct()
    ways = messages.select(
        "m", F.to_json(F.try_parse_json(plain_json(F.col("m")))).alias("plain"),
        full_json(F.col("m")).alias("full"),
    ).where("plain IS NOT NULL")
    assert ways.count() > 1000
    assert ways.where("NOT plain <=> full").take(3) == []


def test_long_free_text_is_parsed_whole(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    longest = documents.orderBy(F.desc("n_chars")).limit(3).select("text")
    parsed = longest.select("text", full_json(F.col("text")).alias("data")).collect()
    for row in parsed:
        keys = json.loads(row.data)
        assert row.text.rstrip(" ").split(" ")[-1].strip().split("=")[0] in keys


def test_long_quoted_value_does_not_exhaust_the_stack(spark):
    message = 'a="' + 'x\\"' * 100_000 + '" b'
    assert json.loads(normalized(spark, "smd", message).data)["a"] == 'x"' * 100_000


def test_carried_fields_and_columns(spark):
    rows = [("t", "smd", "info", "h", "a=1", "9")]
    frame = spark.createDataFrame(rows, INPUT + ", procid string")
    record = logs.normalize_logs(frame)
    assert record.columns == [*logs.LOG_FIELDS[:-1], "procid"]
    assert record.first().procid == "9"


def test_allow_list(spark):
    frame = spark.createDataFrame([(s,) for s in (*ALLOWED_SERVICES, "sshd", None)], "appname string")
    assert allow_listed(frame).count() == len(ALLOWED_SERVICES) == 19


def test_syslog_formats(spark):
    lines = [
        '<165>1 2024-10-11T22:14:15.003Z host app 12 ID47 [x@1 a="b \\] c"][y@2] said hello',
        "<27>1 2024-10-11T22:14:15Z h smd - - - a b",
        "<13>1 2024-10-11T22:14:15Z h smd - - -",
        "<34>Oct  1 22:14:15 mymachine su[123]: failed for x",
        "<34>Dec 31 23:59:59 m smd: late",
        "free text",
    ]
    received = F.lit("2025-01-01 00:00:10").cast("timestamp")
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = syslog_records(frame, received=received).collect()
    full = rows[0]
    assert (full.host, full.appname, full.procid, full.msgid) == ("host", "app", "12", "ID47")
    assert (full.facility, full.severity, full.message) == ("local4", "notice", "said hello")
    assert (rows[1].facility, rows[1].severity, rows[1].message, rows[1].procid) == (
        "daemon", "err", "a b", None)
    assert rows[2].message == ""
    old = rows[3]
    assert (old.timestamp, old.host, old.appname, old.procid, old.message) == (
        "2024-10-01T22:14:15.000000Z", "mymachine", "su", "123", "failed for x")
    assert rows[4].timestamp == "2024-12-31T23:59:59.000000Z"
    assert (rows[5].message, rows[5].appname) == ("free text", None)


def test_no_step_shuffles_or_splits(spark):
    rows = [("t", "smd", "info", "h", "a=1")]
    plan = logs.normalize_logs(spark.createDataFrame(rows, INPUT))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Union" not in text and "Python" not in text.replace(
        "ExistingRDD", "")
