"""Landed input: syslog lines and HTTP requests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.json_text import only_object
from logtarn.functions.let import let
from logtarn.schemas import HTTP_REQUEST
from logtarn.sources.lake import raw_lines

# Syslog severity keywords by number.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
# Syslog facility keywords by number.
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron",
    "authpriv", "ftp", "ntp", "audit", "alert", "clockd",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
# Month abbreviations of the older syslog format.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_PRIORITY = r"^<(\d{1,3})>"
_STRUCTURED_DATA = r"^((?:\[(?:[^\]\\]++|\\[\s\S])*+\])++|-) ?"
_OLD_HEADER = (
    r"^<\d{1,3}>(?:" + "|".join(MONTHS) + r") [ \d]\d \d\d:\d\d:\d\d \S+ "
)
_TAG = r"^([^\s:\[/]+)(?:/[^\s:\[]*)?(?:\[([^\]]*)\])?: ?"


def syslog_records(lines: DataFrame, line: str = "value", received: Column | None = None):
    """Decode syslog lines into ``timestamp, host, appname, severity, message`` and friends.

    The current format (version 1 header) and the older BSD format are understood. A line in
    neither is kept whole as ``message`` with the other fields null. The BSD format has no year:
    the one that puts the time closest before ``received`` (default: now) is taken.
    """
    received = F.current_timestamp() if received is None else received
    text = F.rtrim(F.col(line), F.lit("\r"))
    carried = [c for c in lines.columns if c != line]
    decoded = F.when(F.rlike(text, F.lit(r"^<\d{1,3}>1 ")), _current_format(text)).when(
        F.rlike(text, F.lit(_OLD_HEADER)), _bsd_format(text, received)
    ).otherwise(_record(message=text))
    return lines.select(decoded.alias("_r"), *carried).select(
        *[F.col(f"_r.{name}") for name in _FIELDS], *carried
    )


_FIELDS = (
    "timestamp", "host", "appname", "procid", "msgid", "facility", "severity", "message",
)


def _record(**values: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(*[values.get(name, null).alias(name) for name in _FIELDS])


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit("-"))


def _keyword(names: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), number.cast("int"))


def _priority(text: Column) -> Column:
    return F.regexp_extract(text, _PRIORITY, 1).cast("int")


def _current_format(text: Column) -> Column:
    # Six blanks end the header fields; the seventh part is structured data and message. One
    # split reads them all, where one pattern group per field would scan the line eight times.
    def from_parts(parts: Column) -> Column:
        rest = F.coalesce(F.get(parts, F.lit(6)), F.lit(""))
        message = F.when(F.startswith(rest, F.lit("- ")), F.substring(rest, F.lit(3), F.length(rest)))
        message = message.otherwise(F.regexp_replace(rest, _STRUCTURED_DATA, ""))
        return _record(
            timestamp=_given(F.get(parts, F.lit(1))),
            host=_given(F.get(parts, F.lit(2))),
            appname=_given(F.get(parts, F.lit(3))),
            procid=_given(F.get(parts, F.lit(4))),
            msgid=_given(F.get(parts, F.lit(5))),
            facility=_keyword(FACILITIES, F.floor(_priority(text) / 8)),
            severity=_keyword(SEVERITIES, _priority(text) % 8),
            message=message,
        )

    return let(F.split(text, " ", 7), from_parts)


def _bsd_format(text: Column, received: Column) -> Column:
    body = F.regexp_replace(text, _PRIORITY, "")

    def from_body(b: Column) -> Column:
        after_time = F.substring(b, F.lit(17), F.length(b))
        host = F.substring_index(after_time, " ", 1)
        rest = F.substring(after_time, F.length(host) + 2, F.length(after_time))
        tag = F.nullif(F.regexp_extract(rest, _TAG, 1), F.lit(""))
        return _record(
            timestamp=_bsd_time(b, received),
            host=host,
            appname=tag,
            procid=F.nullif(F.regexp_extract(rest, _TAG, 2), F.lit("")),
            facility=_keyword(FACILITIES, F.floor(_priority(text) / 8)),
            severity=_keyword(SEVERITIES, _priority(text) % 8),
            message=F.regexp_replace(rest, _TAG, ""),
        )

    return let(body, from_body)


def _bsd_time(body: Column, received: Column) -> Column:
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(body, 1, 3))
    day = F.trim(F.substring(body, 5, 2))

    def in_year(year: Column) -> Column:
        written = F.concat_ws(
            "-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")
        )
        return F.concat(written, F.lit("T"), F.substring(body, 8, 8), F.lit(".000000Z"))

    # The last year in which it is a time before receipt, or at most a day after, since clocks
    # differ. Four years back there has been a 29 February, but for the turn of some centuries.
    def fits(stamp: Column) -> Column:
        return stamp.try_cast("timestamp") <= received + F.expr("INTERVAL 1 DAY")

    years = F.transform(
        F.sequence(F.lit(-1), F.lit(8)), lambda back: in_year(F.year(received) - back)
    )
    return F.get(F.filter(years, fits), F.lit(0))


def read_syslog(spark: SparkSession, path: str) -> DataFrame:
    """Decode the syslog lines of all files under ``path``."""
    return syslog_records(raw_lines(spark.read, path))


def stream_syslog(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same over files as they land."""
    return syslog_records(raw_lines(spark.readStream.options(**options), path))


def request_records(lines: DataFrame) -> DataFrame:
    """Landed requests of JSON lines (``value``), one object each.

    A line that is not one JSON object has its text in ``unread`` and nothing else. Blank lines
    are left out.
    """
    fields = {f.name: f.dataType.simpleString() for f in HTTP_REQUEST}
    text = F.col("value")
    read = lines.where(F.btrim(text, F.lit(" \t\r")) != "").withColumn("_r", only_object(text, fields))
    return read.select(
        *[F.col(f"_r.{name}").alias(name) for name in fields],
        F.when(F.col("_r").isNull(), text).alias("unread"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """HTTP requests landed as JSON objects, one per line."""
    return request_records(raw_lines(spark.read, path))


def stream_requests(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same over files as they land."""
    return request_records(raw_lines(spark.readStream.options(**options), path))
