"""Times held as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000  # microseconds

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def event_time(ts: Column) -> Column:
    """The instant a text time stands for, null when it is not a time."""
    return ts.try_cast("timestamp")


def event_date(ts: Column) -> Column:
    """The UTC day of a text time, null when it is not a time; whatever the session time zone."""
    return utc_date(event_time(ts))


def utc_date(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / _DAY).cast("int"))


def event_hour(ts: Column) -> Column:
    """The two-digit UTC hour of a text time, null when it is not a time."""
    hour = F.floor(F.pmod(F.unix_micros(event_time(ts)), F.lit(_DAY)) / (_DAY // 24))
    return F.lpad(hour.cast("string"), 2, "0")


def iso_text(instant: Column) -> Column:
    """An instant as ISO text in UTC, whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), ISO_MICROS)
