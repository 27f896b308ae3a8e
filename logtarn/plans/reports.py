"""Canned reports.

A report maps the records of a stream and its parameters to a result; parameters are declared,
and checked before anything runs.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtarn.functions.times import event_time, iso_text, utc_date
from logtarn.plans.inspect import dataset_schema
from logtarn.plans.query import between_dates

# The two levels that stand for an error.
ERROR_LEVELS = ("error", "err")

#: Traces are numbered in slots of this many seconds; see :func:`trace_walk`.
TRACE_SLOT_SECONDS = 1
#: Slots are put in order by blocks of this power of two of them, a little over an hour.
TRACE_BLOCK_BITS = 12
#: Slots of a trace for rows without a time, and the first of them, before all times.
UNTIMED_SLOTS, UNTIMED_SLOT = 1024, -(2**62)


@dataclass(frozen=True)
class ParamSpec:
    name: str
    description: str
    required: bool = False
    default: Any = None


@dataclass(frozen=True)
class Report:
    name: str
    description: str
    build: Callable[..., DataFrame]
    params: tuple[ParamSpec, ...] = field(default=())

    def resolve(self, given: dict[str, Any]) -> dict[str, Any]:
        """The given parameters with defaults filled in; an error names what does not fit."""
        known = {spec.name: spec for spec in self.params}
        unknown = sorted(set(given) - set(known))
        if unknown:
            raise ValueError(f"report {self.name} has no parameter {', '.join(unknown)}")
        missing = sorted(s.name for s in self.params if s.required and given.get(s.name) is None)
        if missing:
            raise ValueError(f"report {self.name} needs parameter {', '.join(missing)}")
        return {name: given.get(name, spec.default) for name, spec in known.items()}


def with_event_time(records: DataFrame) -> DataFrame:
    """Records with the instant ``event_ts``, which the ``SOURCES`` view has already."""
    if "event_ts" in records.columns:
        return records
    return records.withColumn("event_ts", event_time(F.col("ts")))


def _in_range(
    records: DataFrame,
    since: str | None = None,
    until: str | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
) -> DataFrame:
    records = between_dates(with_event_time(records), from_date, to_date)
    if since is not None:
        start = F.lit(since).cast("timestamp")
        records = records.where(F.col("event_ts") >= start)
        records = _compacted_where(records, F.col("date") >= F.date_sub(utc_date(start), 1))
    if until is not None:
        end = F.lit(until).cast("timestamp")
        records = records.where(F.col("event_ts") < end)
        records = _compacted_where(records, F.col("date") <= F.date_add(utc_date(end), 1))
    return records


def _compacted_where(records: DataFrame, days: Column) -> DataFrame:
    """Skips folders of the compacted tier, which are days of the event in UTC, or off by one where
    another program has named them. Folders of the raw tier tell nothing of the event: they may be
    of the day of receipt, or of no day. Records that don't say their tier stay as they are."""
    try:
        return records.where(~F.col("_compacted") | days)
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        return records


def parse_errors(records: DataFrame, **time_range) -> DataFrame:
    """Records whose message or event could not be parsed."""
    return _in_range(records, **time_range).where(F.col("parse_error").isNotNull())


def _errors(records: DataFrame) -> DataFrame:
    return records.where(F.col("level").isin(*ERROR_LEVELS))


def service_errors(
    records: DataFrame, service: str | None = None, level: str | None = None, **time_range
) -> DataFrame:
    """Log records at an error level, newest first. Events have no level and are refused."""
    errors = _errors(_in_range(records, **time_range))
    if service is not None:
        errors = errors.where(F.col("service") == service)
    if level is not None:
        errors = errors.where(F.col("level") == level)
    return errors.orderBy(F.desc("event_ts"))


def errors_by_service(records: DataFrame, **time_range) -> DataFrame:
    """How many errors each service logged, and when the first and the last."""
    return (
        _errors(_in_range(records, **time_range))
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            iso_text(F.min("event_ts")).alias("first_ts"),
            iso_text(F.max("event_ts")).alias("last_ts"),
        )
    )


def xname_groups(records: DataFrame, **time_range) -> DataFrame:
    """Records, services, errors and last time of each hardware component."""
    is_error = F.col("level").isin(*ERROR_LEVELS)
    return (
        _in_range(records, **time_range)
        .where(F.col("xname").isNotNull())
        .groupBy("xname")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_distinct("service").alias("services"),
            F.count(F.when(is_error, F.lit(1))).alias("errors"),
            iso_text(F.max("event_ts")).alias("last_ts"),
        )
    )


def trace_walk(
    records: DataFrame,
    events: DataFrame | None = None,
    trace_id: str | None = None,
    **time_range,
) -> DataFrame:
    """The hops of each trace through logs and events, numbered in time order.

    A window over a whole trace would put all rows of a busy trace into one task. So a trace is
    cut into slots of time, and these into blocks. Rows are numbered within each slot; one row per
    slot - its row count and last time - is put in order within its block, and one row per block
    over the whole trace. Adding what came before the slot in its block, and before the block, gives
    the very numbers and gaps of the undivided window. No task gets more than the rows of a slot,
    the slots of a block or the blocks of a trace, a few thousand for a year.
    """
    tagged = _trace_rows(_in_range(records, **time_range), "logs", "service")
    if events is not None:
        tagged = tagged.unionByName(
            _trace_rows(_in_range(events, **time_range), "events", "cloudevent_type")
        )
    if trace_id is not None:
        tagged = tagged.where(F.col("trace_id") == trace_id)

    # Rows without a time come first, in slots by a hash of their line.
    slot = F.coalesce(
        F.floor(F.unix_micros("event_ts") / F.lit(TRACE_SLOT_SECONDS * 1_000_000)),
        F.lit(UNTIMED_SLOT) + F.pmod(F.xxhash64("payload_json"), F.lit(UNTIMED_SLOTS)),
    )
    within = Window.partitionBy("trace_id", "slot").orderBy(
        "event_ts", "stream", "payload_json", "service_or_type"
    )
    numbered = tagged.withColumn("slot", slot).withColumns({
        "n": F.row_number().over(within),
        "previous": F.lag("event_ts").over(within),
    })

    # The last row of a slot says all there is to know of it. Kept whole, its columns are those of
    # the rows, so both come from one scan and one exchange.
    whole = ("n", "event_ts", "stream", "service_or_type", "ts", "payload_json")
    slots = numbered.groupBy("trace_id", "slot").agg(F.max(F.struct(*whole)).alias("final"))
    slots = slots.select(
        "trace_id", "slot", F.shiftright("slot", TRACE_BLOCK_BITS).alias("block"),
        F.col("final.n").alias("rows"), F.col("final.event_ts").alias("last"),
    )
    before = _before(slots, ["trace_id", "block"], "slot").join(
        _before(
            slots.groupBy("trace_id", "block").agg(
                F.sum("rows").alias("rows"), F.max_by("last", "slot").alias("last")
            ),
            ["trace_id"],
            "block",
        ).select("trace_id", "block", F.col("before").alias("blocks"), F.col("last_before").alias("last_block")),
        ["trace_id", "block"],
        "left",
    )
    slots = before.select(
        "trace_id", "slot",
        (F.coalesce("before", F.lit(0)) + F.coalesce("blocks", F.lit(0))).alias("before"),
        # The first slot of a block comes after the last of the block before.
        F.when(F.col("before").isNull(), F.col("last_block")).otherwise(F.col("last_before")).alias("last_before"),
    )

    previous = F.when(F.col("n") == 1, F.col("last_before")).otherwise(F.col("previous"))
    gap = F.unix_micros("event_ts") - F.unix_micros(previous)
    # Every row has its slot; an outer join infers no filter that would set the two scans apart.
    return numbered.join(slots, ["trace_id", "slot"], "left").select(
        "trace_id",
        (F.col("n") + F.coalesce("before", F.lit(0))).alias("hop"),
        "stream",
        "service_or_type",
        "ts",
        # Whole milliseconds by integer arithmetic, halves up.
        (F.floor((gap + 500) / 1000) / 1000).alias("gap_seconds"),
    )


def _before(parts: DataFrame, group: list[str], order: str) -> DataFrame:
    """``before``, the rows of the parts of a group before each, null at the first, and
    ``last_before``, the last time of the part before."""
    along = Window.partitionBy(*group).orderBy(order)
    return parts.withColumns({
        "before": F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "last_before": F.lag("last").over(along),
    })


def _trace_rows(records: DataFrame, stream: str, label: str) -> DataFrame:
    line = F.col("payload_json") if "payload_json" in records.columns else F.lit(None)
    return records.where(F.col("trace_id").isNotNull()).select(
        "trace_id",
        F.lit(stream).alias("stream"),
        F.col(label).alias("service_or_type"),
        "ts",
        "event_ts",
        line.cast("string").alias("payload_json"),
    )


_RANGE = (
    ParamSpec("since", "first instant, ISO text"),
    ParamSpec("until", "instant after the last, ISO text"),
    ParamSpec("from_date", "first folder date; skips earlier folders"),
    ParamSpec("to_date", "last folder date; skips later folders"),
)

REPORTS = {
    report.name: report
    for report in (
        Report(
            "find-all-parse-errors",
            "Records that could not be parsed, to find malformed input.",
            parse_errors,
            _RANGE,
        ),
        Report(
            "find-all-service-errors",
            "Log records at an error level, newest first.",
            service_errors,
            (*_RANGE, ParamSpec("service", "one service only"), ParamSpec("level", "one level only")),
        ),
        Report(
            "errors-by-service",
            "Error count and time range of each service.",
            errors_by_service,
            _RANGE,
        ),
        Report(
            "trace-walk",
            "The hops of each trace in time order, with the gap before each.",
            trace_walk,
            (
                *_RANGE,
                ParamSpec("trace_id", "one trace only"),
                ParamSpec("events", "event records to walk along with the logs"),
            ),
        ),
        Report(
            "xname-groups",
            "Records, services and errors of each hardware component.",
            xname_groups,
            _RANGE,
        ),
    )
}


def get_report(name: str) -> Report:
    if name not in REPORTS:
        raise ValueError(f"unknown report: {name}")
    return REPORTS[name]


def run_report(name: str, records: DataFrame, **params) -> DataFrame:
    """Run a report over the records of a stream."""
    report = get_report(name)
    return report.build(records, **report.resolve(params))


def report_schema(name: str, records: DataFrame) -> DataFrame:
    """The columns a report would return; nothing is run."""
    return dataset_schema(run_report(name, records))
