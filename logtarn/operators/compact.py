"""Compaction of raw objects into Parquet."""

from hashlib import sha256
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.json_text import STRICT, is_text_or_null, only_object
from logtarn.functions.times import event_date, event_time
from logtarn.plans.totals import write_totals
from logtarn.schemas import record_fields, strings
from logtarn.session import work_area
from logtarn.sources.lake import (
    QUARANTINE,
    Lake,
    catalogue_fields,
    compacted_objects,
    load,
    open_lines,
    raw_objects,
    read_raw_lines,
    read_status,
    uncleared_runs,
    unfinished,
)
from logtarn.sources.marks import drop, drop_mark, exists, marks, put_mark, read_mark
from logtarn.sources.objects import clear_away, folder_batch, folder_day
from logtarn.sources.sinks import write_compacted

#: Batches that readers leave out by name; the objects of more are looked up.
LISTED_BATCHES = 4096

BLANK = "blank line"
NOT_OBJECT = "not one JSON object"


def stored_fields(stream: str) -> tuple[str, ...]:
    """The record fields that are read from a line; the line itself becomes ``payload_json``."""
    return tuple(name for name in record_fields(stream) if name != "payload_json")


def check_lines(lines: DataFrame, stream: str) -> DataFrame:
    """Say in ``reason`` why a line cannot be stored, null if it can.

    A line must be exactly one JSON object whose record fields are all text, null or absent. The
    fields are read as VARIANTs, which keep their type.
    """
    fields = stored_fields(stream)
    # Made a row of its own by a generator, as in read_raw, the record is parsed once: filters on the
    # reason stay above it, where they would repeat an ordinary projection for each field.
    record = only_object(F.col("value"), dict.fromkeys(fields, "variant"))
    read = lines.select("*", F.explode(F.array(record)).alias("_record"))
    odd_field = F.coalesce(*[
        F.when(~is_text_or_null(F.col(f"_record.{name}")), F.lit(f"field {name} is not text"))
        for name in fields
    ])
    reason = (
        F.when(F.btrim("value", F.lit(" \t\r")) == "", F.lit(BLANK))
        .when(F.col("_record").isNull(), F.lit(NOT_OBJECT))
        .otherwise(odd_field)
    )
    return read.withColumn("reason", reason).drop("_record")


def object_status(checked: DataFrame) -> DataFrame:
    """Lines and bad lines of each raw object. Partial sums are made before the shuffle."""
    return checked.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"), F.count("reason").alias("bad_lines")
    )


def project_records(lines: DataFrame, stream: str) -> DataFrame:
    """The fixed record fields, the whole line, and where the line came from.

    ``date`` is the UTC day of the event, or of the raw folder for records without a time, and
    ``event_ts`` its instant.
    """
    folder = folder_day(F.col("source_file")).try_cast("date")
    fields = stored_fields(stream)
    record = F.from_json("value", ",".join(f"`{name}` string" for name in fields), STRICT)
    return lines.withColumn("_record", record).select(
        *[F.col(f"_record.{name}").alias(name) for name in fields],
        F.col("value").alias("payload_json"),
        "source_file",
        F.current_date().cast("string").alias("compacted_on"),
        event_time(F.col("_record.ts")).alias("event_ts"),
        F.coalesce(event_date(F.col("_record.ts")), folder).alias("date"),
    )


def set_aside(checked: DataFrame) -> DataFrame:
    """The quarantine form of checked lines."""
    return checked.select(F.col("value").alias("line"), "source_file", "reason")


def compact_lines(
    lines: DataFrame, lake: Lake, stream: str, batch: str, salvage: bool = False
) -> None:
    """Store the lines of one batch, object by object, all or nothing.

    An object with a bad line is not stored and not marked as compacted, so it stays where it is,
    readable, and is checked again by the next run. With ``salvage`` its sound lines are stored and
    the bad lines alone go to the quarantine. The batch name makes the run repeatable: its output
    replaces all that an earlier attempt at the same batch has left. What is stored, set aside and
    marked as compacted counts at once, when the mark of the attempt is taken away.
    """
    spark = lines.sparkSession
    put_mark(spark, lake.attempts(stream), batch)
    checked = check_lines(lines, stream)

    # The verdict on each object must be known before its first row is written. It is one small
    # row per object, kept as a table; reading twice costs less than storing every parsed row.
    verdicts = work_area(spark, "object-status")
    object_status(checked).write.parquet(verdicts)
    status = spark.read.parquet(verdicts)
    # Only objects that were judged, so none that has come since is stored without a mark. Their
    # lines are not checked again but for those of flawed objects, when these are salvaged.
    stored = _lines_of(lines, status.where("bad_lines = 0"))
    if salvage:
        again = check_lines(_lines_of(lines, status.where("bad_lines > 0")), stream)
        stored = stored.unionByName(again.where(F.col("reason").isNull()).drop("reason"))
        rejected = again.where(F.col("reason").isNotNull())
        _replace_batch(set_aside(rejected), lake.quarantine(stream), batch)
    else:
        drop(spark, f"{lake.quarantine(stream)}/batch={batch}")
    write_compacted(project_records(stored, stream), lake.compacted(stream), batch)
    write_totals(spark, lake, stream, batch)
    compacted = F.lit(True) if salvage else F.col("bad_lines") == 0
    found = status.withColumns({
        "compacted": compacted, "day": folder_day(F.col("source_file")),
    })
    _replace_batch(found, lake.object_status(stream), batch, "day")
    names = _whole_batches(found)
    others = found.where(F.col("compacted") & ~folder_batch(F.col("source_file")).isin(*names))
    put_mark(spark, lake.uncleared(stream), batch, batches=names, others=not others.isEmpty())
    drop(spark, verdicts)
    drop_mark(spark, lake.attempts(stream), batch)


def _lines_of(lines: DataFrame, objects: DataFrame) -> DataFrame:
    named = objects.select(F.col("source_file").alias("_object"))
    return lines.join(named, F.col("source_file").eqNullSafe(F.col("_object")), "left_semi")


def _whole_batches(status: DataFrame) -> list[str]:
    """Batches of the raw tier of which every object was compacted, up to :data:`LISTED_BATCHES`."""
    of = status.groupBy(folder_batch(F.col("source_file")).alias("of"))
    whole = of.agg(F.bool_and("compacted").alias("whole")).where("whole AND of <> ''")
    return sorted(row.of for row in whole.select("of").limit(LISTED_BATCHES).collect())


def settle(spark: SparkSession, lake: Lake, stream: str) -> None:
    """Undo what runs that died have left, and delete what complete ones have replaced.

    Nothing of a run counts before it is complete, so undoing it loses nothing: its objects are raw
    still, the lines it retried are in quarantine still, the files it merged are there. Deleting can
    itself be repeated, the mark goes last. Every run begins with this.
    """
    written = (lake.compacted(stream), lake.totals(stream), lake.object_status(stream), lake.quarantine(stream))
    for batch in unfinished(spark, lake, stream):
        for folder in written:
            drop(spark, f"{folder}/batch={batch}")
        for record in (lake.uncleared(stream), lake.replaced(stream), lake.attempts(stream)):
            drop_mark(spark, record, batch)
    for batch in marks(spark, lake.replaced(stream)):
        gone = read_mark(spark, lake.replaced(stream), batch)
        for part in gone["parts"]:
            of, _, day = part.partition("/")
            drop(spark, f"{lake.compacted(stream)}/batch={of}/date={day or _NO_PARTITION}")
        for of in gone["quarantined"]:
            drop(spark, f"{lake.quarantine(stream)}/batch={of}")
        drop_mark(spark, lake.replaced(stream), batch)


#: Fixed value: the folder Spark writes rows to whose partition value is null.
_NO_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def compact_raw(
    spark: SparkSession,
    lake: Lake,
    stream: str,
    batch: str | None = None,
    salvage: bool = False,
) -> None:
    """Compact every raw object that is not compacted yet, as one batch.

    A run that died is undone first, see :func:`settle`; its objects are taken by this one. A batch
    that is complete cannot be run again. Without a raw tier there is nothing to do. Runs over one
    stream go one after the other.
    """
    settle(spark, lake, stream)
    if batch is not None and exists(spark, f"{lake.object_status(stream)}/batch={batch}"):
        raise ValueError(f"batch {batch!r} of {stream} is complete")
    lines = open_lines(spark, lake, stream)
    if not lines.isEmpty():
        catalogue_fields(spark, lake, stream)
        compact_lines(lines, lake, stream, batch or uuid4().hex, salvage)


def clear_compacted(
    spark: SparkSession, lake: Lake, stream: str, archive: bool = True
) -> int:
    """Move raw objects that are compacted to the archive, or delete them; how many there were.

    Rejected objects stay. Objects now in the raw tier are listed, not opened, so the work follows
    the tier and not its history.
    """
    runs = uncleared_runs(spark, lake, stream)
    if not runs:
        return 0
    names = raw_objects(spark, lake.raw(stream))
    gone = names.join(compacted_objects(spark, lake, stream), ["day", "source_file"], "left_semi")
    cleared = clear_away(gone, lake.raw(stream), lake.archive(stream) if archive else None)
    for batch in runs:
        drop_mark(spark, lake.uncleared(stream), batch)
    return cleared


def read_quarantine(spark: SparkSession, lake: Lake, stream: str) -> DataFrame:
    """The lines compaction could not store: all lines of rejected objects, as they are now, and
    the bad lines that salvaging has set aside, but for those that a retry has stored."""
    status = read_status(spark, lake, stream)
    rejected = status.where("NOT compacted").select("source_file").distinct().join(
        status.where("compacted").select("source_file"), "source_file", "left_anti"
    )
    lines = read_raw_lines(spark, lake, stream).join(rejected, "source_file", "left_semi")
    return set_aside(check_lines(lines, stream)).union(_salvaged(spark, lake, stream).drop("batch"))


def _salvaged(spark: SparkSession, lake: Lake, stream: str) -> DataFrame:
    """Lines set aside by complete runs, without the batches that a retry has dealt with."""
    lines = load(spark, strings((*QUARANTINE.names, "batch")), lake.quarantine(stream), "parquet")
    begun = unfinished(spark, lake, stream)
    dealt = [
        name
        for retry in marks(spark, lake.replaced(stream)) if retry not in begun
        for name in read_mark(spark, lake.replaced(stream), retry)["quarantined"]
    ]
    hidden = [*begun, *dealt]
    return lines.where(~F.col("batch").isin(*hidden)) if hidden else lines


def retry_quarantine(
    spark: SparkSession, lake: Lake, stream: str, batch: str | None = None
) -> None:
    """Check again what was set aside, for use after the rules or the objects were mended.

    Rejected objects are taken by an ordinary run. Salvaged lines that are sound now are stored, the
    others set aside anew, as a run of its own that stands for the batches it deals with: until it
    is complete these count and it does not, from then on it does and they don't.
    """
    compact_raw(spark, lake, stream, batch)
    salvaged = _salvaged(spark, lake, stream)
    names = sorted(r.batch for r in salvaged.select("batch").distinct().collect())
    if not names:
        return
    again = "retry-" + sha256(",".join(names).encode()).hexdigest()[:32]
    put_mark(spark, lake.attempts(stream), again)
    copy = work_area(spark, "retry")
    lines = salvaged.select(F.col("line").alias("value"), "source_file")
    check_lines(lines, stream).write.parquet(copy)
    checked = spark.read.parquet(copy)
    sound = checked.where(F.col("reason").isNull())
    write_compacted(project_records(sound, stream), lake.compacted(stream), again)
    write_totals(spark, lake, stream, again)
    _replace_batch(set_aside(checked.where(F.col("reason").isNotNull())), lake.quarantine(stream), again)
    drop(spark, copy)
    put_mark(spark, lake.replaced(stream), again, parts=[], quarantined=names)
    drop_mark(spark, lake.attempts(stream), again)


def _replace_batch(rows: DataFrame, path: str, batch: str, *partitions: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.option("compression", "zstd").parquet(f"{path}/batch={batch}")
