"""Where records and results are written."""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.times import event_date, event_hour
from logtarn.plans.query import json_rows
from logtarn.schemas import EVENT_FIELDS, LOG_FIELDS
from logtarn.sources.lake import done_mark, is_done, note_fields, open_mark, raw_objects, sequence
from logtarn.sources.marks import drop_mark, marks, put_mark
from logtarn.sources.ndjson_zstd import FORMAT, NdjsonZstd
from logtarn.sources.objects import clear_away, store_settings

RESULT_FORMATS = ("ndjson", "csv", "text")


def with_raw_partition(records: DataFrame, received: Column | None = None) -> DataFrame:
    """Add ``date`` and ``hour`` of the event, of its receipt when it has no time."""
    received = F.current_timestamp() if received is None else received
    day, hour = event_date(F.col("ts")), event_hour(F.col("ts"))
    timed = day.isNotNull() & hour.isNotNull()
    return records.withColumns({
        "date": F.date_format(F.when(timed, day).otherwise(F.to_date(received)), "yyyy-MM-dd"),
        "hour": F.when(timed, hour).otherwise(F.date_format(received, "HH")),
    })


def write_raw(records: DataFrame, path: str, batch: str, compression: str = "zstd") -> None:
    """Write normalised records to the raw tier as NDJSON under ``date=/hour=``.

    Objects are ``.ndjson.zst``, as other tools of the lake write and read them; with ``gzip``
    Spark's own writer makes ``.json.gz``, for stores that only Spark reaches.

    The folders of day and hour are shared with other writers; the batch is in the objects' names.
    A batch is written once: it counts when it is marked complete, what an attempt that died has
    left is cleared away, and a complete batch is left alone, however often it comes. Of batches
    that are numbered in sequence, as those of a stream, the last one's mark stands for all.
    Rebalancing by hour makes few objects of even size, one per hour unless an hour holds too much
    for one task.
    """
    spark = records.sparkSession
    if is_done(spark, path, batch):
        drop_mark(spark, open_mark(path), batch)
        return
    if batch in marks(spark, open_mark(path)):
        clear_away(raw_objects(spark, path).where(F.col("batch") == batch), path)
    else:
        put_mark(spark, open_mark(path), batch)
    if "date" not in records.columns:
        records = with_raw_partition(records)
    fields = [name for name in records.columns if name not in ("date", "hour")]
    note_fields(spark, path, (), [name for name in fields if name not in (*LOG_FIELDS, *EVENT_FIELDS)])
    records = records.hint("rebalance", "date", "hour")
    if compression == "zstd":
        fields = [F.col(f"`{name}`") for name in records.columns if name not in ("date", "hour")]
        line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        spark.dataSource.register(NdjsonZstd)
        (
            records.select("date", "hour", line.alias("value")).sortWithinPartitions("date", "hour")
            .write.format(FORMAT).mode("append")
            .options(path=path, batch=batch, settings=json.dumps(store_settings(spark))).save()
        )
    else:
        (
            records.write.mode("append")
            .partitionBy("date", "hour")
            .option("mapreduce.output.basename", f"batch={batch}")
            .option("compression", compression)
            .option("ignoreNullFields", "false")
            .json(path)
        )
    _complete(spark, path, batch)


def _complete(spark: SparkSession, path: str, batch: str) -> None:
    """From here on the batch counts; readers and compaction take complete batches only."""
    earlier = [
        mark for mark in marks(spark, done_mark(path))
        if sequence(mark)[0] == sequence(batch)[0] and sequence(mark)[1] is not None and mark != batch
    ]
    put_mark(spark, done_mark(path), batch)
    drop_mark(spark, open_mark(path), batch)
    if sequence(batch)[1] is not None:
        for mark in earlier:
            drop_mark(spark, done_mark(path), mark)


def write_compacted(records: DataFrame, path: str, batch: str) -> None:
    """Write records as zstd Parquet under ``date=``, replacing an earlier attempt at the batch.

    All tasks of the scan parse. Rebalancing by day then makes few files, one per day unless a day
    holds too much for one task, and bounds what a task has to sort, however much is written.
    """
    write_parquet(records.hint("rebalance", "date"), path, batch)


#: Fields looked up by value. Their values lie all over a file, so its statistics exclude nothing.
LOOKED_UP = ("trace_id", "xname")


def write_parquet(records: DataFrame, path: str, batch: str) -> None:
    """Write the partitions of compacted records as files of a batch, in place of any it has.

    Each is sorted by time, so that its statistics let filters on ``event_ts`` skip row groups;
    Bloom filters do the same for lookups by :data:`LOOKED_UP`.
    """
    writer = (
        records.sortWithinPartitions("date", "event_ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("date")
        .option("compression", "zstd")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
    )
    for field in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{field}", "true")
    writer.parquet(f"{path}/batch={batch}")


def write_result(
    result: DataFrame, path: str, fmt: str = "ndjson", stream: str | None = "logs"
) -> None:
    """Export a query result: ``ndjson``, ``csv`` with a header, or tab-separated ``text``.

    In NDJSON the stream's payload column, if the result has it, nests.
    """
    if fmt == "ndjson":
        json_rows(result, stream).write.mode("overwrite").text(path)
    elif fmt == "csv":
        # Quotes are doubled, so that text with quotes, commas and line ends survives.
        (
            result.select(*[_flat(result, name) for name in result.columns])
            .write.mode("overwrite")
            .options(header="true", quote='"', escape='"', emptyValue='""', nullValue="")
            .csv(path)
        )
    elif fmt == "text":
        result.select(text_row(result).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {fmt!r}, expected one of {RESULT_FORMATS}")


def text_row(result: DataFrame) -> Column:
    """A row as one line: values separated by tabs, nulls empty, line ends and tabs escaped."""

    def escaped(name: str) -> Column:
        text = _flat(result, name)
        for char, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(char), F.lit(code))
        return F.coalesce(text, F.lit(""))

    return F.concat_ws("\t", *[escaped(name) for name in result.columns])


def _flat(result: DataFrame, name: str) -> Column:
    """A column as text; nested values as JSON."""
    kind = result.schema[name].dataType.typeName()
    column = F.col(f"`{name}`")
    if kind in ("struct", "array", "map", "variant"):
        return F.to_json(column).alias(name)
    return column.cast("string").alias(name)
