"""Merging of small compacted files across runs."""

from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logtarn.operators.compact import settle, stored_fields
from logtarn.schemas import strings
from logtarn.sources.lake import Lake, list_files, load
from logtarn.sources.marks import drop_mark, put_mark
from logtarn.sources.objects import NO_DAY, folder_day
from logtarn.sources.sinks import write_parquet

#: Bytes of a merged file, about.
MERGED_BYTES = 128 << 20
#: Bytes that a task lays, unless a day of at most a file has more.
LAID_BYTES = 4 << 20
#: Days' parts that one merging run takes; a call makes as many runs as there is need for.
PARTS = 2048


def stored_sizes(spark: SparkSession, lake: Lake, stream: str) -> DataFrame:
    """Files and bytes of what each run has stored for a day. Files are listed, not opened."""
    files = list_files(spark, lake.compacted(stream))
    return files.groupBy(
        F.regexp_extract("file", r"/batch=([^/]+)/", 1).alias("batch"), folder_day(F.col("file")).alias("day")
    ).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def small_parts(spark: SparkSession, lake: Lake, stream: str, size: int) -> DataFrame:
    """``day``, ``bytes`` and ``parts`` (``batch/date``) of the days of which several runs have
    stored less than half a file each, or one run several files of less than half the size."""
    parts = stored_sizes(spark, lake, stream).where(F.col("batch") != "")
    small = parts.where(F.col("bytes") < F.col("files") * F.lit(size // 2))
    part = F.concat_ws("/", F.col("batch"), F.when(F.col("day") != NO_DAY, F.col("day")).otherwise(""))
    return small.groupBy("day").agg(
        F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.sort_array(F.collect_list(part)).alias("parts")
    ).where("files > 1 AND files > ceil(bytes / %d)" % size)


def merge_small(spark: SparkSession, lake: Lake, stream: str, size: int = MERGED_BYTES) -> int:
    """Rewrite small files of the compacted tier, day by day, as files of about ``size`` bytes.

    A run that came late, and every run of a busy lake, leaves small files for the days it touches.
    Whole parts, what a run has stored for a day, are read, laid by day, or in ranges of time where a
    day fills more than a file, and written as a run of their own, which stands for them from the moment it is complete; the next
    run deletes them, so queries that began before can go on reading. A run that died is undone.
    Returns how many parts were merged. Runs over one stream go one after the other.
    """
    settle(spark, lake, stream)
    # A row for each day in need; its parts are names of folders, as many as a listing shows.
    days = small_parts(spark, lake, stream, size).orderBy("day").collect()
    merged = 0
    while days:
        taken = [days.pop(0)]
        while days and sum(len(day.parts) for day in [*taken, days[0]]) <= PARTS:
            taken.append(days.pop(0))
        _rewrite(spark, lake, stream, taken, size)
        merged += sum(len(day.parts) for day in taken)
    return merged


def _rewrite(spark: SparkSession, lake: Lake, stream: str, days: list[Row], size: int) -> None:
    batch = f"merge-{uuid4().hex}"
    put_mark(spark, lake.attempts(stream), batch)
    columns = (*stored_fields(stream), "payload_json", "source_file", "compacted_on")
    schema = strings(columns).add("event_ts", "timestamp").add("date", "date").add("batch", "string")
    part = F.concat_ws("/", F.col("batch"), F.coalesce(F.col("date").cast("string"), F.lit("")))
    parts = [name for day in days for name in day.parts]
    records = load(spark, schema, lake.compacted(stream), "parquet").where(part.isin(*parts))
    write_parquet(_laid(records.drop("batch"), days, size), lake.compacted(stream), batch)
    put_mark(spark, lake.replaced(stream), batch, parts=parts, quarantined=[])
    drop_mark(spark, lake.attempts(stream), batch)


def _laid(records: DataFrame, days: list[Row], size: int) -> DataFrame:
    """The records of the days in partitions: days of at most a file whole, as many as fill
    :data:`LAID_BYTES`, larger ones in ranges of time of about ``size`` each."""
    day = F.coalesce(F.col("date").cast("string"), F.lit(NO_DAY))
    large = [d for d in days if d.bytes > size]
    laid, bins, filled = [], {}, 0
    for d in days:
        if d.bytes <= size:
            filled += d.bytes
            last = max(bins.values(), default=0)
            if bins and filled > LAID_BYTES:
                last, filled = last + 1, d.bytes
            bins[d.day] = last
    if bins:
        of = records.sparkSession.createDataFrame(list(bins.items()), "day string, bin int")
        whole = records.where(day.isin(*bins)).withColumn("day", day).join(F.broadcast(of), "day")
        laid.append(whole.repartitionById(max(bins.values()) + 1, "bin").drop("day", "bin"))
    if large:
        files = sum(-(-d.bytes // size) for d in large)
        ranged = records.where(day.isin(*[d.day for d in large]))
        laid.append(ranged.repartitionByRange(files, "date", "event_ts", F.xxhash64("payload_json")))
    return laid[0] if len(laid) == 1 else laid[0].unionByName(laid[1])
