"""The lake's folders and the two tiers that queries read."""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from logtarn.functions.json_text import object_fields, only_object
from logtarn.functions.times import event_time
from logtarn.schemas import check_scope, check_stream, record_fields, strings
from logtarn.sources.marks import marks, put_mark, read_mark
from logtarn.sources.objects import NO_DAY, folder_batch, folder_day, folder_hour

#: One row per raw object and run of compaction; ``day`` is that of the object's folder.
OBJECT_STATUS = StructType([
    StructField("source_file", StringType(), True),
    StructField("lines", LongType(), True),
    StructField("bad_lines", LongType(), True),
    StructField("compacted", BooleanType(), True),
    StructField("batch", StringType(), True),
    StructField("day", StringType(), True),
])
#: Lines set aside by compaction; ``reason`` is null for sound lines of a rejected object.
QUARANTINE = strings(("line", "source_file", "reason"))

MALFORMED = "raw line is not a JSON object"

#: Stands for all the fields in the stream's catalogue, see :func:`catalogued_fields`.
CATALOGUED = "catalogued"
#: Columns that readers add, so no field of a record may have these names.
RESERVED = ("date", "hour", "event_ts", "batch", "_compacted", "source_file", "compacted_on")


@dataclass(frozen=True)
class Lake:
    """Folder layout: ``raw`` and ``daily`` hold the tiers, the rest is compaction's record.

    ``typed_times`` says that the compacted files have the instant in ``event_ts``, as those of
    this package do; filters on it then skip row groups. For files of another program turn it off.
    """

    root: str
    typed_times: bool = True

    def raw(self, stream: str) -> str:
        return f"{self.root}/raw/{check_stream(stream)}"

    def compacted(self, stream: str) -> str:
        return f"{self.root}/daily/{check_stream(stream)}"

    def object_status(self, stream: str) -> str:
        return f"{self.root}/status/{check_stream(stream)}"

    def quarantine(self, stream: str) -> str:
        return f"{self.root}/quarantine/{check_stream(stream)}"

    def totals(self, stream: str) -> str:
        return f"{self.root}/totals/{check_stream(stream)}"

    def archive(self, stream: str) -> str:
        return f"{self.root}/archive/{check_stream(stream)}"

    def attempts(self, stream: str) -> str:
        """Marks of the runs that have begun and are not complete. What a run has written counts
        from the moment its mark is gone."""
        return f"{self.root}/attempts/{check_stream(stream)}"

    def uncleared(self, stream: str) -> str:
        """Marks of the runs whose objects may still be in the raw tier."""
        return f"{self.root}/uncleared/{check_stream(stream)}"

    def replaced(self, stream: str) -> str:
        """Marks of the runs that stand for parts of earlier ones, with the names of these."""
        return f"{self.root}/replaced/{check_stream(stream)}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


def load(spark: SparkSession, schema: StructType | str, path: str, fmt: str, **options) -> DataFrame:
    """All files under ``path``, an empty table when there are none yet. Starts no job."""
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def raw_lines(reader, path: str) -> DataFrame:
    """Text lines, each with the object it comes from, for any reader, batch or streaming.

    Lines end at a newline only. Folders of any depth are read, whoever laid them out.
    """
    return (
        reader.options(recursiveFileLookup="true", lineSep="\n").schema("value string")
        .format("text").load(path)
        .select("value", F.col("_metadata.file_path").alias("source_file"))
    )


def read_raw_lines(spark: SparkSession, lake: Lake, stream: str) -> DataFrame:
    """The raw tier as text lines, each with the object it comes from. Blank lines are kept."""
    try:
        return raw_lines(spark.read, lake.raw(stream))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string, source_file string")


def read_raw(
    spark: SparkSession,
    lake: Lake,
    stream: str,
    extra_fields: tuple[str, ...] | str = (),
    skip_compacted: bool = True,
) -> DataFrame:
    """The raw tier: NDJSON objects, plain, gzip or zstd, whatever their extra fields.

    Every field is read as text; ``payload_json`` is the line, as in the compacted tier, so every
    field can be reached. Name the additional fields wanted as columns in ``extra_fields``. A line
    that is not exactly one JSON object is kept once: ``parse_error`` says so. Blank lines are left
    out. The folder's day comes from the path, so that filters on ``date`` skip objects.
    """
    fields = record_fields(stream)
    extra = _wanted(spark, lake, stream, extra_fields)
    lines = read_raw_lines(spark, lake, stream)
    lines = lines.withColumn("day", folder_day(F.col("source_file")))
    lines = _of_complete_batches(lines, open_batches(spark, lake.raw(stream)))
    if skip_compacted:
        lines = _not_compacted(lines, lake, stream)
    members = [name for name in (*fields, *extra) if name != "payload_json"]
    text = F.col("value")
    # Made a row of its own by a generator, the record is parsed once: a filter on a field stays
    # above it, where an ordinary projection would be repeated below the filter.
    record = only_object(text, dict.fromkeys(members, "string"))
    read = lines.where(F.btrim(text, F.lit(" \t\r")) != "").select(
        "*", F.explode(F.array(record)).alias("_record")
    )
    record = {name: F.col(f"_record.{name}") for name in members}
    record["payload_json"] = text
    record["parse_error"] = F.when(F.col("_record").isNull(), F.lit(MALFORMED)).otherwise(
        F.col("_record.parse_error")
    )
    if "source_file" in extra:
        record["source_file"] = F.col("source_file")
    return read.select(
        *[record[name].alias(name) for name in (*fields, *extra)],
        F.when(F.col("day") != NO_DAY, F.col("day")).try_cast("date").alias("date"),
        folder_hour(F.col("source_file")).alias("hour"),
    )


def read_compacted(
    spark: SparkSession, lake: Lake, stream: str, extra_fields: tuple[str, ...] | str = ()
) -> DataFrame:
    """The compacted tier: Parquet files, matched to the declared columns by name.

    A file that lacks a column gives nulls for it. Declaring the columns spares the reading of
    every file's footer that merging inferred schemas needs. Fields in ``extra_fields`` that no
    file has as a column come from the record's line.
    """
    fields = record_fields(stream)
    extra = _wanted(spark, lake, stream, extra_fields)
    schema = strings((*fields, *extra)).add("event_ts", TimestampType()).add("date", DateType())
    schema = schema.add("batch", StringType())
    records = stored_parts(spark, lake, stream, load(spark, schema, lake.compacted(stream), "parquet"))
    if extra:
        line = object_fields(F.trim("payload_json"), dict.fromkeys(extra, "string"))
        records = records.withColumn("_line", line)
    instant = F.col("event_ts") if lake.typed_times else event_time(F.col("ts"))
    return records.select(
        *fields,
        *[F.coalesce(F.col(name), F.col(f"_line.{name}")).alias(name) for name in extra],
        "date",
        instant.alias("event_ts"),
    )


def fields_mark(raw: str) -> str:
    """Marks of the fields that records of the tier have beyond the declared ones."""
    return f"{raw}/_fields"


def catalogued_fields(spark: SparkSession, lake: Lake, stream: str) -> tuple[str, ...]:
    """The fields that writers of the stream have beyond the record's: those of our own batches, as
    they are written, and those that compaction or :func:`catalogue_fields` met. No file is read."""
    return tuple(marks(spark, fields_mark(lake.raw(stream))))


def note_fields(spark: SparkSession, raw: str, stream_fields: tuple[str, ...], names: list[str]) -> None:
    """Add names to a stream's catalogue. Column names differ by more than case, so of several
    spellings the first stays."""
    known = {name.lower() for name in (*stream_fields, *RESERVED, *marks(spark, fields_mark(raw)))}
    for name in names:
        if name and name.lower() not in known:
            known.add(name.lower())
            put_mark(spark, fields_mark(raw), name)


def catalogue_fields(spark: SparkSession, lake: Lake, stream: str) -> None:
    """Note the fields of objects in the raw tier that other programs wrote; ours are noted when
    written, so their objects are not read. A record has few fields: their names, distinct
    over all lines before the shuffle, meet on the driver."""
    lines = read_raw_lines(spark, lake, stream).where(folder_batch(F.col("source_file")) == "")
    keys = lines.select(F.explode(F.json_object_keys("value")).alias("field")).distinct().orderBy("field")
    note_fields(spark, lake.raw(stream), record_fields(stream), [row.field for row in keys.collect()])


def _wanted(
    spark: SparkSession, lake: Lake, stream: str, extra_fields: tuple[str, ...] | str
) -> tuple[str, ...]:
    if extra_fields == CATALOGUED:
        return catalogued_fields(spark, lake, stream)
    return tuple(name for name in extra_fields if name not in record_fields(stream))


def unfinished(spark: SparkSession, lake: Lake, stream: str) -> list[str]:
    """Runs of compaction that have begun and are not complete: at most those that died."""
    return marks(spark, lake.attempts(stream))


def stored_parts(spark: SparkSession, lake: Lake, stream: str, records: DataFrame) -> DataFrame:
    """Of a table by ``batch`` and ``date``, what counts: not what unfinished runs have written, nor
    what a complete one has replaced. Names are few and folders are skipped by them; no join."""
    begun = unfinished(spark, lake, stream)
    if begun:
        # Files of other programs lie in no run's folder.
        records = records.where(F.col("batch").isNull() | ~F.col("batch").isin(*begun))
    gone = sorted({
        part
        for name in marks(spark, lake.replaced(stream)) if name not in begun
        for part in read_mark(spark, lake.replaced(stream), name)["parts"]
    })
    if gone:
        part = F.concat_ws("/", F.col("batch"), F.coalesce(F.col("date").cast("string"), F.lit("")))
        records = records.where(F.col("batch").isNull() | ~part.isin(*gone))
    return records


def read_status(spark: SparkSession, lake: Lake, stream: str) -> DataFrame:
    """What compaction found in each raw object, run by run, for runs that are complete."""
    found = load(spark, OBJECT_STATUS, lake.object_status(stream), "parquet")
    begun = unfinished(spark, lake, stream)
    return found.where(~F.col("batch").isin(*begun)) if begun else found


def uncleared_runs(spark: SparkSession, lake: Lake, stream: str) -> list[str]:
    """Complete runs whose objects may still be in the raw tier, as a rule the last one."""
    begun = set(unfinished(spark, lake, stream))
    return [name for name in marks(spark, lake.uncleared(stream)) if name not in begun]


def compacted_objects(spark: SparkSession, lake: Lake, stream: str) -> DataFrame:
    """``day`` and ``source_file`` of the raw objects that are in the compacted tier as well.
    Objects that were cleared away are not looked up."""
    found = load(spark, OBJECT_STATUS, lake.object_status(stream), "parquet")
    runs = uncleared_runs(spark, lake, stream)
    return found.where(F.col("batch").isin(*runs) & F.col("compacted")).select("day", "source_file")


def _not_compacted(lines: DataFrame, lake: Lake, stream: str) -> DataFrame:
    """An object is compacted before it is cleared away; until then it would be read twice.

    Batches of ours that were compacted whole are told by name: their objects are left out when
    files are listed. Only objects of other writers, and of batches that were compacted in part,
    are looked up one by one.
    """
    spark = lines.sparkSession
    runs = [read_mark(spark, lake.uncleared(stream), run) for run in uncleared_runs(spark, lake, stream)]
    whole = sorted({batch for run in runs for batch in run["batches"]})
    batch = folder_batch(F.col("source_file"))
    if whole:
        lines = lines.where(~batch.isin(*whole))
    if not any(run["others"] for run in runs):
        return lines
    others = compacted_objects(spark, lake, stream)
    return lines.join(others.where(~batch.isin(*whole)) if whole else others, ["day", "source_file"], "left_anti")


def _of_complete_batches(lines: DataFrame, unready: list[str]) -> DataFrame:
    """Objects of batches that are still written, or whose writer died, do not count yet."""
    return lines.where(~folder_batch(F.col("source_file")).isin(*unready)) if unready else lines


def open_mark(raw: str) -> str:
    """Marks of batches being written; the leading underscore hides it from readers of the tier."""
    return f"{raw}/_open"


def done_mark(raw: str) -> str:
    """Marks of complete batches: the last of each numbered sequence, and those without a number."""
    return f"{raw}/_done"


def sequence(batch: str) -> tuple[str, int | None]:
    """A batch name without its number, and the number."""
    name, _, number = batch.rpartition("-")
    return (name, int(number)) if name and number.isdecimal() else (batch, None)


def is_done(spark: SparkSession, raw: str, batch: str) -> bool:
    """Whether a batch is complete. In a sequence, all are up to the last that was marked."""
    name, number = sequence(batch)
    done = [sequence(mark) for mark in marks(spark, done_mark(raw))]
    return any(n == name and (k is None if number is None else k is not None and k >= number) for n, k in done)


def open_batches(spark: SparkSession, raw: str) -> list[str]:
    """The batches of the raw tier that are not complete."""
    return [name for name in marks(spark, open_mark(raw)) if not is_done(spark, raw, name)]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``length`` of the files below a folder; they are not opened."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, length long")
    return found.select(F.col("_metadata.file_path").alias("file"), "length")


def raw_objects(spark: SparkSession, path: str) -> DataFrame:
    """``source_file``, ``day`` and ``batch`` of the objects there are; they are not opened."""
    name = F.col("file")
    return list_files(spark, path).select(
        name.alias("source_file"), folder_day(name).alias("day"), folder_batch(name).alias("batch")
    )


def open_lines(spark: SparkSession, lake: Lake, stream: str) -> DataFrame:
    """The raw lines that compaction has to take: of complete batches and other writers' objects,
    without the objects that are compacted. Objects that were rejected come again."""
    lines = read_raw_lines(spark, lake, stream).withColumn("day", folder_day(F.col("source_file")))
    lines = _of_complete_batches(lines, open_batches(spark, lake.raw(stream)))
    return _not_compacted(lines, lake, stream).select("value", "source_file")


def sources(
    spark: SparkSession,
    lake: Lake,
    stream: str = "logs",
    scope: str = "all",
    extra_fields: tuple[str, ...] | str = (),
) -> DataFrame:
    """The chosen tiers of a stream as one relation, matched by column name. Starts no job.

    ``extra_fields`` names fields beyond the record's, or is :data:`CATALOGUED`: then every field
    that any writer of the stream has is a column, null where a record lacks it.

    Besides the record fields it has the day ``date`` (UTC) and ``hour`` of the folder and the
    instant ``event_ts``. Filters on ``date`` skip the folders of both tiers. Filters may also
    name ``_compacted``, whether a row is of the compacted tier, which is not among the columns.
    """
    check_stream(stream)
    tiers = []
    if check_scope(scope) in ("all", "compacted"):
        compacted = read_compacted(spark, lake, stream, extra_fields)
        tiers.append(compacted.withColumn("_compacted", F.lit(True)))
    if scope in ("all", "recent"):
        raw = read_raw(spark, lake, stream, extra_fields)
        raw = raw.withColumn("event_ts", event_time(F.col("ts")))
        tiers.append(raw.withColumn("_compacted", F.lit(False)))
    union = tiers[0]
    for tier in tiers[1:]:
        union = union.unionByName(tier, allowMissingColumns=True)
    return union.select(*[c for c in union.columns if c not in ("event_ts", "_compacted")], "event_ts")
