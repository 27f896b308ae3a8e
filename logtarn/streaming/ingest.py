"""Continuous ingestion: landing folder to raw tier."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logtarn.operators.cloudevents import normalize_events
from logtarn.operators.logs import normalize_logs
from logtarn.operators.relay import allow_listed, allow_listed_by, read_allow_list
from logtarn.schemas import check_stream
from logtarn.session import configure
from logtarn.sources.lake import Lake
from logtarn.sources.landing import stream_requests, stream_syslog
from logtarn.sources.sinks import with_raw_partition, write_raw
from logtarn.streaming.batches import batch_name

#: Fixed value: seconds between two writes of the collector.
BATCH_SECONDS = 60
#: Bytes of landed files that a batch takes at most, unless a single one has more.
MAX_BATCH_BYTES = 64 << 30


def landed_stream(
    spark: SparkSession, landing: str, stream: str, relay: bool = True, **options: str
) -> DataFrame:
    """Normalised records of the files landing in a folder, as an unbounded DataFrame; of logs those
    of the listed programs, unless ``relay`` leaves that to the caller."""
    if check_stream(stream) == "logs":
        lines = stream_syslog(spark, landing, **options).drop("source_file")
        return normalize_logs(allow_listed(lines) if relay else lines)
    return normalize_events(stream_requests(spark, landing, **options))


def ingest_stream(
    spark: SparkSession,
    lake: Lake,
    stream: str,
    landing: str,
    checkpoint: str | None = None,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int = MAX_BATCH_BYTES,
    allow_list: str | None = None,
) -> StreamingQuery:
    """Write what lands to the raw tier, every minute or once over all that is there.

    The partition columns are computed on the stream, where the current time is fixed per batch,
    so a repeated batch goes to the same folders and replaces its first attempt. A batch that was
    complete before the job died is not written again.

    A batch takes files up to ``max_bytes_per_trigger``, at least one, so a backlog of large files is
    worked off in batches that fit; the rest waits in the landing folder. ``max_files_per_trigger``
    bounds their number instead. ``allow_list`` names a lookup table of programs, see
    :func:`read_allow_list`, that each batch reads anew: a change takes effect with the next batch.
    """
    if max_files_per_trigger is None:
        bound = {"maxBytesPerTrigger": str(max_bytes_per_trigger)}
    else:
        bound = {"maxFilesPerTrigger": str(max_files_per_trigger)}
    records = with_raw_partition(landed_stream(spark, landing, stream, relay=allow_list is None, **bound))
    path = lake.raw(stream)

    def store(batch: DataFrame, number: int) -> None:
        # A stream may run its batches in a session of its own, without adaptive execution.
        session = configure(batch.sparkSession)
        if allow_list is not None and stream == "logs":
            batch = allow_listed_by(batch, read_allow_list(session, allow_list))
        write_raw(batch, path, batch_name(batch, number))

    trigger = (
        {"availableNow": True} if available_now else {"processingTime": f"{BATCH_SECONDS} seconds"}
    )
    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint or lake.checkpoint(f"ingest-{stream}"))
        .trigger(**trigger)
        .start()
    )
