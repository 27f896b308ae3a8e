"""Raw objects: their names, where they lie, and clearing them away."""

from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day of an object outside any day's folder, in the record of objects.
NO_DAY = "none"


def folder_day(path: Column) -> Column:
    """The day of the folder an object lies in, as text."""
    # The first folder of the name is the day's as a rule; only other paths are searched through.
    first = F.substring(path, F.instr(path, "/date=") + 6, F.lit(11))
    searched = F.regexp_extract(path, r"/date=(\d{4}-\d\d-\d\d)/", 1)
    return (
        F.when(first.rlike(r"^\d{4}-\d\d-\d\d/$"), F.substring(first, 1, 10))
        .when(searched != "", searched).otherwise(NO_DAY)
    )


def folder_hour(path: Column) -> Column:
    first = F.substring(path, F.instr(path, "/hour=") + 6, F.lit(3))
    searched = F.regexp_extract(path, r"/hour=(\d\d)/", 1)
    return (
        F.when(first.rlike(r"^\d\d/$"), F.substring(first, 1, 2)).otherwise(F.nullif(searched, F.lit("")))
    )


def folder_batch(path: Column) -> Column:
    """The batch of ours that wrote an object, empty for objects of other writers."""
    return F.regexp_extract(path, r"/batch=([^/]+)-\d{5,}-[0-9a-f]{8}-[0-9a-f-]{27}[^/]*$", 1)


def clear_away(objects: DataFrame, root: str, archive: str | None = None) -> int:
    """Delete objects (``source_file``), or move them below ``archive`` as they lie below ``root``.

    Executors do it, each for its share of the names, with the session's own endpoint and keys. An
    object that is gone already is no error, so a run that died can be repeated.
    """
    settings = store_settings(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name, settings)
                if store.get_file_info(path).type == fs.FileType.NotFound:
                    continue
                if archive:
                    base, kept = (open_store(p, settings)[1].rstrip("/") for p in (root, archive))
                    target = kept + path[path.index(base) + len(base) :]
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    store.move(path, target)
                else:
                    store.delete_file(path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    cleared = objects.select("source_file").mapInArrow(run, "n long")
    return cleared.agg(F.sum("n")).first()[0] or 0


#: What the session says of an object store, and what pyarrow calls it.
S3_SETTINGS = {
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
    "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region",
}


def store_settings(spark: SparkSession) -> dict[str, str]:
    """The session's settings for object stores, for work outside the JVM."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    found = {name: conf.get(key) for key, name in S3_SETTINGS.items()}
    if conf.get("fs.s3a.connection.ssl.enabled") == "false":
        found["scheme"] = "http"
    if conf.get("fs.s3a.path.style.access") == "false":
        found["force_virtual_addressing"] = True
    return {name: value for name, value in found.items() if value}


def open_store(path: str, settings: dict[str, str]):
    """The file system a path lies in, and the path as that knows it."""
    from pyarrow import fs

    uri = _uri(path)
    if settings and uri.startswith("s3://"):
        return fs.S3FileSystem(**settings), unquote(uri.removeprefix("s3://"))
    return fs.FileSystem.from_uri(uri)


def _uri(path: str) -> str:
    """A path as the store's own library names it. Names that Spark gives are encoded already."""
    scheme, mark, rest = path.partition(":")
    if not mark or not rest.startswith("/"):
        return f"file://{quote(path)}"
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{scheme}:{rest}"
