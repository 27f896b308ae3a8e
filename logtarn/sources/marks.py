"""Marks: what is under way in a lake, as small files named after it.

A mark is put and taken away by the driver through the session's own Hadoop file system, with its
endpoints and credentials, and listed without a job. There is one for each thing under way, none for
what is done, so that listing them costs the same however long a lake has been in use.
"""

import json
from typing import Any
from urllib.parse import quote, unquote
from uuid import uuid4

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _mark(folder: str, name: str) -> str:
    return f"{folder}/{quote(name, safe='')}"


def put_mark(spark: SparkSession, folder: str, name: str, **content: Any) -> None:
    """Put a mark, in place of one of that name. It is seen whole or not at all."""
    store, hidden = _store(spark, f"{folder}/.{uuid4().hex}")
    out = store.create(hidden, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, target = _store(spark, _mark(folder, name))
    if store.exists(target):
        store.delete(target, False)
    if not store.rename(hidden, target):
        raise OSError(f"cannot put the mark {target}")


def marks(spark: SparkSession, folder: str) -> list[str]:
    """The names of the marks in a folder, in order."""
    store, where = _store(spark, folder)
    if not store.exists(where):
        return []
    found = [unquote(status.getPath().getName()) for status in store.listStatus(where)]
    return sorted(name for name in found if not name.startswith("."))


def read_mark(spark: SparkSession, folder: str, name: str) -> dict[str, Any]:
    store, where = _store(spark, _mark(folder, name))
    source = store.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def drop_mark(spark: SparkSession, folder: str, name: str) -> None:
    """Take a mark away; none is no error."""
    drop(spark, _mark(folder, name))


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all in it; none is no error."""
    store, where = _store(spark, path)
    store.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, in order."""
    store, where = _store(spark, path)
    if not store.exists(where):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(where) if s.isDirectory())
