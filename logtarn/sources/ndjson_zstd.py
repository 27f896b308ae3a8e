"""Sink for zstd NDJSON objects by day and hour, which Spark's own writers cannot make.

Rows are text lines with their folder. A task writes its objects below a hidden staging folder; when
all tasks are done, the objects that the successful attempts have named are moved into place and the
folder is deleted. So attempts that failed, were killed or ran twice leave nothing in the tier, and
a job that fails leaves nothing at all.
"""

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from logtarn.sources.objects import open_store

FORMAT = "ndjson_zstd"
#: Objects moved at a time; a move is a request to the store, not work for the driver.
MOVES = 32


@dataclass
class Written(WriterCommitMessage):
    """The objects of one task, as they lie below the folder."""

    names: list[str]


class NdjsonZstd(DataSource):
    """Options: ``path``, ``batch``, and ``settings`` of the store as JSON. Columns: ``date``,
    ``hour`` and ``value``, rows of a folder one after the other."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ObjectWriter(
            self.options["path"], self.options["batch"], json.loads(self.options.get("settings", "{}"))
        )


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, settings: dict):
        self.path, self.batch, self.settings = path.rstrip("/"), batch, settings
        self.staging = f"_staging/{uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """The objects of a task, one for each folder it has rows of."""
        store, root = open_store(self.path, self.settings)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        names, folder, out = [], None, None
        for batch in iterator:
            of = [f"date={d}/hour={h}" for d, h in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)]
            lines, start = batch.column(2), 0
            for stop in range(1, len(of) + 1):
                if stop < len(of) and of[stop] == of[start]:
                    continue
                if of[start] != folder:
                    if out:
                        out.close()
                    folder = of[start]
                    # The name of an object says its batch, see folder_batch().
                    names.append(f"{folder}/batch={self.batch}-{part:05d}-{uuid4()}.c000.ndjson.zst")
                    target = f"{root}/{self.staging}/{names[-1]}"
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(target, compression="zstd")
                out.write(("\n".join(lines.slice(start, stop - start).to_pylist()) + "\n").encode())
                start = stop
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        """Move what the successful attempts have written into place."""
        store, root = open_store(self.path, self.settings)
        names = [name for message in messages if message for name in message.names]
        for folder in {name.rsplit("/", 1)[0] for name in names}:
            store.create_dir(f"{root}/{folder}", recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda name: store.move(f"{root}/{self.staging}/{name}", f"{root}/{name}"), names))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete all that any attempt has left in the staging folder."""
        from pyarrow import fs

        store, root = open_store(self.path, self.settings)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")
