"""A store of objects by content hash: a listing as a data source, and a sink that skips what is there."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Listing(DataSource):
    """``spark.dataSource.register(Listing)``, then format ``objects`` with the option ``path``; rows (hash, size).

    A flat folder has one listing, which names and sizes come with; a task makes it, so names never
    pass through the driver. Spark deals the rows out to the tasks that follow.
    """

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "hash string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[Row]:
        store, folder = opened(self.path)
        for f in store.get_file_info(fs.FileSelector(folder)):
            if f.is_file and not f.base_name.endswith(".tmp"):
                yield Row(hash=f.base_name, size=f.size)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, which all machines must reach, and the path in it."""
    store, folder = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return store, folder.rstrip("/")


def put(files: DataFrame, folder: str) -> None:
    """Store rows (hash, content) under their hashes, each at once or not at all; what is there stays."""

    def write(rows: Iterator[Row]) -> None:
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        for r in rows:
            target = f"{path}/{r['hash']}"
            if store.get_file_info(target).type == fs.FileType.NotFound:
                part = f"{target}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(part) as f:
                    f.write(r["content"])
                store.move(part, target)

    files.select("hash", "content").dropDuplicates(["hash"]).foreachPartition(write)
