"""Tables in versions: data first, the commit last, so a reader sees a whole version or the one before.

A commit is a small file that can be made only once, with the name of the version's data in it: of two writers
at once one gets a version and the other the next.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, root: str):
    """The file system of the commits, and their folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def committed(spark: SparkSession, root: str) -> list[int]:
    """Versions whose commit was written, in order."""
    files, folder = _files(spark, root)
    if not files.exists(folder):
        return []
    # A commit that is still being written is empty.
    return sorted(int(n) for f in files.listStatus(folder) if (n := f.getPath().getName()).isdigit() and f.getLen())


def stage(rows: DataFrame, root: str) -> tuple[str, DataFrame]:
    """Write ``rows`` where no version refers to them yet; the data's name, and the rows as they were written."""
    name = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{name}")
    return name, rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}")


def commit(spark: SparkSession, root: str, name: str) -> int:
    """Make staged data the next version."""
    files, folder = _files(spark, root)
    version = max(committed(spark, root), default=0)
    while True:
        version += 1
        try:
            out = files.create(folder.suffix(f"/{version}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            continue
        out.write(bytearray(name.encode()))
        out.close()
        return version


def publish(rows: DataFrame, root: str) -> int:
    """Write ``rows`` as the next version."""
    name, _ = stage(rows, root)
    return commit(rows.sparkSession, root, name)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """A committed version, the newest unless one is named; None if there is none."""
    known = committed(spark, root)
    if version is None:
        version = max(known, default=None)
    if version is None:
        return None
    if version not in known:
        raise ValueError(f"no such version: {version}")
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/commits/{version}').first()['value']}")
