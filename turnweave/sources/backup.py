"""Backup of a folder's files to a store of objects, and back."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest
from . import objects, versions
from .files import tree


def _listed(spark: SparkSession, store: str) -> DataFrame:
    files, path = objects.opened(f"{store}/objects")
    if not files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        return spark.createDataFrame([], "hash string, size bigint")
    spark.dataSource.register(objects.Listing)
    return spark.read.format("objects").option("path", f"{store}/objects").load()


def push(spark: SparkSession, folder: str, store: str) -> dict[str, int]:
    """Upload what the store lacks, commit the manifest, then collect objects that no file refers to.

    The manifest is what one reading of the folder saw, and it is committed only if the store then has all of its
    objects: a file that changes meanwhile makes the push fail, and the version before stays the newest.
    """
    name, local = versions.stage(tree(spark, folder), f"{store}/manifest")
    there = _listed(spark, store)
    remote = versions.read(spark, f"{store}/manifest")
    plan = manifest.push_plan(local, there.select("hash"), local.limit(0) if remote is None else remote)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.sha2("content", 256).alias("hash"), "content")
    wanted = local.select("hash").distinct().join(there.select("hash"), "hash", "left_anti")
    objects.put(content.join(wanted, "hash", "left_semi"), f"{store}/objects")
    if not wanted.join(_listed(spark, store).select("hash"), "hash", "left_anti").isEmpty():
        raise RuntimeError("files changed while they were pushed")
    versions.commit(spark, f"{store}/manifest", name)
    gone = manifest.orphans(_listed(spark, store), local)

    def remove(rows: Iterator[Row]) -> None:
        files, path = objects.opened(f"{store}/objects")
        for r in rows:
            files.delete_file(f"{path}/{r['hash']}")

    gone.foreachPartition(remove)
    return {k: counts.get(k, 0) for k in ("upload", "skip", "collect")}


def restore(spark: SparkSession, store: str, folder: str, busy: bool = False) -> int:
    """Write the newest manifest's files and remove others; refuses while jobs are active. Returns the number of files."""
    if busy:
        raise RuntimeError("jobs are active")
    wanted = versions.read(spark, f"{store}/manifest")
    if wanted is None:
        raise ValueError("nothing to restore")

    def fetch(rows: Iterator[Row]) -> None:
        kept, at = objects.opened(f"{store}/objects")
        files, path = objects.opened(folder)
        for r in rows:
            target = f"{path}/{r['path']}"
            part = f"{target}.{uuid.uuid4().hex}.tmp"
            files.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with kept.open_input_stream(f"{at}/{r['hash']}") as source, files.open_output_stream(part) as out:
                shutil.copyfileobj(source, out)
            files.move(part, target)

    wanted.select("path", "hash").foreachPartition(fetch)

    def remove(rows: Iterator[Row]) -> None:
        files, path = objects.opened(folder)
        for r in rows:
            files.delete_file(f"{path}/{r['path']}")

    manifest.stray(tree(spark, folder), wanted).select("path").foreachPartition(remove)
    return wanted.count()
