"""Manifests of files by content: differences, roots, garbage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def changed(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files whose content the other side lacks; a renamed file isn't one."""
    return local.join(remote.select("hash").distinct(), "hash", "left_anti")


def stray(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Paths that the remote manifest doesn't have."""
    return local.join(remote.select("path"), "path", "left_anti")


def present(local: DataFrame, objects: DataFrame) -> DataFrame:
    """Files whose object is stored already."""
    return local.join(objects, "hash", "left_semi")


def orphans(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored objects that no file refers to."""
    return objects.select("hash").exceptAll(manifest.select("hash").distinct()).distinct()


def object_keys(manifest: DataFrame) -> DataFrame:
    return manifest.select("hash").distinct()


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def _digests(rows: DataFrame, group: str, name: str, ends: bool) -> DataFrame:
    """SHA-256 over each group's lines by path: rows (group, ``name``, files). ``ends``: the mark stands after each line, else between them.

    rows: group, path, line. Each group is sorted by Spark, spilling where it must, and streams through the
    hash batch by batch: no list of a group's lines is made. One hash over one order can't be split, so a group
    is a task's work; groups are spread.
    """
    kind = rows.schema[group].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, n = None, None, 0
        for batch in batches:
            found = []
            for g, line in zip(batch["g"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if digest is None or g != own:
                    if digest is not None:
                        found.append((own, digest.hexdigest(), n))
                    own, digest, n = g, hashlib.sha256(), 0
                if n and not ends:
                    digest.update(b"\0")
                if line is not None:
                    digest.update(line.encode())
                if ends:
                    digest.update(b"\0")
                n += 1
            yield table(found)
        yield table([] if digest is None else [(own, digest.hexdigest(), n)])

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((to_arrow_type(kind), pa.string(), pa.int64()))], names=["g", name, "files"])

    dealt = rows.select(F.col(group).alias("g"), "path", "line").repartition("g").sortWithinPartitions("g", "path", "line")
    fields = T.StructType([T.StructField("g", kind), T.StructField(name, T.StringType()), T.StructField("files", T.LongType())])
    return dealt.mapInArrow(run, fields).withColumnRenamed("g", group)


def root(manifest: DataFrame, group: str = "group") -> DataFrame:
    """One hash over the paths and hashes of each group, by path."""
    return _digests(manifest.select(group, "path", F.concat("path", F.lit("\0"), "hash").alias("line")), group, "root", True)


def signature(files: DataFrame, group: str = "group") -> DataFrame:
    """One hash over paths, sizes and times: cheaper than contents."""
    line = F.concat_ws("\0", F.col("path"), F.col("size").cast("string"), F.col("mtime_ns").cast("string"))
    return _digests(files.select(group, "path", line.alias("line")), group, "signature", False).drop("files")


def link_state(local: Column, remote: Column) -> Column:
    """Of two roots, null where there is nothing."""
    return F.when(remote.isNull(), "fresh").when(local.isNull(), "remote only").when(local == remote, "in sync").otherwise("diverged")


def compare(local: DataFrame, remote: DataFrame, group: str = "group") -> DataFrame:
    """local and remote: group, root."""
    both = local.select(group, F.col("root").alias("l")).join(remote.select(group, F.col("root").alias("r")), group, "full_outer")
    return both.select(group, link_state(F.col("l"), F.col("r")).alias("state"))


def push_plan(local: DataFrame, objects: DataFrame, remote: DataFrame) -> DataFrame:
    """What a push does with each object: upload, skip, or collect once the new manifest stands."""
    new, old = object_keys(local), object_keys(remote)
    todo = new.join(objects, "hash", "left_anti").withColumn("action", F.lit("upload"))
    skip = new.join(objects, "hash", "left_semi").withColumn("action", F.lit("skip"))
    drop = objects.unionByName(old).distinct().join(new, "hash", "left_anti").join(objects, "hash", "left_semi").withColumn("action", F.lit("collect"))
    return todo.unionByName(skip).unionByName(drop)
