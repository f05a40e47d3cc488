"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
LOCAL_DIR = "/tmp/checkpoints"
#: While a table is written: Spark deletes the query's shuffle files as soon as it has ended, and long texts and lists go
#: to Python in smaller batches than Spark's own, of which a worker and its executor hold several copies.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


class Scratch:
    """Tables of one operator run, below ``spark.checkpoint.dir``.

    ``keep`` writes a DataFrame and reads it again, which cuts its lineage:
    the table outlives any executor. ``drop`` deletes tables that later steps
    no longer read; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = LOCAL_DIR
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._forget)

    def keep(self, df: DataFrame, label: str, **settings: str) -> DataFrame:
        """``settings`` hold while the table is written; dots in their names are written as ``__``."""
        path = f"{self.root}/{label}"
        wanted = WRITING | {k.replace("__", "."): v for k, v in settings.items()}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            self._delete(f"{self.root}/{label}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _forget(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended already
            pass
