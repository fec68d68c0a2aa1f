"""Tables in the folder that the cluster shares, to cut lineage between rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes and rereads Parquet under ``spark.checkpoint.dir``.

    Only a local master, as in tests, may leave that unset and gets a temporary
    folder.  What was saved goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = _local_root()
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # the session is still there
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within this, shuffle files go as soon as the query that wrote them has ended, not when the driver next collects garbage."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True):
        yield


@contextmanager
def dealt_by_part(spark: SparkSession) -> Iterator[None]:
    """Within this, tables that are dealt by some of the keys of a join in the same way are joined as they lie."""
    with _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", False):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value: bool) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@lru_cache(maxsize=1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")
