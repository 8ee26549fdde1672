"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: list["Scratch"] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a temporary folder is taken and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basalt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Tables written once to the shared folder, so that lineage ends there.

    Spark's committer writes them, so a lost executor costs its own tasks only.
    Tables stay until ``drop``, ``drop_scratch`` or the end of the driver's process.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/basalt/{what}-{uuid.uuid4().hex}"
        _LIVE.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_scratch() -> None:
    """Removes the scratch tables of all queries so far: for long sessions, once their results have been read or written."""
    while _LIVE:
        _LIVE.pop().drop()


@atexit.register
def _clean() -> None:
    try:
        drop_scratch()
    except Exception:  # the session has ended before the process
        pass
