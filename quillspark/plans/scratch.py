"""Intermediate tables in the folder that the whole cluster shares.

A table written here cuts a plan's lineage: an executor that is lost takes nothing with it, as the rows are
files in the folder named by ``spark.checkpoint.dir``. Where that is unset and Spark runs on one machine (tests, notebooks)
a temporary folder is chosen once and set as the session's own checkpoint folder; on a cluster it has to be set.

What an operator returns may still be read from here, so its folder stays until ``clear`` is told to remove it or the
Python process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is chosen if none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Scratch:
    """A set of tables under one new folder; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _open.append(self)

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def store(self, df: DataFrame, table: str) -> DataFrame:
        """Write a frame and return one that reads it back."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        self._delete(*[self.path(t) for t in tables])

    def _delete(self, *folders: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in folders:
            path = hadoop.Path(folder)
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        """Remove the folder with all of its tables."""
        if self in _open:
            _open.remove(self)
        self._delete(self.folder)


def mark() -> int:
    """A point in time for ``clear``."""
    return len(_open)


def clear(since: int = 0) -> None:
    """Remove the folders made since a mark (or ever), once nothing reads the results in them any more."""
    while len(_open) > since:
        scratch = _open.pop()
        if scratch.spark.sparkContext._jsc is not None:
            scratch.close()


@atexit.register
def _at_end() -> None:
    """Folders of a session that still runs when the process ends."""
    try:
        clear()
    except Exception:  # the JVM may be gone before
        _open.clear()
