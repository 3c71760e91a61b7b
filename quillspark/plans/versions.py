"""Versions of a table's state: small JSON documents, each a folder that is complete when it is there."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def newest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The number and the document of the newest complete version; -1 and an empty one without any."""
    for version in sorted((int(n[2:]) for n in names(spark, folder) if n.startswith("v-")), reverse=True):
        if "_SUCCESS" in names(spark, f"{folder}/v-{version}"):
            return version, json.loads(spark.read.text(f"{folder}/v-{version}").first()[0])
    return -1, {}


def commit(spark: SparkSession, folder: str, version: int, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/v-{version}")


def remove(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
