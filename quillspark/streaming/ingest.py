"""Notes as a stream: files that arrive are parsed and merged into a table by path, the latest version of each kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import text as t
from quillspark.operators import buckets
from quillspark.sources.notes import parse_notes


def note_stream(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, arrived) of markdown files as they appear below a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), t.newlines(F.col("value")).alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def merge_into(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merge parsed notes into a table of buckets under ``folder`` (``buckets.read``): a batch rewrites only the buckets of its notes.

    A batch that is repeated after a failure changes nothing, so notes are neither lost nor doubled.
    """

    def merge(batch: DataFrame, number: int) -> None:
        buckets.merge(parse_notes(batch).join(batch.select("path", "arrived"), "path"), folder, "path", "arrived", number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) in windows of time, later ones than ``late`` dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
