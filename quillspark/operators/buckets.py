"""A table kept by key in hash buckets, merged by copying what a batch touches.

A row's bucket follows from its key's hash. A batch reads and writes only the buckets that its keys fall into, into new folders; a
manifest names the folder of each bucket, so a version is there at once and readers of an older one are not disturbed. A batch with the number
of one that was merged before changes nothing. One writer at a time.

Edge cases: of rows with one key the latest by ``order`` counts, of those alike in it the largest by all columns; a null key is a key like
others; an empty batch only notes its number; columns that the table does not have yet are null in its older rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.plans import versions
from quillspark.plans.scratch import Scratch

BUCKETS = 256


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of the newest version; None if nothing was merged yet."""
    _, state = versions.newest(spark, f"{folder}/manifest")
    return _of(spark, folder, sorted(state.get("buckets", {}).items())) if state.get("buckets") else None


def _of(spark: SparkSession, folder: str, buckets: list[tuple[str, str]]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[f"{folder}/{name}/bucket={bucket}" for bucket, name in buckets])


def merge(batch: DataFrame, folder: str, key: str, order: str, number: int, buckets: int = BUCKETS) -> list[int]:
    """Merge a batch of that number; returns the buckets that were rewritten. The first batch sets how many there are."""
    spark, scratch = batch.sparkSession, Scratch(batch.sparkSession, "merge")
    version, state = versions.newest(spark, f"{folder}/manifest")
    if number <= state.get("number", -1):
        return []
    held, buckets = state.get("buckets", {}), state.get("of", buckets)
    new = scratch.store(batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    old = [(str(b), held[str(b)]) for b in touched if str(b) in held]
    rows = new
    if old:
        rows = new.unionByName(_of(spark, folder, old).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), allowMissingColumns=True)
    latest = rows.groupBy("bucket", key).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (key, order, "bucket")])).alias("row")) if len(rows.columns) > 3 else rows.groupBy("bucket", key).agg(F.max(F.struct(order)).alias("row"))
    name = f"batch-{number}-{version + 1}"
    columns = [c for c in rows.columns if c != "bucket"]
    latest.select("bucket", key, "row.*").select("bucket", *columns).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
    versions.commit(spark, f"{folder}/manifest", version + 1, {"number": number, "of": buckets, "buckets": held | {str(b): name for b in touched}})
    scratch.close()
    return touched


def vacuum(spark: SparkSession, folder: str) -> None:
    """Remove buckets and manifests that the newest version does not need."""
    version, state = versions.newest(spark, f"{folder}/manifest")
    held = state.get("buckets", {})
    for name in [n for n in versions.names(spark, folder) if n.startswith("batch-")]:
        own = [n for n in versions.names(spark, f"{folder}/{name}") if n.startswith("bucket=")]
        kept = [n for n in own if held.get(n[7:]) == name]
        versions.remove(spark, *[f"{folder}/{name}/{n}" for n in own if n not in kept] if kept else [f"{folder}/{name}"])
    versions.remove(spark, *[f"{folder}/manifest/{n}" for n in versions.names(spark, f"{folder}/manifest") if n != f"v-{version}"])
