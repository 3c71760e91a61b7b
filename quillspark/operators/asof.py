"""As-of join: to each point the last start at or before it, by one sort of both.

Points and starts are put in one order; a running "last start" then meets each point without comparing it with others. Rows are dealt to
ranges of (key, place), so a key of any size is the work of many tasks, and a range takes what the ranges before it have ended
with. The work grows with the rows, not with the product of a key's points and starts.

Edge cases: points without a key, a place or a start at or before them get nulls; starts without a key or a place are ignored; of starts at one
place the largest row counts; repeated points stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.plans.scratch import Scratch

RANGE = 1 << 18  # rows of a range, about


def as_of(points: DataFrame, starts: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """``points`` with the column ``held``: the row (struct) of ``starts`` of the same ``key`` with the last ``start`` that is not after ``at``."""
    spark, scratch = points.sparkSession, Scratch(points.sparkSession, "as-of")
    row, point = F.struct(*[F.col(c) for c in starts.columns]), F.struct(*[F.col(c) for c in points.columns])
    first = starts.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key).alias("key"), F.col(start).cast("bigint").alias("at"), F.lit(0).alias("kind"), row.alias("held"))
    both = first.unionByName(points.select(F.col(key).alias("key"), F.col(at).cast("bigint").alias("at"), F.lit(1).alias("kind"), point.alias("point")), allowMissingColumns=True)
    both = scratch.store(both, "both")
    parts = max(1, -(-both.count() // RANGE))
    ranged = both.repartitionByRange(parts, "key", "at", "kind") if parts > 1 else both
    ranged = scratch.store(ranged.withColumn("part", F.spark_partition_id() if parts > 1 else F.lit(0)), "ranged")
    so_far = Window.partitionBy("key", "part").orderBy("at", "kind", "held").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("own", F.last("held", ignorenulls=True).over(so_far)).where("kind = 1")
    last = F.max(F.when(F.col("kind") == 0, F.struct("at", "held")))["held"]
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    brought = ranged.groupBy("key", "part").agg(last.alias("last")).withColumn("brought", F.last("last", ignorenulls=True).over(earlier)).where("brought is not null").select("key", "part", "brought")
    out = found.join(brought, ["key", "part"], "left")
    held = F.when(F.col("at").isNotNull() & F.col("key").isNotNull(), F.coalesce("own", "brought"))
    return out.select("point.*", held.alias("held"))
