"""Sharding by extendible hashing.

A document's 64-bit hash names its bucket by a prefix of its bits. One pass sums bytes by a long prefix; sums over
shorter ones follow from these. A bucket that is over the limit splits on one more bit, others stay as they are, so
a leaf is a prefix that fits while its parent does not. The directory maps every prefix of the global depth that occurs
to its leaf. If a prefix of the first pass is still over the limit, its documents alone go through another pass with
longer prefixes. Rows that agree in all 64 bits (copies of one row) go to overflow pages of the bucket, each within the
limit; a document that is over the limit alone has a page of its own and is marked.

Edge cases: null and empty texts have no bytes and are placed like others; null ids are hashed as such; repeated rows
share a bucket, or its pages; an empty table gives no shards; further columns of any name are kept, but those named like the
result's (shard, depth, page, n_bytes, oversized) are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quillspark.plans.scratch import Scratch

LIMIT = 32 * 1024 * 1024
SPARE_BITS = 4  # of the first pass beyond what even buckets would need
MOST_BITS = 22  # of one pass
MOST_LEAVES = 1 << 23  # that are broadcast


def prefix(h: Column, bits: int) -> Column:
    """The first bits of a hash as a number; 0 for none."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint")


RESULT = ("n_bytes", "shard", "depth", "page", "oversized")


def _hashed(docs: DataFrame) -> DataFrame:
    """The rows, each whole in one column, with hash and size; so no column of theirs can meet a name used here."""
    own = F.struct(*[docs[c] for c in docs.columns if c.lower() not in RESULT])
    size = F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("bigint")
    return docs.select(own.alias("_row"), F.xxhash64(F.lit(11), docs["doc_id"], docs["text"]).alias("_h"), size.alias("n_bytes"))


def directory(sizes: DataFrame, limit: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """From (_h, n_bytes), for each pass its depth and its directory: (cell, depth, prefix, total), a leaf for each cell.

    A leaf over the limit occurs at depth 64 only.
    """
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(MOST_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS))
    out = []
    while True:
        cells = sizes.groupBy(prefix(F.col("_h"), high).alias("cell")).agg(F.sum("n_bytes").alias("total"))
        shorter = F.expr(f"if(depth = 0, 0L, shiftrightunsigned(cell, {high} - depth))")
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", shorter)
        buckets = scratch.store(levels.groupBy("depth", "prefix").agg(F.sum("total").alias("total")), f"buckets{high}")
        over = buckets.where(F.col("total") > limit)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = buckets.where(F.col("total") <= limit)
        leaves = fits.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").drop("parent")
        leaves = leaves.unionByName(fits.where("depth = 0"))
        left = over.where(F.col("depth") == high)
        if high == 64:
            leaves = leaves.unionByName(left)
        entries = levels.select("cell", "depth", "prefix").join(leaves, ["depth", "prefix"]).select("cell", "depth", "prefix", "total")
        out.append((high, scratch.store(entries, f"directory{high}")))
        if high == 64 or left.isEmpty():
            return out
        full = left.select(F.col("prefix").alias("_p"))
        sizes = scratch.store(sizes.join(full, prefix(F.col("_h"), high) == F.col("_p"), "left_semi"), f"left{high}")
        low, high = high, min(64, high + MOST_BITS)


def _with_leaves(rows: DataFrame, passes: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """The rows with the depth of their leaf, and whether it is over the limit (``_over``).

    Leaves are ranges of the hash. Up to ``MOST_LEAVES`` of them, nine bytes each, go to all tasks, which look hashes up
    there, so rows stay where they are; a directory of more leaves is joined.
    """
    leaves = None
    for _, entries in passes:
        own = entries.select("depth", "prefix", (F.col("total") > limit).alias("over")).distinct()
        leaves = own if leaves is None else leaves.union(own)
    if leaves.count() > MOST_LEAVES:
        found = [f"_leaf{bits}" for bits, _ in passes]
        for (bits, entries), name in zip(passes, found, strict=True):
            leaf = entries.select(F.col("cell").alias("_cell"), F.struct("depth", (F.col("total") > limit).alias("over")).alias(name))
            rows = rows.join(leaf, prefix(F.col("_h"), bits) == F.col("_cell"), "left").drop("_cell")
        leaf = F.coalesce(*found)
        return rows.withColumn("depth", leaf["depth"]).withColumn("_over", leaf["over"]).drop(*found)
    table = leaves.toArrow()
    depth, over = (table.column(c).to_numpy().astype(np.uint8) for c in ("depth", "over"))
    first = table.column("prefix").to_numpy().astype(np.int64).view(np.uint64)
    first = np.where(depth == 0, np.uint64(0), first << np.minimum(64 - depth.astype(np.uint64), np.uint64(63)))
    order = np.argsort(first, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((first[order], (depth + 128 * over)[order]))

    @F.pandas_udf("int")
    def leaf_of(h: pd.Series) -> pd.Series:
        begins, codes = shared.value
        return pd.Series(codes[np.searchsorted(begins, h.to_numpy(dtype=np.int64).view(np.uint64), side="right") - 1].astype(np.int32))

    coded = rows.withColumn("_code", leaf_of("_h"))
    return coded.withColumn("depth", F.col("_code") % 128).withColumn("_over", F.col("_code") >= 128).drop("_code")


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` with n_bytes, shard (the bits of its prefix), depth, page and oversized."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = _hashed(docs)
    passes = directory(scratch.store(rows.select("_h", "n_bytes"), "sizes"), limit, scratch)
    out = _with_leaves(rows, passes, limit)
    digits = F.lpad(F.conv(F.hex(F.expr("if(depth = 0, 0L, shiftrightunsigned(_h, 64 - depth))")), 16, 2), 64, "0")
    out = out.withColumn("shard", digits.substr(F.lit(65) - F.col("depth"), F.col("depth"))).withColumn("oversized", F.col("n_bytes") > limit)
    scratch.drop("sizes", *[f"{t}{bits}" for bits, _ in passes for t in ("buckets", "left")])
    if passes[-1][0] < 64 or passes[-1][1].where(F.col("total") > limit).isEmpty():
        return out.withColumn("page", F.lit(0).cast("bigint")).select("_row.*", *RESULT)
    # Copies that fill a bucket alone are equal in size: pages of so many rows, numbered within parts of the table.
    full = scratch.store(out.where("_over").withColumn("_part", F.spark_partition_id()), "overflow")
    counts = full.groupBy("_h", "_part").agg(F.count("*").alias("n"), F.max("n_bytes").alias("b"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("b"), F.lit(1))))
    before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_h", "_part", each.alias("_each"), F.coalesce(F.sum(F.ceil(F.col("n") / each)).over(before), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_h", "_part").orderBy("n_bytes")) - 1
    paged = full.withColumn("_n", number).join(counts, ["_h", "_part"])
    paged = paged.withColumn("page", (F.col("_first") + F.floor(F.col("_n") / F.col("_each"))).cast("bigint"))
    rest = out.where("not _over").withColumn("page", F.lit(0).cast("bigint"))
    return rest.select("_row.*", *RESULT).unionByName(paged.select("_row.*", *RESULT))


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write each shard's rows, page by page, to a folder of its own."""
    placed = assign(docs, limit)
    placed.repartition("shard", "page").sortWithinPartitions("shard", "page").write.mode("overwrite").partitionBy("shard", "page").parquet(folder)


def read_shards(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The rows of all shards, with what their files and folders say: depth from the shard's name, n_bytes from the text."""
    kept = [f for f in like.schema if f.name.lower() not in RESULT]
    fields = [StructField("shard", StringType()), StructField("page", LongType()), StructField("oversized", BooleanType())]
    rows = spark.read.schema(StructType([*kept, *fields])).parquet(folder).withColumn("shard", F.coalesce("shard", F.lit("")))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint")
    return rows.select(*[f.name for f in kept], size.alias("n_bytes"), "shard", F.length("shard").alias("depth"), "page", "oversized")
