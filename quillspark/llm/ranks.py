"""Ranks and running sums within groups of any size.

Rows are dealt to ranges of (group, order, row number), so a group that holds a third of all rows lies in many ranges. Each range
counts for itself and is written; what groups bring with them from earlier ranges is worked out from one row for each range and
added when the rows are read. Sums are modulo 2**64, so sums of hashes are hashes of what was summed.

Edge cases: a null group is a group like others and comes first, as nulls do in the order; rows that are alike in all of these
get ranks by their place in the input; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from quillspark.llm.arrow import bound_batches, longs
from quillspark.plans.scratch import Scratch

RANGE = 1 << 20  # rows of a range, about
FEW = 1 << 12  # rows for which a range of their own is too many


def ranges(spark, n: int) -> int:
    """Into how many ranges so many rows are dealt."""
    return max(1, -(-n // RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // FEW))


def _runs(column: pa.Array) -> np.ndarray:
    """Where runs of equal values begin; nulls are equal."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


def ranked(rows: DataFrame, group: str, order: Sequence[str], scratch: Scratch, table: str, sums: Sequence[str] = ()) -> DataFrame:
    """``rows`` in order with ``rank`` (from 1) in their group; for each long column of ``sums`` also the sum of what comes before the row in
    its group, <name>_before, and the sum with the row, <name>_sum. The rows are in the table that is written to ``scratch``."""
    spark = rows.sparkSession
    bound_batches(spark)
    fields = rows.schema
    schema = StructType([*fields]).add("rank", LongType(), False).add("_part", IntegerType(), False).add("_first", BooleanType(), False)
    for c in sums:
        schema = schema.add(f"{c}_sum", LongType(), False)
    at, summed = fields.names.index(group), [fields.names.index(c) for c in sums]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, first = TaskContext.get().partitionId(), None, 0, True
        totals = [np.zeros(1, dtype=np.int64) for _ in sums]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            starts = _runs(b.column(at))
            goes_on = count > 0 and b.column(at)[0].as_py() == last
            first = first and (goes_on or not count)
            run = np.searchsorted(starts, np.arange(n), side="right") - 1
            rank = np.arange(n) - starts[run] + 1 + np.where(run == 0, count if goes_on else 0, 0)
            found = []
            for i, c in enumerate(summed):
                so_far = np.concatenate([[0], np.cumsum(longs(b.column(c)))])
                found.append(so_far[1:] - so_far[starts][run] + np.where(run == 0, totals[i] if goes_on else 0, 0))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(fields))], pa.array(rank), pa.array(np.full(n, part, dtype=np.int32)), pa.array((run == 0) & first), *map(pa.array, found)], names=schema.names
            )
            last, count, first = b.column(at)[n - 1].as_py(), int(rank[-1]), first and len(starts) == 1
            totals = [f[-1:] for f in found]

    keys = [group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges(spark, rows.count()), *keys).sortWithinPartitions(*keys).drop("_row")
    written = scratch.store(dealt.mapInArrow(number, schema), table)
    end = F.struct(F.col(group).alias("group"), "rank", *[f"{c}_sum" for c in sums])
    ends = written.groupBy("_part").agg(F.max(F.when(F.col("_first"), end)).alias("head"), F.max(end).alias("tail"), F.max((~F.col("_first")).cast("int")).alias("cut")).collect()
    brought: dict[int, list[int]] = {}
    last, carried = None, [0] * (1 + len(sums))
    for r in sorted(ends, key=lambda r: r["_part"]):
        if last is not None and r["head"][0] == last[0]:
            brought[r["_part"]] = carried
        else:
            carried = [0] * (1 + len(sums))
        own = r["tail"] if r["cut"] else r["head"]
        carried = [int(x) if r["cut"] else _wrap(int(x) + y) for x, y in zip(own[1:], carried, strict=True)]
        last = (own[0],)
    held = spark.sparkContext.broadcast(brought)
    result = StructType([*fields]).add("rank", LongType(), False)
    for c in sums:
        result = result.add(f"{c}_before", LongType(), False).add(f"{c}_sum", LongType(), False)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fields)
        for b in batches:
            part, first = longs(b.column(k + 1)), b.column(k + 2).to_numpy(zero_copy_only=False)
            more = np.zeros((b.num_rows, 1 + len(sums)), dtype=np.int64)
            for p in np.unique(part[first]).tolist():
                more[first & (part == p)] = held.value.get(p, 0)
            out = [longs(b.column(k)) + more[:, 0]]
            for i, c in enumerate(summed):
                total = longs(b.column(k + 3 + i)) + more[:, 1 + i]
                out += [total - longs(b.column(c)), total]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], *map(pa.array, out)], names=result.names)

    return written.mapInArrow(add, result)


def _wrap(x: int) -> int:
    """A sum as a long, modulo 2**64."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)
