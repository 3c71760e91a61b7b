"""A Bloom filter of document ids, small enough to be broadcast: it decides which rows have to meet an exact join.

It has ``BITS`` bits for each id up to ``MOST`` bits in all (32 MB), two of them set by an id. Beyond some twenty million ids it
passes ever more rows; results never depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

BITS = 16
MOST = 1 << 28


def filter_of(ids: DataFrame) -> tuple[Broadcast, int]:
    """The filter of ``ids`` (one column of longs) for ``passes``, and its size in bits."""
    spark = ids.sparkSession
    size = min(MOST, 1 << max(12, (BITS * ids.count() - 1).bit_length()))
    places = F.explode(F.array(*places_of(F.col(ids.columns[0]), size))).alias("place")
    words = ids.select(places).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size >> 6, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return spark.sparkContext.broadcast(table.view(np.uint64)), size


def places_of(of: Column, size: int) -> tuple[Column, Column]:
    """The two bits that an id sets."""
    h = F.xxhash64(of)
    return h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 32).bitwiseAND(size - 1)


def passes(table: np.ndarray, first: pa.Array, second: pa.Array) -> pa.Array:
    """Whether both bits of each id are set."""
    out = np.ones(len(first), dtype=bool)
    for column in (first, second):
        place = column.to_numpy(zero_copy_only=False).astype(np.uint64)
        out &= (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return pa.array(out)


def may_hold(ids: DataFrame, of: Column) -> Column:
    """Whether ``of`` may be among ``ids`` (one column of longs); false is sure, and null is never held.

    This is a Python function: before another one in the same stage, each task would need two Python workers, and as many
    stay. There ``passes`` belongs into the other function.
    """
    held, size = filter_of(ids)

    @F.arrow_udf("boolean")
    def hit(first: pa.Array, second: pa.Array) -> pa.Array:
        return passes(held.value, first, second)

    return of.isNotNull() & hit(*places_of(of, size))
