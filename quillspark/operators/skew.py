"""Joins of rows with hot keys to a table that holds each key once.

Of ``total`` rows at most ``HOT_KEYS`` keys can have ``total / HOT_KEYS`` of them or more, whatever the data. So the table's
rows of these keys are a bounded broadcast: rows with a hot key stay where they are, and of the others no key has more
than one row in ``HOT_KEYS`` (or ``HOT_ROWS``, where that is more) to bring to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 10_000
HOT_ROWS = 2048


def least_hot(total: int) -> int:
    """The number of rows from which a key counts as hot."""
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has each key once and rows of bounded size; ``rows`` should be cheap to read twice."""
    least = least_hot(total)
    if total < least:
        return rows.join(table, key, how)
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key))
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def salted(rows: DataFrame, table: DataFrame, key: str, total: int, by: str) -> DataFrame:
    """As ``lookup`` for an inner join to rows of any size, also several of a key: a hot key's rows are dealt to parts by a hash of ``by``, and what the
    table holds of it is repeated for each part."""
    least = least_hot(total)
    if total < least:
        return rows.join(table, key)
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / least).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    spread = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")
