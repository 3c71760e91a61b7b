"""Joins of sets that share enough: pairs meet on rare members only.

Members are put in one order, from the rarest to the most common one. If two sets share at least s members, the first of these stands
among the first size - s + 1 of each. So a set is met with its prefix only, and a place that leaves fewer than s members behind it
brings no pair; members that nearly all sets have are reached by none but sets that hold little else. Hot members are split
(``skew``). Pairs that meet are counted on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.skew import lookup, salted
from quillspark.plans.scratch import Scratch


def _ordered(sets: DataFrame, frequency: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """(id, members): the distinct members from the rarest to the most common one, ties by the member."""
    members = scratch.store(sets.select("id", F.explode(F.array_distinct("members")).alias("member")).where("member is not null"), f"{table}_members")
    counted = lookup(members, frequency, "member", members.count(), "left").select("id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "member").alias("m"))
    return scratch.store(counted.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["member"]).alias("members")), table)


def _least(share: float, size: Column, least: int) -> Column:
    """How many members a set of this size has to share; rounding errors only ever lower it."""
    return F.greatest(F.lit(least), F.ceil(F.lit(share) * size - 1e-9)).cast("int")


def _meet(prefixes: DataFrame, others: DataFrame, need: Column, total: int) -> DataFrame:
    """Pairs (a, b) of a set whose prefix holds a member, and another that has it early enough to share as many."""
    size = F.size("members")
    first = prefixes.withColumn("need", need).select(F.col("id").alias("a"), "need", F.explode(F.expr("slice(members, 1, greatest(size(members) - need + 1, 0))")).alias("member"))
    every = others.select(F.col("id").alias("b"), size.alias("size"), F.posexplode("members").alias("at", "member"))
    return salted(every, first, "member", total, "b").where(F.col("size") - F.col("at") >= F.col("need")).select("a", "b")


def candidates(asked: DataFrame, kept: DataFrame, of_asked: float, of_kept: float, least: int, total: int) -> DataFrame:
    """(asked, kept) pairs of ordered sets that may share ``of_asked`` of the asked one's members, or ``least`` and ``of_kept`` of the kept one's."""
    size = F.size("members")
    by_asked = _meet(asked, kept, _least(of_asked, size, 1), total).select(F.col("a").alias("asked"), F.col("b").alias("kept"))
    by_kept = _meet(kept, asked, _least(of_kept, size, least), total).select(F.col("b").alias("asked"), F.col("a").alias("kept"))
    return by_asked.union(by_kept).distinct()


def sharing(asked: DataFrame, kept: DataFrame, of_asked: float, of_kept: float, least: int, scratch: Scratch) -> DataFrame:
    """(asked, kept, shared) of all pairs of sets (id, members) that share ``of_asked`` of the asked one's distinct members, or ``least`` and
    ``of_kept`` of the kept one's. Null members and empty sets share nothing; ids are distinct in each table."""
    frequency = scratch.store(kept.select(F.explode(F.array_distinct("members")).alias("member")).groupBy("member").agg(F.count("*").alias("n")), "frequency")
    left, right = _ordered(asked, frequency, scratch, "asked_sets"), _ordered(kept, frequency, scratch, "kept_sets")
    total = sum(side.agg(F.sum(F.size("members"))).first()[0] or 0 for side in (left, right))
    met = scratch.store(candidates(left, right, of_asked, of_kept, least, total), "met")
    n = met.count()
    one = lookup(met, left.select(F.col("id").alias("asked"), F.col("members").alias("x")), "asked", n)
    both = lookup(scratch.store(one, "half"), right.select(F.col("id").alias("kept"), F.col("members").alias("y")), "kept", n)
    counted = both.select("asked", "kept", F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"), F.size("x").alias("n_x"), F.size("y").alias("n_y"))
    enough = (F.col("shared") / F.col("n_x") >= of_asked) | (F.col("shared") >= least) & (F.col("shared") / F.col("n_y") >= of_kept)
    return counted.where(enough).select("asked", "kept", "shared")
