"""Snapshots of source files as a tree of folder digests, their differences, and the verdict on a source folder.

A folder's digest covers all files below it: the sum, in lanes, of hashes of their paths and contents. Sums are gathered before they are
shuffled, so a folder of any size is no group of rows, and every folder up to the root comes from one pass. Two trees differ
below those folders only whose digests differ: a comparison looks at the files of these and at no others.

Edge cases: a file without a digest was not readable: it is told as such, neither as modified nor as unchanged; a path without a folder lies in
the root, ``''``; equal trees have no difference; an empty snapshot has no folders; null paths are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LANES = 4  # of 32 bits each: sums of 2**31 files stay exact
VERDICT = "code string, status string, n bigint"


def _folders(path: Column) -> Column:
    """A path's folders, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _lanes() -> list[Column]:
    own = F.sha2(F.concat_ws("\x00", "path", F.coalesce("sha256", F.lit("?"))), 256)
    return [F.conv(own.substr(1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"lane{i}") for i in range(LANES)]


def tree(files: DataFrame) -> DataFrame:
    """(folder, parent, n_files, size, own, digest) of all folders of a snapshot (path, size, sha256); ``own`` covers the folder's files alone."""
    rows = files.where("path is not null").select("path", "size", *_lanes(), _folders(F.col("path")).alias("folders"))
    below = rows.select("size", *[f"lane{i}" for i in range(LANES)], F.element_at("folders", -1).alias("direct"), F.explode("folders").alias("folder"))
    direct = F.col("folder") == F.col("direct")
    sums = [F.sum(f"lane{i}").alias(f"sum{i}") for i in range(LANES)] + [F.sum(F.when(direct, F.col(f"lane{i}")).otherwise(F.lit(0))).alias(f"own{i}") for i in range(LANES)]
    found = below.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"), *sums)
    digest, own = (F.sha2(F.concat_ws(":", *[f"{name}{i}" for i in range(LANES)]), 256) for name in ("sum", "own"))
    parent = F.when(F.col("folder") != "", F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).otherwise(F.lit("")))
    return found.select("folder", parent.alias("parent"), "n_files", "size", own.alias("own"), digest.alias("digest"))


def changed_folders(before: DataFrame, after: DataFrame, digest: str = "digest") -> DataFrame:
    """(folder) whose digests differ between two trees, or that only one of them has."""
    old, new = (t.select("folder", F.col(digest).alias(name)) for t, name in ((before, "old"), (after, "new")))
    return old.join(new, "folder", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("folder")


def diff(before: DataFrame, after: DataFrame, before_tree: DataFrame | None = None, after_tree: DataFrame | None = None) -> DataFrame:
    """(path, change) between two snapshots: added, deleted, modified or unreadable. Only files of folders whose own digests differ are compared;
    trees that are kept with the snapshots need not be made again."""
    folders = changed_folders(before_tree if before_tree is not None else tree(before), after_tree if after_tree is not None else tree(after), "own")

    def within(files: DataFrame, name: str) -> DataFrame:
        rows = files.where("path is not null").withColumn("folder", F.element_at(_folders(F.col("path")), -1))
        return rows.join(folders, "folder", "left_semi").select("path", F.struct("sha256").alias(name))

    both = within(before, "old").join(within(after, "new"), "path", "full_outer").where("new.sha256 is not null or new is null")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old.sha256").eqNullSafe(F.col("new.sha256")), "modified")
    lost = after.where("sha256 is null").join(before.select("path"), "path", "left_semi").select("path", F.lit("unreadable").alias("change"))
    new = after.where("sha256 is null").join(before.select("path"), "path", "left_anti").where("path is not null").select("path", F.lit("added").alias("change"))
    return both.select("path", change.alias("change")).where("change is not null").unionByName(lost).unionByName(new)


def media_counts(files: DataFrame, groups: dict[str, str]) -> DataFrame:
    """(kind, n) of files (path) by what their extension counts as; other extensions do not count."""
    kinds = F.create_map(*[x for e, g in groups.items() for x in (F.lit(e), F.lit(g))])
    rows = files.select(F.try_element_at(kinds, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).alias("kind"))
    return rows.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def verdict(changes: DataFrame, media_before: DataFrame, media_after: DataFrame, listed_before: list[str] | None, listed_now: list[str]) -> DataFrame:
    """(code, status, n): what a source folder that is to be read only shows against its baseline.

    Files that went or changed fail. New files, files that cannot be read and other numbers of media warn. If the baseline was taken with
    another list of extensions, or an unknown one, that warns, and new files are pardoned: they come from the list. Nothing else is pardoned.
    """
    spark = changes.sparkSession
    other = listed_before is None or sorted(listed_before) != sorted(listed_now)
    codes = {"deleted": ("source_deleted", "fail"), "modified": ("source_modified", "fail"), "unreadable": ("unreadable", "warn"), "added": ("added_pardoned", "info") if other else ("source_added", "warn")}
    named = F.create_map(*[x for k, (code, status) in codes.items() for x in (F.lit(k), F.struct(F.lit(code).alias("code"), F.lit(status).alias("status")))])
    counted = changes.groupBy("change").agg(F.count("*").alias("n")).select(named[F.col("change")].alias("c"), "n").select("c.code", "c.status", "n")
    both = media_before.select("kind", F.col("n").alias("was")).join(media_after.select("kind", F.col("n").alias("now")), "kind", "full_outer")
    moved = both.where(~F.coalesce("was", F.lit(0)).eqNullSafe(F.coalesce("now", F.lit(0))))
    media = moved.select(F.concat(F.lit("media_changed:"), "kind").alias("code"), F.lit("warn").alias("status"), (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("n"))
    out = counted.unionByName(media)
    return out.unionByName(spark.createDataFrame([("list_changed", "warn", len(listed_now) - len(listed_before or []))], VERDICT)) if other else out


def overall(rows: DataFrame) -> DataFrame:
    """(status, n): fail before warn before pass; one row."""
    return rows.agg(
        F.when(F.max((F.col("status") == "fail").cast("int")) == 1, "fail").when(F.max((F.col("status") == "warn").cast("int")) == 1, "warn").otherwise("pass").alias("status"),
        F.count("*").alias("n"),
    )
