"""Aggregations over notes and units: topics, stage overviews, shared terms, inventories, file pairs, merges and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import text as t

# Fixed values.
SUBSTAGES = ("总览", "子技巧", "案例", "工具", "坑")
TOPICS_A_NOTE = 5
SHORTEST_TOPIC = 2
MERGE_DOCS = 3
GENERIC_SHARE = 0.5
ESSENCE = "·精华笔记.md"


def topics(notes: DataFrame) -> DataFrame:
    """(topic, doc_count, docs): distinct notes by topic; most first, then by name."""
    rows = notes.select("path", F.explode("topics").alias("topic")).where(F.length("topic") >= SHORTEST_TOPIC).distinct()
    return rows.groupBy("topic").agg(F.count("*").alias("doc_count"), F.array_sort(F.collect_list("path")).alias("docs"))


def topic_counts(notes: DataFrame) -> DataFrame:
    """(topic, doc_count, shared, merge_candidate) without lists of notes, which may be long."""
    rows = notes.select("path", F.explode("topics").alias("topic")).where(F.length("topic") >= SHORTEST_TOPIC).distinct()
    counted = rows.groupBy("topic").agg(F.count("*").alias("doc_count"))
    return counted.withColumn("shared", F.col("doc_count") >= 2).withColumn("merge_candidate", F.col("doc_count") >= MERGE_DOCS)


def too_many_topics(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.size(F.array_distinct("topics")).alias("n_topics")).where(F.col("n_topics") > TOPICS_A_NOTE)


def flow_overview(notes: DataFrame) -> DataFrame:
    """(flow, stage, stage_order, substage, n): notes by place; all substages of a stage are there, empty ones too."""
    order = F.regexp_extract("stage", r"^(\d+)", 1).try_cast("int")
    groups = notes.select("flow", "stage").distinct().withColumn("substage", F.explode(F.array(*[F.lit(s) for s in SUBSTAGES])))
    counts = notes.groupBy("flow", "stage", "substage").agg(F.count("*").alias("n"))
    return groups.join(counts, ["flow", "stage", "substage"], "left").select("flow", "stage", order.alias("stage_order"), "substage", F.coalesce("n", F.lit(0)).alias("n"))


def generic_terms(notes: DataFrame, grams: Column, share: float = GENERIC_SHARE) -> DataFrame:
    """(gram, df, share, generic): document frequency of terms over all notes."""
    rows = notes.select("path", F.explode(F.array_distinct(grams)).alias("gram"))
    return generic(rows.groupBy("gram").agg(F.count("*").alias("df")), notes, share)


def generic(frequencies: DataFrame, notes: DataFrame, share: float = GENERIC_SHARE) -> DataFrame:
    """The same from the document frequencies (gram, df) of an index of the notes."""
    whole = notes.agg(F.count("*").alias("n"))
    return frequencies.join(F.broadcast(whole)).select("gram", "df", F.round(F.col("df") / F.col("n"), 4).alias("share"), (F.col("df") / F.col("n") >= share).alias("generic"))


def generic_ratio(notes: DataFrame, grams: Column, share: float = GENERIC_SHARE) -> DataFrame:
    """(path, n_grams, generic, ratio): how much of a note's terms most notes have."""
    rows = notes.select("path", F.explode(F.array_distinct(grams)).alias("gram"))
    terms = generic_terms(notes, grams, share).where("generic").select("gram", F.lit(1).alias("g"))
    counted = rows.join(terms, "gram", "left").groupBy("path").agg(F.count("*").alias("n_grams"), F.count("g").alias("generic"))
    return counted.withColumn("ratio", F.round(F.col("generic") / F.col("n_grams"), 4))


def stale_ratio(notes: DataFrame) -> DataFrame:
    n, stale = F.count("*"), F.sum(F.coalesce(F.col("stale"), F.lit(False)).cast("bigint"))
    return notes.agg(n.alias("n"), stale.alias("stale"), F.round(F.when(n > 0, stale / n), 4).alias("ratio"))


def inventory(files: DataFrame) -> DataFrame:
    """(class, ext, n, bytes) of files (path, size)."""
    return files.groupBy(t.file_class(F.col("path")).alias("class"), t.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def file_pairs(files: DataFrame) -> DataFrame:
    """(kind, path, partner) of (path): pdfs without a note of their name, subtitles without a text, minutes and their essence."""
    base = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    rows = files.select("path", base.alias("base"), t.extension(F.col("path")).alias("ext"))

    def partner(of: DataFrame, key: Column, kind: str) -> DataFrame:
        return of.withColumn("want", key).join(files.select(F.col("path").alias("partner")), F.col("want") == F.col("partner"), "left").select(F.lit(kind).alias("kind"), "path", "partner")

    orphan_pdf = partner(rows.where("ext = 'pdf'"), F.concat("base", F.lit(".md")), "orphan_pdf").where("partner is null")
    orphan_srt = partner(rows.where("ext = 'srt'"), F.concat("base", F.lit(".txt")), "orphan_srt").where("partner is null")
    minutes = partner(rows.where("ext = 'txt'"), F.concat("base", F.lit(ESSENCE)), "minutes")
    return orphan_pdf.union(orphan_srt).union(minutes)


def upsert(batches: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key; ``order`` says which is later."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return batches.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")


def snapshot(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files (path, text)."""
    return files.select("path", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two snapshots: added, deleted or modified; equal files are not told."""
    old, new = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def stale_notes(changes: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, source): notes with a source that changed, named by path or by file name."""
    named = notes.select("path", F.explode("sources").alias("source"))
    moved = changes.where("change in ('modified', 'deleted')").select(F.col("path").alias("changed"))
    by_path = named.join(moved, named["source"] == moved["changed"], "left_semi")
    names = moved.select(F.substring_index("changed", "/", -1).alias("name")).distinct()
    by_name = named.join(names, F.substring_index("source", "/", -1) == F.col("name"), "left_semi")
    return by_path.union(by_name).distinct()


def sync_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, moved_to): a snapshot's differences, with files that only moved told as such."""
    changes = diff(before, after)
    gone = changes.where("change = 'deleted'").join(before, "path").select("path", "sha256")
    come = changes.where("change = 'added'").join(after, "path").groupBy("sha256").agg(F.min("path").alias("moved_to"))
    moved = gone.join(come, "sha256").select("path", "moved_to")
    return changes.join(moved, "path", "left").withColumn("change", F.when(F.col("moved_to").isNotNull(), "moved").otherwise(F.col("change")))


def duplicate_assets(assets: DataFrame) -> DataFrame:
    """(fingerprint, n, first_locator) of (locator, text) equal but for white space and backticks, two or more."""
    bare = F.regexp_replace("text", r"[\s`]+", "")
    rows = assets.where(F.length(bare) > 0).groupBy(F.sha2(bare, 256).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("locator").alias("first_locator"))
    return rows.where("n >= 2")


def merge_units(units: DataFrame) -> DataFrame:
    """One unit for each concept or relation of a document: the first one's id, all evidence; other units stay."""
    named = units.where("type in ('concept', 'relation')")
    key = F.when(F.col("type") == "concept", F.col("name")).otherwise(F.concat_ws("|", "subject", "relation_type", "object"))
    merged = named.groupBy("doc_id", "type", key.alias("key")).agg(F.min("id").alias("id"), F.flatten(F.collect_list("evidence")).alias("evidence"), F.count("*").alias("merged"))
    rest = units.where("type not in ('concept', 'relation')").select("doc_id", "type", F.lit(None).cast("string").alias("key"), "id", "evidence", F.lit(1).cast("bigint").alias("merged"))
    return merged.unionByName(rest)


def citable(notes: DataFrame, source: str, seed_topics: list[str], limit: int = 200) -> DataFrame:
    """Notes worth citing: all if they are few; else those of the same source, then by shared topics, then of the busiest topics."""
    overlap = F.size(F.array_intersect("topics", F.array(*map(F.lit, seed_topics)).cast("array<string>")))
    busiest = topic_counts(notes).orderBy(F.desc("doc_count"), "topic").limit(10).select("topic")
    top = notes.select("path", F.explode("topics").alias("topic")).join(busiest, "topic", "left_semi").select("path").distinct().withColumn("busy", F.lit(True))
    rows = notes.join(top, "path", "left").select("path", "source", overlap.alias("overlap"), F.coalesce("busy", F.lit(False)).alias("busy"))
    tier = F.when(F.col("source") == source, 1).when(F.col("overlap") > 0, 2).when(F.col("busy"), 3)
    return rows.select("path", tier.alias("tier"), "overlap").where("tier is not null").orderBy("tier", F.desc("overlap"), "path").limit(limit)
