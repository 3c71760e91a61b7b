"""Tables that prepare a base: stage folders, special files, samples to try first, goals' weights, proposals, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Keywords of sample topics, in order of choice.
SAMPLE_LEAVES = {
    "B站": ["b站", "好物", "悬赏", "蓝链"],
    "视频号": ["视频号"],
    "小红书": ["小红书", "小绿书"],
    "YouTube_TK": ["youtube", "tiktok", "/tk", "ypp", "shorts", "推特"],
    "生图": ["生图", "绘画", "comfyui", "nanobanana"],
    "视频": ["即梦", "seedance", "sora", "可灵", "剪辑"],
    "编程": ["cursor", "codex", "claude", "代码", "小程序"],
}
LEAVES, SAMPLES = 4, 5
FORM_SHARE = 0.6
PROPOSAL_NOTES = 3


def stage_folders(stages: DataFrame) -> DataFrame:
    """(flow, stage, folder) of (flow, stage, order): a stage's name gets its number unless it begins with one."""
    name = F.when(F.col("stage").rlike(r"^\d"), F.col("stage")).otherwise(F.concat_ws("_", F.col("order").cast("string"), "stage"))
    return stages.select("flow", "stage", F.concat_ws("/", F.lit("工作流"), "flow", name).alias("folder"))


def special_files(pairs: DataFrame, keep_minutes: bool) -> DataFrame:
    """(path, action) of file pairs (kind, path, partner): what to do with pdfs without notes and minutes without an essence."""
    pdf = F.when(F.col("path").rlike("卡片版|知识卡片"), "extract_cards").when(F.col("path").contains("问答"), "extract").otherwise("register")
    action = F.when(F.col("kind") == "orphan_pdf", pdf).when(F.col("kind") == "minutes", F.lit("generate_essence" if keep_minutes else "skip"))
    return pairs.where("partner is null and kind <> 'orphan_srt'").select("path", action.alias("action"))


def samples(docs: DataFrame) -> DataFrame:
    """(path, leaf): for the first topics that occur the path of middle length, then other paths, five in all."""
    spark: SparkSession = docs.sparkSession
    leaves = spark.createDataFrame([(n, leaf, word) for n, (leaf, words) in enumerate(SAMPLE_LEAVES.items()) for word in words], "n int, leaf string, word string")
    met = docs.where(~F.lower("path").contains("transcript")).join(F.broadcast(leaves), F.lower("path").contains(F.col("word"))).select("n", "leaf", "path").distinct()
    # A path counts for the first of its topics.
    own = met.groupBy("path").agg(F.min(F.struct("n", "leaf")).alias("l")).select("path", "l.n", "l.leaf")
    leaf = Window.partitionBy("n")
    middle = own.withColumn("r", F.row_number().over(leaf.orderBy(F.length("path"), "path"))).withColumn("c", F.count("*").over(leaf)).where("r = floor(c / 2) + 1")
    chosen = middle.orderBy("n").limit(LEAVES).select("path", "leaf", "n")
    rest = docs.join(chosen, "path", "left_anti").orderBy("path").limit(SAMPLES).select("path", F.lit("补充").alias("leaf"), F.lit(len(SAMPLE_LEAVES)).alias("n"))
    return chosen.union(rest).orderBy("n", "path").limit(SAMPLES).select("path", "leaf")


def goal_weights(goals: DataFrame) -> DataFrame:
    """(form, weight, single) of ranked goals (form, rank from 0): weights by place; a form with 0.6 of them stands alone."""
    n = F.count("*").over(Window.partitionBy())
    placed = goals.withColumn("w", n - F.col("rank"))
    shared = placed.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))
    return shared.groupBy("form").agg(F.round(F.sum("w"), 4).alias("weight")).withColumn("single", F.col("weight") >= FORM_SHARE)


def proposals(unplaced: DataFrame, least: int = PROPOSAL_NOTES) -> DataFrame:
    """(label, n) of (path, label) that fit no stage: worth a stage of their own from three on."""
    return unplaced.groupBy("label").agg(F.count_distinct("path").alias("n")).where(F.col("n") >= least)


def triage(tags: DataFrame) -> DataFrame:
    """(path, level, confidence) of tagged paths: sure ones, ones to confirm, ones to sort by hand."""
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return tags.select("path", level.alias("level"), "confidence")


def recipes(names: list[str], seeds: list[dict]) -> list[dict]:
    """A recipe for each project: the seed of its name, or an open one to be filled in."""
    known = {s["project"]: s for s in seeds}
    blank = {"filters": {}, "exclude": ["过时", "草稿", "低信心低质量"], "rank": ["相关度", "时间"]}
    return [{"keywords": "", "limit": 50, **blank, **known.get(n, {}), "project": n} for n in names]
