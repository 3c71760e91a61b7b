"""Measures of tagging and of retrieval against gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Gates.
F1_GATE, RECALL_GATE, MRR_GATE, P95_GATE_MS = 0.85, 0.90, 0.80, 300.0


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(dimension, tp, fp, fn, gold) from (path, dimension, labels); only paths of the gold table count."""
    pairs = gold.select("path", "dimension", F.array_distinct("labels").alias("g")).join(predicted.select("path", "dimension", F.array_distinct("labels").alias("p")), ["path", "dimension"], "left")
    none = F.expr("cast(array() as array<string>)")
    pairs = pairs.withColumn("p", F.coalesce("p", none)).withColumn("g", F.coalesce("g", none))
    size = lambda c: F.sum(F.size(c).cast("bigint"))
    return pairs.groupBy("dimension").agg(size(F.array_intersect("g", "p")).alias("tp"), size(F.array_except("p", "g")).alias("fp"), size(F.array_except("g", "p")).alias("fn"), size(F.col("g")).alias("gold"))


def with_scores(counted: DataFrame) -> DataFrame:
    """Counts with precision, recall and F1, to four digits."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counted.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(_ratio(2 * p * r, p + r), 4))


def classification(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores by dimension, and over all of them as dimension ``micro``."""
    counted = counts(gold, predicted)
    micro = counted.agg(F.lit("micro").alias("dimension"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "gold")])
    return with_scores(counted.unionByName(micro))


def macro(scored: DataFrame) -> DataFrame:
    """(macro_f1, gate) over the dimensions that the gold table has labels of."""
    active = scored.where("dimension <> 'micro' and gold > 0")
    return active.agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1"), F.coalesce(F.min("f1") >= F1_GATE, F.lit(False)).alias("gate"))


def label_errors(gold: DataFrame, predicted: DataFrame, k: int = 12) -> DataFrame:
    """(dimension, kind, label, n): the labels most often given in vain or missed."""
    pairs = gold.select("path", "dimension", F.col("labels").alias("g")).join(predicted.select("path", "dimension", F.col("labels").alias("p")), ["path", "dimension"], "left")
    none = F.expr("cast(array() as array<string>)")
    pairs = pairs.withColumn("p", F.coalesce("p", none))
    wrong = pairs.select("dimension", F.lit("extra").alias("kind"), F.explode(F.array_except("p", "g")).alias("label"))
    missed = pairs.select("dimension", F.lit("missing").alias("kind"), F.explode(F.array_except("g", "p")).alias("label"))
    return wrong.union(missed).groupBy("dimension", "kind", "label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension", "kind", "label").limit(k)


def confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(gold, predicted, n) of single labels (path, label); a path without a prediction counts under null."""
    return gold.select("path", F.col("label").alias("gold")).join(predicted.select("path", F.col("label").alias("predicted")), "path", "left").groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def label_macro_f1(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of single labels."""
    pairs = confusion(gold, predicted)
    labels = pairs.select(F.col("gold").alias("label")).union(pairs.select("predicted")).where("label is not null").distinct()
    rows = pairs.select(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(~F.col("gold").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0).alias("fn"))
    wrong = pairs.where("predicted is not null and gold <> predicted").select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    return with_scores(labels.join(rows.unionByName(wrong), "label").groupBy("label").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]))


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, returned, hits, precision, recall, mrr, ndcg) from ranks (query_id, path, rank) and (query_id, path[, grade]).

    Precision divides by k even where fewer come back; gains are grades if there are any, else one.
    """
    grade = F.col("grade").cast("double") if "grade" in relevant.columns else F.lit(1.0)
    wanted = relevant.select("query_id", "path", grade.alias("gain")).distinct()
    top = ranked.where(F.col("rank") <= k)
    hit = top.join(wanted, ["query_id", "path"], "left")
    per = hit.groupBy("query_id").agg(
        F.count("*").alias("returned"), F.count("gain").alias("hits"), F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))).alias("first"), F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "path"))
    ideal = wanted.withColumn("place", place).groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1.0))).alias("idcg"))
    rows = ideal.join(per, "query_id", "left").na.fill(0, ["returned", "hits", "dcg"])
    return rows.select(
        "query_id", "returned", "hits", F.round(F.col("hits") / k, 4).alias("precision"), F.round(_ratio(F.col("hits"), F.col("n_relevant")), 4).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.round(_ratio(F.col("dcg"), F.col("idcg")), 4).alias("ndcg"),
    )


def retrieval_summary(measured: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Means over queries, the 95th percentile of (latency_ms) by nearest rank, and the gate."""
    out = measured.agg(F.round(F.avg("recall"), 4).alias("mean_recall"), F.round(F.avg("mrr"), 4).alias("mean_mrr"), F.round(F.avg("ndcg"), 4).alias("mean_ndcg"))
    if latency is None:
        return out
    p95 = latency.agg(F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95_ms"))
    return out.join(F.broadcast(p95)).withColumn("gate", (F.col("mean_recall") >= RECALL_GATE) & (F.col("mean_mrr") >= MRR_GATE) & (F.col("p95_ms") < P95_GATE_MS))
