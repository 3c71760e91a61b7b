"""One query for each training-data operator, over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import chat_format, decontamination, html_extraction, merkle, near_dup, packing, prefix_trie, projected_search, secrets, sharding, token_index, topk_search, toxicity
from quillspark.plans.scratch import Scratch

SHARD_BYTES = 256 * 1024  # of the query; files of a large table are better cut at sharding.LIMIT


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(_table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    added = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{control}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.examples(rows.union(added)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most ``SHARD_BYTES``, a limit that splits tables of every size, written and read back."""
    docs, scratch = _table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "shards")
    sharding.write_shards(docs, scratch.path("shards"), SHARD_BYTES)
    return sharding.read_shards(spark, scratch.path("shards"), docs).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.token_table(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontamination, op2_html_extraction, op3_chat_format, op4_toxicity, op5_extendible_shards,
        op6_packing, op7_token_index, op8_secret_scan, op9_minhash_near_dup, op10_exact_topk, op11_projected_neighbours, op12_merkle_manifest, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat_format.DIGEST_SQL, "op10_exact_topk": topk_search.TOPK_SQL, "op12_merkle_manifest": merkle.VERIFIED_SQL, "op13_prefix_trie": prefix_trie.TRIE_SQL}
