"""The driver's tables in the shape of a knowledge base, and the same as SQL for an independent engine.

A document is a note: path from source and id, flow from language, stage from source, title from the first sentence,
topics from its most frequent long words. Conversations give structured texts, questions and question-answer units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.functions import text as t
from quillspark.operators import search, segments
from quillspark.plans.scratch import Scratch, exists

_indexes: dict[tuple, str] = {}
TOPICS = 3
TOPIC_CHARS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, title, body, flow, stage, substage, updated, stale, domains, forms, tools, types, projects, source)."""
    none = F.expr("cast(array() as array<string>)")
    n = F.col("n_chars")
    kind = F.when(n >= 3000, "教程").when(n >= 1500, "案例").when(n >= 500, "观点").otherwise("素材")
    place = F.when(n < 300, "总览").when(n < 1000, "子技巧").when(n < 2000, "案例").when(n < 4000, "工具").otherwise("坑")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("body"), F.col("lang").alias("flow"),
        F.col("source").alias("stage"), place.alias("substage"), day.alias("updated"), (n < 100).alias("stale"), F.array("lang").alias("domains"), F.array("source").alias("forms"), none.alias("tools"),
        F.array(kind).alias("types"), none.alias("projects"), "source", "n_chars",
    )


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files that the index is made of."""
    hadoop, found = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for name in ("documents", "conversations"):
        path = hadoop.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(path)]
    return tuple(sorted(found))


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the notes, with their topics and kept questions; built by the first query that needs it, anew if the tables' files have changed."""
    key = spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir)
    if key not in _indexes or not exists(spark, _indexes[key]):
        _indexes[key] = Scratch(spark, "note-index").path("tables")
        texts = notes(spark, sf_dir).select("path", "title", "body", "flow")
        segments.update(spark, _indexes[key], texts, cluster=F.col("flow"), kept=full_notes(spark, sf_dir).drop("doc_id"))
    return segments.open_index(spark, _indexes[key])


def topic_words(rows: DataFrame) -> DataFrame:
    """(path, topics) from (path, body): the most frequent words of six characters or more, ties by the word."""
    # Dealt by note once, words are counted and ranked without another exchange; a task has a bounded share of the text.
    parts = search.text_parts(rows, "body")
    words = rows.select("path", "body").repartition(parts, "path").select("path", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).where(F.length("word") >= TOPIC_CHARS)
    order = Window.partitionBy("path").orderBy(F.desc("n"), "word")
    top = words.groupBy("path", "word").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= TOPICS)
    return top.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("topics"))


def full_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with topics, and the first question of the conversation of the same number as their kept question."""
    rows = notes(spark, sf_dir)
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array(F.min_by("text", "turn")).alias("q_hooks"))
    none = F.expr("cast(array() as array<string>)")
    return rows.join(topic_words(rows), "path", "left").join(asked, "doc_id", "left").withColumn("topics", F.coalesce("topics", none)).withColumn("q_hooks", F.coalesce("q_hooks", none))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text) of the benchmark's passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, hook): the first question of each conversation."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.min_by("text", "turn").alias("hook"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each conversation as one text with a heading for each turn."""
    turn = F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("part")))), lambda x: x["part"])
    return table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path")).agg(F.concat_ws("", parts).alias("text"))


def qa_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question-answer unit for each user turn that an assistant turn follows."""
    rows = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("next_role", F.lead("role").over(after)).withColumn("answer", F.lead("text").over(after)).where("role = 'user' and next_role = 'assistant'")
    kind = F.when(F.col("turn") % 3 == 0, "high").when(F.col("turn") % 3 == 1, "medium").otherwise("low")
    evidence = F.when(F.col("conv_id") % 2 == 0, F.array(F.struct(F.lit("f").alias("file"), F.lit("#char=0-1").alias("locator"), F.col("text").alias("quote"))))
    return rows.select(
        F.concat_ws("-", F.lit("u"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("qa").alias("type"), kind.alias("confidence"), F.col("text").alias("question"), "answer",
        evidence.alias("evidence"), F.when(F.length("text") > 200, "x").alias("inference"),
    )


def relations(rows: DataFrame) -> DataFrame:
    """(subject, object, doc_id): a note's first two topics stand in a relation."""
    return rows.where("size(topics) >= 2").select(F.col("topics")[0].alias("subject"), F.col("topics")[1].alias("object"), F.col("path").alias("doc_id"), F.lit("relation").alias("type"))


# The same in SQL ---------------------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS_EN + t.STOP_WORDS_RU)


def stem_sql(w: str) -> str:
    return (
        f"CASE WHEN NOT regexp_full_match({w}, '[a-z0-9_]*') THEN {w} WHEN {w} LIKE '%ies' AND length({w}) >= 5 THEN left({w}, -3) || 'y' WHEN {w} LIKE '%ing' AND length({w}) >= 6 THEN left({w}, -3) "
        f"WHEN {w} LIKE '%ed' AND length({w}) >= 5 THEN left({w}, -2) WHEN {w} LIKE '%es' AND length({w}) >= 5 THEN left({w}, -2) WHEN {w} LIKE '%s' AND length({w}) >= 4 THEN left({w}, -1) ELSE {w} END"
    )


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"


NOTE_SQL = """note AS (
  SELECT source || '/' || doc_id AS path, doc_id, split_part(text, '.', 1) AS title, text AS body, lang AS flow, source AS stage, source, n_chars,
    CASE WHEN n_chars < 300 THEN '总览' WHEN n_chars < 1000 THEN '子技巧' WHEN n_chars < 2000 THEN '案例' WHEN n_chars < 4000 THEN '工具' ELSE '坑' END AS substage,
    CASE WHEN n_chars >= 3000 THEN '教程' WHEN n_chars >= 1500 THEN '案例' WHEN n_chars >= 500 THEN '观点' ELSE '素材' END AS type,
    strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS updated, n_chars < 100 AS stale
  FROM documents
)"""
TOKEN_SQL = f"""tok AS (
  SELECT path, {stem_sql("w")} AS gram FROM (SELECT path, unnest(list_concat({words_sql("title")}, {words_sql("body")})) AS w FROM note)
)"""
QUERY_SQL = f"""q_all AS (
  SELECT DISTINCT query_id, {stem_sql("w")} AS gram FROM (SELECT item_id AS query_id, unnest({words_sql("text")}) AS w FROM benchmark)
), q AS (
  SELECT query_id, gram, count(*) OVER (PARTITION BY query_id) AS n_grams FROM q_all a
  WHERE gram NOT IN ({_STOPS}) OR NOT EXISTS (SELECT 1 FROM q_all b WHERE b.query_id = a.query_id AND b.gram NOT IN ({_STOPS}))
)"""
SCORE_SQL = """tf AS (SELECT path, gram, count(*) AS f FROM tok GROUP BY ALL
), len AS (SELECT path, count(*) AS d FROM tok GROUP BY path
), whole AS (SELECT (SELECT count(*) FROM note) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM note) AS mean
), df AS (SELECT gram, count(*) AS c FROM tf GROUP BY gram
), scored AS (
  SELECT query_id, path, n_grams, count(*) AS hits,
    -sum(greatest(ln((n - c + 0.5) / (c + 0.5)), CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN -1e9 ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS bm25
  FROM q JOIN df USING (gram) JOIN tf USING (gram) JOIN len USING (path), whole GROUP BY ALL
)"""
BM25_SQL = f"WITH {NOTE_SQL}, {TOKEN_SQL}, {QUERY_SQL}, {SCORE_SQL}"
TOPIC_SQL = """topic_rank AS (
  SELECT path, word, count(*) AS n, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, word) AS r
  FROM (SELECT path, unnest(regexp_extract_all(lower(body), '[\\p{L}]+')) AS word FROM note) WHERE length(word) >= 6 GROUP BY path, word
), topic AS (SELECT path, word AS topic, r FROM topic_rank WHERE r <= 3)"""
HOOK_SQL = "hooks AS (SELECT CAST(conv_id AS VARCHAR) AS path, arg_min(text, turn) AS hook FROM conversations WHERE role = 'user' GROUP BY conv_id)"
LINE_SQL = """script AS (
  SELECT 'conv/' || conv_id AS path, string_agg('# ' || turn || ' ' || role || chr(10) || text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
), line AS (
  SELECT path, text, n, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM (SELECT path, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM script)
), anchor AS (
  SELECT path, text, start, trim(coalesce(nullif(regexp_extract(line, '^#{1,6}\\s+(.*)$', 1), ''), regexp_extract(line, '^\\[?(\\d{1,2}:\\d{2}(?::\\d{2})?)\\]?\\s*\\S', 1))) AS heading
  FROM line WHERE regexp_matches(line, '^#{1,6}\\s+(.*)$|^\\[?(\\d{1,2}:\\d{2}(?::\\d{2})?)\\]?\\s*\\S')
), cut AS (
  SELECT path, heading, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, start AS char_start, CAST(coalesce(lead(start) OVER w, length(text)) AS INTEGER) AS char_end, text FROM anchor WINDOW w AS (PARTITION BY path ORDER BY start)
), seg AS (
  SELECT *, char_end - char_start AS char_len, substr(text, char_start + 1, char_end - char_start) AS segment FROM cut
), feat AS (
  SELECT *,
    len(regexp_extract_all(segment, '\\d+(?:\\.\\d+)?%?')) >= 3 AS numbers, regexp_matches(segment, 'https?://\\S+') AS link,
    len([p FOR p IN string_split_regex(segment, '\\n\\s*\\n') IF length(regexp_replace(regexp_replace(p, '^\\s+', ''), '\\s+$', '')) >= 80]) > 0 AS narrative
  FROM seg
), chunk AS (
  SELECT *, round(CASE WHEN numbers THEN 0.3 ELSE 0 END + CASE WHEN link THEN 0.1 ELSE 0 END + CASE WHEN narrative THEN 0.2 ELSE 0 END, 2)::DOUBLE AS density,
    concat_ws(',', CASE WHEN numbers THEN 'numbers' END, CASE WHEN link THEN 'link' END, CASE WHEN narrative THEN 'narrative' END) AS features,
    'doc-' || left(md5(path), 8) || '-' || idx AS chunk_id
  FROM feat
), mapped AS (SELECT *, char_len >= 50 AND density >= 0.5 AS high_value FROM chunk)"""
