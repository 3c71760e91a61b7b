"""The library's own queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.functions import text as t
from quillspark.operators import aggregate, chunks, graph, metrics, quality, recall, search, segments, snapshots, tagging
from quillspark.plans import adapter as a
from quillspark.plans.scratch import Scratch
from quillspark.sources import notes as src

FLAGSHIP = "bm25_or_topk"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function as the query of its name, with its SQL."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Retrieval ---------------------------------------------------------------------------------------------------------


_TOP_SQL = (
    a.BM25_SQL
    + """
SELECT query_id, path, CAST(rank AS INTEGER) AS rank, bm25, hits FROM (
  SELECT query_id, path, round(bm25, 6) AS bm25, hits, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), path) AS rank FROM scored WHERE n_grams < 2 OR hits >= 2
) WHERE rank <= 10"""
)


@query(_TOP_SQL)
def bm25_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best notes for each benchmark passage."""
    scored = search.bm25(a.index(spark, sf_dir), a.questions(spark, sf_dir))
    scored = scored.where(search.above_floor()).withColumn("bm25", F.round("bm25", 6))
    return search.best(scored, 10).select("query_id", "path", "rank", "bm25", "hits")


@query(_TOP_SQL)
def bm25_block_bounds_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from those blocks of notes whose bounds reach the tenth score."""
    return segments.top_k(a.index(spark, sf_dir), a.questions(spark, sf_dir), 10)[0]


@query(
    a.BM25_SQL
    + """
SELECT query_id, n_grams, count(*) AS raw, count(*) FILTER (n_grams < 2 OR hits >= 2) AS kept, count(*) FILTER (NOT (n_grams < 2 OR hits >= 2)) AS filtered FROM scored GROUP BY ALL"""
)
def bm25_floor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits of each query the floor keeps and rejects."""
    scored = search.split_by_floor(search.bm25(a.index(spark, sf_dir), a.questions(spark, sf_dir)))
    kept = F.sum(F.col("kept").cast("bigint"))
    return scored.groupBy("query_id", F.col("n_grams").cast("bigint").alias("n_grams")).agg(F.count("*").alias("raw"), kept.alias("kept"), (F.count("*") - kept).alias("filtered"))


@query(f"WITH {a.NOTE_SQL}, {a.TOKEN_SQL} SELECT gram, count(DISTINCT path) AS df, count(*) AS tf FROM tok GROUP BY gram")
def gram_postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of every term of the index."""
    return a.index(spark, sf_dir).terms


_FILTERS = {"domains": ["en", "fr"], "types": ["教程", "案例"]}


@query(
    f"""WITH {a.NOTE_SQL}, scored AS (
  SELECT path, updated, (CASE WHEN flow IN ('en', 'fr') THEN 0.5 ELSE 0 END + CASE WHEN type IN ('教程', '案例') THEN 0.5 ELSE 0 END) / 2 AS tag_score,
    CASE type WHEN '教程' THEN 1.0 WHEN '案例' THEN 0.9 WHEN '观点' THEN 0.6 ELSE 0.5 END AS type_priority
  FROM note WHERE NOT stale AND stage <> 'src3' AND flow IN ('en', 'fr') AND type IN ('教程', '案例')
) SELECT path, CAST(tag_score AS DOUBLE) AS tag_score, CAST(type_priority AS DOUBLE) AS type_priority, updated FROM scored ORDER BY tag_score DESC, type_priority DESC, updated DESC, path LIMIT 50"""
)
def tag_filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that pass a filter, by tag score, type and date: the first fifty."""
    rows = a.notes(spark, sf_dir).withColumn("topics", F.expr("cast(array() as array<string>)"))
    kept = rows.where(search.passes(_FILTERS, ["src3"])).withColumn("tag_score", search.tag_score(_FILTERS)).withColumn("type_priority", search.type_priority())
    return kept.orderBy(*search.rank_order([], False, _FILTERS)).limit(50).select("path", "tag_score", "type_priority", "updated")


_HOOK_MATCH_SQL = f"""WITH {a.HOOK_SQL}, {a.QUERY_SQL}, h_all AS (
  SELECT DISTINCT path, hook, {a.stem_sql("w")} AS gram FROM (SELECT path, hook, unnest({a.words_sql("hook")}) AS w FROM hooks)
), h AS (
  SELECT path, hook, gram, count(*) OVER (PARTITION BY path) AS n_h FROM h_all x
  WHERE gram NOT IN ({a._STOPS}) OR NOT EXISTS (SELECT 1 FROM h_all y WHERE y.path = x.path AND y.gram NOT IN ({a._STOPS}))
), pairs AS (
  SELECT query_id, path, hook, n_grams, n_h, count(*) AS shared FROM q JOIN h USING (gram) GROUP BY ALL
) SELECT query_id, path, shared FROM pairs JOIN benchmark ON item_id = query_id
WHERE shared / n_grams >= 0.5 OR (shared >= 2 AND shared / n_h >= 0.35) OR contains(hook, text) OR contains(text, hook)"""


@query(_HOOK_MATCH_SQL)
def hook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversations' first questions answer to which passages."""
    return search.hook_matches(a.hooks(spark, sf_dir), a.questions(spark, sf_dir)).select("query_id", "path", "shared")


@query(
    f"""WITH RECURSIVE {a.NOTE_SQL}, {a.TOPIC_SQL}, edge AS (
  SELECT DISTINCT x.topic AS src, y.topic AS dst FROM topic x JOIN topic y ON x.path = y.path AND x.r = 1 AND y.r = 2
), both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge
), walk AS (
  SELECT topic AS node, 0 AS hop FROM topic WHERE path = (SELECT min(path) FROM topic)
  UNION SELECT dst, hop + 1 FROM walk JOIN both_ways ON src = node WHERE hop < 3
) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY node"""
)
def relation_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics within three hops of the first note's topics, over relations between notes' first two topics."""
    topics = Scratch(spark, "khop-topics").store(a.topic_words(a.notes(spark, sf_dir)), "topics")
    pairs = a.relations(topics).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    first = topics.agg(F.min("path").alias("path"))
    seeds = topics.join(F.broadcast(first), "path").select(F.explode("topics").alias("node"))
    return graph.reach(pairs, seeds, 3)


_RECALL_SQL = f"""WITH {a.NOTE_SQL}, {a.TOKEN_SQL}, {a.TOPIC_SQL}, {a.QUERY_SQL}, {a.SCORE_SQL},
  note_hook AS (SELECT path, hook FROM note JOIN (SELECT conv_id AS doc_id, arg_min(text, turn) AS hook FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (doc_id)),
  asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
  h_all AS (SELECT DISTINCT path, hook, {a.stem_sql("w")} AS gram FROM (SELECT path, hook, unnest({a.words_sql("hook")}) AS w FROM note_hook)),
  h AS (SELECT path, hook, gram, count(*) OVER (PARTITION BY path) AS n_h FROM h_all x WHERE gram NOT IN ({a._STOPS}) OR NOT EXISTS (SELECT 1 FROM h_all y WHERE y.path = x.path AND y.gram NOT IN ({a._STOPS}))),
  shared AS (SELECT path, hook, n_h, n_grams, count(*) AS n FROM q JOIN h USING (gram) WHERE query_id = (SELECT query_id FROM asked) GROUP BY ALL),
  hooked AS (
    SELECT path FROM shared WHERE n / n_grams >= 0.5 OR (n >= 2 AND n / n_h >= 0.35)
    UNION SELECT path FROM note_hook, asked WHERE contains(hook, text) OR contains(text, hook)
  ),
  fts AS (SELECT path, bm25 FROM scored WHERE query_id = (SELECT query_id FROM asked) AND (n_grams < 2 OR hits >= 2)),
  seeds AS (SELECT DISTINCT topic FROM topic WHERE path IN (SELECT path FROM hooked UNION SELECT path FROM (SELECT path FROM fts ORDER BY bm25, path LIMIT 2))),
  topical AS (SELECT DISTINCT path FROM topic JOIN seeds USING (topic)),
  relation AS (SELECT x.path, x.topic AS s, y.topic AS o FROM topic x JOIN topic y ON x.path = y.path AND x.r = 1 AND y.r = 2),
  concept AS (SELECT topic AS c FROM seeds UNION SELECT text FROM asked),
  related AS (SELECT DISTINCT path FROM relation WHERE EXISTS (SELECT 1 FROM concept WHERE contains(s, c) OR contains(c, s) OR contains(o, c) OR contains(c, o))),
  hit AS (
    SELECT path, 'fts' AS channel, 3 AS w, bm25 FROM fts UNION ALL SELECT path, 'hook', 4, NULL FROM hooked
    UNION ALL SELECT path, 'topic', 2, NULL FROM topical UNION ALL SELECT path, 'relation', 1, NULL FROM related
  ),
  merged AS (SELECT path, string_agg(channel, ',' ORDER BY channel) AS channels, max(w) AS weight, min(bm25) AS bm25 FROM hit GROUP BY path)
SELECT path, channels, CAST(weight AS INTEGER) AS weight, round(bm25, 6) AS bm25 FROM merged JOIN note USING (path) WHERE NOT stale
ORDER BY weight DESC, coalesce(merged.bm25, 0.0), updated DESC, path LIMIT 100"""


@query(_RECALL_SQL)
def recall_four_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall for the first passage over text, questions, topics and relations: the first hundred notes."""
    text = a.questions(spark, sf_dir).orderBy("query_id").first()["text"]
    index = a.index(spark, sf_dir)
    route = recall.Route(keywords=[text], need_relations=True, top_k=100)
    found = recall.recall(index.notes, text, route, a.relations(index.notes), index=index)
    return found.select("path", F.concat_ws(",", "channels").alias("channels"), "weight", F.round("bm25", 6).alias("bm25"))


@query(
    a.BM25_SQL
    + """, ranked AS (
  SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), path) AS rank FROM scored WHERE n_grams < 2 OR hits >= 2
), relevant AS (
  SELECT item_id AS query_id, path FROM benchmark JOIN note ON contains(body, text)
), top AS (SELECT ranked.*, relevant.path IS NOT NULL AS hit FROM ranked LEFT JOIN relevant USING (query_id, path) WHERE rank <= 10
), per AS (SELECT query_id, count(*) AS returned, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM top GROUP BY query_id
), want AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id
), ideal AS (SELECT query_id, n, list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 10) + 1)]) AS idcg FROM want)
SELECT query_id, CAST(coalesce(returned, 0) AS BIGINT) AS returned, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(coalesce(hits, 0) / 10, 4) AS precision, round(coalesce(hits, 0) / n, 4) AS recall,
  round(coalesce(1 / first, 0), 4) AS mrr, round(coalesce(dcg, 0) / idcg, 4) AS ndcg
FROM ideal LEFT JOIN per USING (query_id)"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, reciprocal rank and gain of ten hits, where notes that hold the passage are relevant."""
    rows, asked = a.notes(spark, sf_dir).select("path", "title", "body"), a.questions(spark, sf_dir)
    # A note that holds a passage has all of its terms.
    ranked, full = segments.scanned(a.index(spark, sf_dir), asked, 10)
    relevant = full.join(asked, "query_id").join(rows, "path").where(F.col("body").contains(F.col("text"))).select("query_id", "path")
    out = metrics.retrieval(ranked, relevant, 10)
    return out.withColumn("returned", F.col("returned").cast("bigint")).withColumn("hits", F.col("hits").cast("bigint"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))
SELECT vec_id, round(list_sum([p[1] * p[2] FOR p IN list_zip(e, qe)]) / sqrt(list_sum([x * x FOR x IN e])) / sqrt(list_sum([x * x FOR x IN qe])), 6) AS cosine
FROM v, q ORDER BY cosine DESC, vec_id LIMIT 20"""
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors most like the first one, by cosine."""
    rows = a.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = F.array(*[F.lit(float(x)) for x in rows.orderBy("vec_id").first()["e"]])

    def dot(x: F.Column, y: F.Column) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)

    cosine = F.round(dot(F.col("e"), asked) / F.sqrt(dot(F.col("e"), F.col("e"))) / F.sqrt(dot(asked, asked)), 6)
    return rows.select("vec_id", cosine.alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(20)


@query(
    a.BM25_SQL
    + """, text_rank AS (
  SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), path) AS r FROM scored
), hit_rank AS (
  SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, path) AS r FROM scored
), fused AS (
  SELECT query_id, path, round(sum(1.0 / (60 + r)), 8) AS rrf FROM (SELECT * FROM text_rank UNION ALL SELECT * FROM hit_rank) GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, path) AS rank FROM fused)
SELECT query_id, path, CAST(rrf AS DOUBLE) AS rrf, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each query's hits, by score and by terms hit, fused by reciprocal ranks."""
    scored = search.bm25(a.index(spark, sf_dir), a.questions(spark, sf_dir))
    by = lambda *keys: F.row_number().over(Window.partitionBy("query_id").orderBy(*keys))
    ranks = scored.select("query_id", "path", by(F.round("bm25", 6), "path").alias("r1"), by(F.desc("hits"), "path").alias("r2"))
    fused = ranks.withColumn("rrf", F.round(1.0 / (60 + F.col("r1")) + 1.0 / (60 + F.col("r2")), 8))
    return search.best(fused, 5, (F.desc("rrf"), "path")).select("query_id", "path", "rrf", "rank")


# Notes, topics, places ---------------------------------------------------------------------------------------------


@query(f"WITH {a.NOTE_SQL}, {a.TOPIC_SQL} SELECT topic, count(DISTINCT path) AS doc_count, count(DISTINCT path) >= 2 AS shared, count(DISTINCT path) >= 3 AS merge_candidate FROM topic GROUP BY topic")
def topic_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by topic, and which topics are shared or worth merging."""
    return aggregate.topic_counts(a.topic_words(a.notes(spark, sf_dir)))


@query(
    f"""WITH {a.NOTE_SQL}, place AS (SELECT DISTINCT flow, stage FROM note), sub AS (SELECT unnest(['总览', '子技巧', '案例', '工具', '坑']) AS substage)
SELECT flow, stage, TRY_CAST(regexp_extract(stage, '^(\\d+)', 1) AS INTEGER) AS stage_order, substage, count(path) AS n
FROM place CROSS JOIN sub LEFT JOIN note USING (flow, stage, substage) GROUP BY ALL"""
)
def flow_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by flow, stage and substage; empty substages are told."""
    return aggregate.flow_overview(a.notes(spark, sf_dir))


@query(
    f"""WITH {a.NOTE_SQL}, {a.TOKEN_SQL} SELECT gram, count(DISTINCT path) AS df, round(count(DISTINCT path) / (SELECT count(*) FROM note), 4) AS share,
  count(DISTINCT path) / (SELECT count(*) FROM note) >= 0.5 AS generic FROM tok GROUP BY gram"""
)
def generic_bigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms half of all notes have."""
    index = a.index(spark, sf_dir)
    return aggregate.generic(index.terms.select("gram", "df"), index.lengths)


@query(
    """WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'),
    '(?is)<head\\b.*?</head\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages
), plain AS (
  SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
    '\\s+', ' ', 'g')) AS text FROM bare
) SELECT page_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM plain"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, as length and digest."""
    text = src.html_text(F.col("html"))
    return a.table(spark, sf_dir, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH {a.LINE_SQL} SELECT path, chunk_id, idx, heading, char_start, char_end, density, features, high_value, CASE WHEN NOT high_value THEN CASE WHEN char_len < 50 THEN '过短/目录' ELSE '低密度' END END AS skip_reason FROM mapped")
def doc_map_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all transcripts with features, density and verdict."""
    mapped = chunks.map_documents(a.transcripts(spark, sf_dir))
    return mapped.select("path", "chunk_id", "idx", "heading", "char_start", "char_end", F.col("density").cast("double").alias("density"), F.concat_ws(",", "features").alias("features"), "high_value", "skip_reason")


@query(f"WITH {a.LINE_SQL} SELECT path, count(*) AS chunks_total, CAST(count(*) FILTER (high_value) AS BIGINT) AS high_value, CAST(count(*) FILTER (NOT high_value) AS BIGINT) AS low_value FROM mapped GROUP BY path")
def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of each transcript are of high value."""
    return chunks.coverage(chunks.map_documents(a.transcripts(spark, sf_dir)))


@query(f"WITH {a.LINE_SQL} SELECT chunk_id FROM mapped WHERE (char_len >= 50 AND density >= 0.2) AND NOT contains(heading, 'assistant')")
def high_value_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense chunks that no unit touches, where assistants' turns are the units."""
    mapped = chunks.map_documents(a.transcripts(spark, sf_dir)).withColumn("high_value", (F.col("char_len") >= 50) & (F.col("density") >= 0.2))
    touched = mapped.where(F.col("heading").contains("assistant"))
    return quality.uncovered(mapped, touched, touched.where("false")).select("chunk_id")


@query(
    f"""WITH {a.LINE_SQL}, hv AS (SELECT *, char_len >= 50 AND density >= 0.2 AS hv FROM mapped)
SELECT path, CAST(count(*) FILTER (hv) AS BIGINT) AS high, CAST(count(*) FILTER (hv AND contains(heading, 'assistant')) AS BIGINT) AS done,
  CASE WHEN count(*) FILTER (hv) = 0 THEN 'no_hv' WHEN count(*) FILTER (hv AND contains(heading, 'assistant')) = 0 THEN 'todo'
       WHEN count(*) FILTER (hv AND contains(heading, 'assistant')) < count(*) FILTER (hv) THEN 'partial' ELSE 'done' END AS status
FROM hv GROUP BY path"""
)
def progress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each transcript is worked up, where notes name the assistants' turns."""
    mapped = chunks.map_documents(a.transcripts(spark, sf_dir)).withColumn("high_value", (F.col("char_len") >= 50) & (F.col("density") >= 0.2))
    places = mapped.where(F.col("heading").contains("assistant")).select(F.concat_ws("#", "path", "idx").alias("note"), "path", (F.col("char_start") + 1).alias("start"))
    return quality.progress(mapped, places)[0]


@query(
    """WITH d AS (SELECT source || '/' || doc_id AS path, text, split_part(text, '.', 1) AS quote FROM documents)
SELECT path, CASE WHEN quote = '' THEN 'missing' WHEN len(string_split(text, quote)) - 1 = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict,
  CASE WHEN quote <> '' THEN CAST(strpos(text, quote) - 1 AS INTEGER) END AS start, CASE WHEN quote <> '' THEN CAST(strpos(text, quote) - 1 + length(quote) AS INTEGER) END AS "end" FROM d"""
)
def quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's first sentence stands in it."""
    rows = a.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    quotes = rows.select("path", F.substring_index("text", ".", 1).alias("quote"))
    return chunks.locate(quotes, rows).select("path", "verdict", "start", "end")


_NUMBERS = """[x FOR x IN list_sort(list_distinct(regexp_extract_all(regexp_replace({0}, '[,.%–—-]*[0-9]*[A-Za-z][0-9A-Za-z]*', ' ', 'g'), '[0-9][0-9,.]*(?:[-–—][0-9][0-9.]*)?%?')))]"""


@query(
    f"""WITH d AS (SELECT doc_id, {_NUMBERS.format("split_part(text, chr(10), 1)")} AS a, {_NUMBERS.format("substr(text, length(split_part(text, chr(10), 1)) + 1)")} AS b FROM documents)
SELECT doc_id, array_to_string([x FOR x IN a IF NOT list_contains(b, x)], ' ') AS extra, array_to_string([x FOR x IN b IF NOT list_contains(a, x)], ' ') AS missing FROM d"""
)
def number_tokens_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a document's first line has and its rest has not, and the other way round."""
    first, rest = F.substring_index("text", "\n", 1), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")
    extra, missing = quality.numbers_compared(first, rest)
    return a.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", extra).alias("extra"), F.concat_ws(" ", missing).alias("missing"))


@query(
    f"""SELECT page_id, CAST(len(regexp_extract_all(html, '{t.SIGNED_URL}')) AS INTEGER) AS signed, CAST(len(regexp_extract_all(html, '{t.MISSING_ASSET}')) AS INTEGER) AS missing,
  CAST(len(regexp_extract_all(html, 'https?://[^\\s"<]+')) AS INTEGER) AS links FROM pages"""
)
def dead_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed urls and placeholders of missing assets in pages."""
    found = t.dead_assets(F.col("html"))
    links = F.size(F.regexp_extract_all("html", F.lit(r'https?://[^\s"<]+'), F.lit(0)))
    return a.table(spark, sf_dir, "pages").select("page_id", found["signed"].alias("signed"), found["missing"].alias("missing"), links.alias("links"))


# Tags and measures -------------------------------------------------------------------------------------------------


def _tagger_sql() -> str:
    def hits(dimension: str) -> str:
        cases = []
        for canon, words in tagging.SAMPLE.variants(dimension).items():
            cases.append("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{canon}' END")
        return f"[x FOR x IN [{', '.join(cases)}] IF x IS NOT NULL]"

    def implied(dimension: str) -> str:
        parts = [f"CASE WHEN list_contains(projects, '{p}') THEN [{', '.join(repr(v) for v in i[dimension])}] ELSE [] END" for p, i in tagging.SAMPLE.implies.items() if dimension in i]
        return f"list_distinct(flatten([{dimension}, {', '.join(parts)}]))"

    domain, used = tagging.SAMPLE.tools_of
    tools = ", ".join(f"'{x}'" for x in used)
    columns = ", ".join(f"{hits(d)} AS {d}" for d in tagging.TAGGED)
    return f"""WITH raw AS (SELECT page_id, url AS path, lower(url) AS low FROM pages), hit AS (SELECT page_id, path, {columns}, {hits("sources")} AS sources FROM raw),
more AS (SELECT page_id, path, types, projects, sources, {implied("domains")} AS domains, {implied("forms")} AS forms, {implied("tools")} AS tools FROM hit),
full_tags AS (SELECT page_id, path, types, projects, sources, forms, tools, CASE WHEN list_has_any(tools, [{tools}]) THEN list_distinct(list_append(domains, '{domain}')) ELSE domains END AS domains FROM more),
scored AS (SELECT *, CASE WHEN len(domains) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len(types) > 0 THEN 0.3 ELSE 0 END + CASE WHEN len(tools) > 0 THEN 0.15 ELSE 0 END
  + CASE WHEN len(forms) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(projects) > 0 THEN 0.15 ELSE 0 END AS s FROM full_tags),
sure AS (SELECT *, CAST(least(round(CASE WHEN len(domains) > 0 AND len(types) > 0 THEN s ELSE least(s, 0.5) END, 3), 0.95) AS DOUBLE) AS confidence FROM scored)
SELECT page_id, array_to_string(list_sort(domains), ',') AS domains, array_to_string(list_sort(forms), ',') AS forms, array_to_string(list_sort(tools), ',') AS tools, array_to_string(list_sort(types), ',') AS types,
  array_to_string(list_sort(projects), ',') AS projects, CASE WHEN list_contains(sources, 'scan') THEN 'scan' WHEN list_contains(sources, 'web') THEN 'web' END AS source_kind,
  confidence, confidence < 0.6 AS needs_review FROM sure"""


@query(_tagger_sql())
def rule_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every page by its url."""
    rows = a.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    tags = tagging.tag_paths(rows.select("path").distinct())
    return rows.join(tags, "path").select("page_id", *[F.concat_ws(",", d).alias(d) for d in tagging.TAGGED], "source_kind", "confidence", "needs_review")


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold labels and what a rule says of the texts, as (path, dimension, labels)."""
    rows = a.table(spark, sf_dir, "labels").join(a.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    one = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(F.expr("cast(array() as array<string>)"))
    path = F.col("doc_id").cast("string").alias("path")
    both = lambda q, x: F.explode(F.array(F.struct(F.lit("quality").alias("dimension"), q.alias("labels")), F.struct(F.lit("toxic").alias("dimension"), x.alias("labels")))).alias("x")
    gold = rows.select(path, both(one(F.col("quality") == 1, "good"), one(F.col("toxic") == 1, "toxic"))).select("path", "x.*")
    said = rows.select(path, both(one(F.col("n_chars") >= 500, "good"), one(F.lower("text").contains("idiot") | F.lower("text").contains("moron"), "toxic"))).select("path", "x.*")
    return gold, said


_LABEL_SQL = """WITH l AS (SELECT doc_id, quality, toxic, n_chars >= 500 AS p_quality, contains(lower(text), 'idiot') OR contains(lower(text), 'moron') AS p_toxic FROM labels JOIN documents USING (doc_id)
), c AS (SELECT 'quality' AS dimension, quality = 1 AS g, p_quality AS p FROM l UNION ALL SELECT 'toxic', toxic = 1, p_toxic FROM l)"""


@query(
    _LABEL_SQL
    + """, n AS (SELECT dimension, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (g) AS gold FROM c GROUP BY dimension
), m AS (SELECT * FROM n UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn), sum(gold) FROM n
), s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM m)
SELECT dimension, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(gold AS BIGINT) AS gold, round(CAST(pr AS DOUBLE), 4) AS precision, round(CAST(re AS DOUBLE), 4) AS recall,
  round(CAST(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS DOUBLE), 4) AS f1 FROM s"""
)
def classify_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a rule against the labels, by dimension and over all."""
    return metrics.classification(*_predictions(spark, sf_dir))


@query(_LABEL_SQL + " SELECT CAST(quality AS VARCHAR) AS gold, CASE WHEN p_quality THEN '1' ELSE '0' END AS predicted, count(*) AS n FROM l GROUP BY ALL")
def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a rule's."""
    rows = a.table(spark, sf_dir, "labels").join(a.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    path = F.col("doc_id").alias("path")
    return metrics.confusion(rows.select(path, F.col("quality").cast("string").alias("label")), rows.select(path, F.when(F.col("n_chars") >= 500, "1").otherwise("0").alias("label")))


# Graphs ------------------------------------------------------------------------------------------------------------


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as nodes, and an edge from each copy of a text to its first document and to the one of the next id."""
    rows = a.table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.squash(F.col("text")), 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("dst"))
    edges = rows.join(first, "h").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst")
    return rows.select(F.col("doc_id").alias("node")), edges


@query("SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY sha256(regexp_replace(text, '\\s+', '', 'g'))) AS component FROM documents")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first one of equal text, white space aside."""
    nodes, edges = _copies(spark, sf_dir)
    return graph.components_of(edges, nodes)


@query(
    """WITH g AS (SELECT doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY sha256(regexp_replace(text, '\\s+', '', 'g'))))
SELECT CASE WHEN doc_id = first THEN n - 1 ELSE 1 END AS degree, count(*) AS nodes FROM g GROUP BY 1"""
)
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have how many copies linked to them."""
    nodes, edges = _copies(spark, sf_dir)
    return graph.degree_histogram(edges, nodes)


@query("WITH k AS (SELECT doc_id, doc_id + 7 AS target FROM documents) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(target AS VARCHAR) AS target FROM k WHERE target NOT IN (SELECT doc_id FROM documents)")
def wikilink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to notes that are not there, where every note links to one seven ids further."""
    link = F.concat(F.lit("see [["), (F.col("doc_id") + 7).cast("string"), F.lit("|it]] and `[[0]]`"))
    return quality.broken_links(a.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), link.alias("body")))


# Files, snapshots, rules -------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, before and after some were dropped, edited, added and moved."""
    rows = a.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    kept = rows.where("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = rows.where("doc_id % 11 = 0").select("doc_id", F.concat(F.lit("new/"), "path").alias("path"), "text")
    return aggregate.snapshot(rows), aggregate.snapshot(kept.union(added))


_CHANGE_SQL = """change AS (
  SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 17 = 0 OR doc_id % 13 = 0
  UNION ALL SELECT 'new/' || source || '/' || doc_id, 'added' FROM documents WHERE doc_id % 11 = 0
)"""


@query(f"WITH {_CHANGE_SQL} SELECT path, change FROM change")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots of the documents."""
    return aggregate.diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_CHANGE_SQL} SELECT path, change FROM change")
def snapshot_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by trees of folder digests: only folders that differ are looked into."""
    return snapshots.diff(*_snapshots(spark, sf_dir))


@query(
    """WITH file AS (SELECT source, octet_length(encode(text)) AS size FROM documents), folder AS (SELECT source AS folder, size FROM file UNION ALL SELECT '', size FROM file)
SELECT folder, CASE WHEN folder <> '' THEN '' END AS parent, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size FROM folder GROUP BY folder"""
)
def snapshot_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes below every folder of the documents."""
    return snapshots.tree(_snapshots(spark, sf_dir)[0]).select("folder", "parent", "n_files", "size")


_KINDS = {"en": "text", "de": "text", "fr": "sound", "es": "film"}


@query(
    f"""WITH {_CHANGE_SQL}, before AS (SELECT lang FROM documents), after AS (SELECT lang FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT lang FROM documents WHERE doc_id % 11 = 0 AND doc_id % 17 <> 0),
  kind AS (SELECT * FROM (VALUES ('en', 'text'), ('de', 'text'), ('fr', 'sound'), ('es', 'film')) AS v(lang, kind)),
  media AS (SELECT kind, sum(was) AS was, sum(now) AS now FROM (SELECT kind, 1 AS was, 0 AS now FROM before JOIN kind USING (lang) UNION ALL SELECT kind, 0, 1 FROM after JOIN kind USING (lang)) GROUP BY kind)
SELECT CASE change WHEN 'added' THEN 'added_pardoned' ELSE 'source_' || change END AS code, CASE change WHEN 'added' THEN 'info' ELSE 'fail' END AS status, count(*) AS n FROM change GROUP BY change
UNION ALL SELECT 'media_changed:' || kind, 'warn', CAST(now - was AS BIGINT) FROM media WHERE now <> was UNION ALL SELECT 'list_changed', 'warn', 1"""
)
def source_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents' folder shows against its baseline, which knew one extension less; languages are the media's extensions."""
    rows = a.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", F.col("doc_id").cast("string"), "lang").alias("path"))
    kept = rows.where("doc_id % 17 <> 0")
    after = kept.union(kept.where("doc_id % 11 = 0").withColumn("path", F.concat(F.lit("new/"), "path")))
    media = [snapshots.media_counts(x, _KINDS) for x in (rows, after)]
    return snapshots.verdict(snapshots.diff(*_snapshots(spark, sf_dir)), *media, ["md"], ["md", "html"])


@query(f"WITH {_CHANGE_SQL} SELECT 'note/' || doc_id AS path, source || '/' || doc_id AS source FROM documents WHERE source || '/' || doc_id IN (SELECT path FROM change WHERE change <> 'added')")
def stale_workorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose source changed or went."""
    rows = a.table(spark, sf_dir, "documents").select(F.concat(F.lit("note/"), F.col("doc_id").cast("string")).alias("path"), F.array(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("sources"))
    return aggregate.stale_notes(aggregate.diff(*_snapshots(spark, sf_dir)), rows)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    rows = a.table(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id"))
    return aggregate.upsert(rows, "user_id", "order").select("user_id", "event_id", "event_type")


_FILE_SQL = """f AS (
  SELECT doc_id, 'd/' || (doc_id // 3) || CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.srt' WHEN 4 THEN '·精华笔记.md' ELSE '.PDF' END AS path, octet_length(encode(text)) AS size FROM documents
)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 6 == 0, ".pdf").when(F.col("doc_id") % 6 == 1, ".md").when(F.col("doc_id") % 6 == 2, ".txt").when(F.col("doc_id") % 6 == 3, ".srt").when(F.col("doc_id") % 6 == 4, "·精华笔记.md").otherwise(".PDF")
    return a.table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.floor(F.col("doc_id") / 3).cast("string"), end).alias("path"), F.octet_length("text").cast("bigint").alias("size"))


@query(
    f"""WITH {_FILE_SQL}, b AS (SELECT path, regexp_replace(path, '\\.[A-Za-z0-9]+$', '') AS base, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM f)
SELECT 'orphan_pdf' AS kind, path, CAST(NULL AS VARCHAR) AS partner FROM b WHERE ext = 'pdf' AND base || '.md' NOT IN (SELECT path FROM f)
UNION ALL SELECT 'orphan_srt', path, NULL FROM b WHERE ext = 'srt' AND base || '.txt' NOT IN (SELECT path FROM f)
UNION ALL SELECT 'minutes', b.path, f.path FROM b LEFT JOIN f ON f.path = base || '·精华笔记.md' WHERE ext = 'txt'"""
)
def orphan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without the partner that their kind should have."""
    return aggregate.file_pairs(_files(spark, sf_dir))


@query(
    f"""WITH {_FILE_SQL}, e AS (SELECT path, size, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM f)
SELECT ext AS class, ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY ALL"""
)
def ext_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by class and extension."""
    return aggregate.inventory(_files(spark, sf_dir))


@query(
    f"""WITH {_FILE_SQL} SELECT path, CAST(size AS BIGINT) AS size FROM f WHERE size >= 200
  AND NOT (path LIKE '%·精华笔记.md' AND left(path, length(path) - length('·精华笔记.md')) || '.md' IN (SELECT path FROM f))"""
)
def body_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are body documents."""
    return tagging.body_documents(_files(spark, sf_dir)).select("path", "size")


@query(
    """WITH h AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'
), whole AS (SELECT conv_id, count(*) AS n FROM h GROUP BY conv_id
), item AS (SELECT conv_id, i, text AS hook, regexp_matches(text, '^[\\[{]') OR (contains(text, 'text') AND contains(text, ':')) AS shaped, trim(text) = '' AS blank, regexp_matches(text, '[,，]') AS comma, length(trim(text)) AS len FROM h
), clean AS (SELECT * FROM item WHERE NOT shaped AND NOT blank AND NOT comma
), key AS (SELECT conv_id, i, regexp_replace(lower(hook), '[\\s\\p{P}\\p{S}]+', '', 'g') AS k FROM clean
), found AS (
  SELECT conv_id, 'too_few' AS code FROM whole WHERE n < 3 UNION ALL SELECT conv_id, 'too_many' FROM whole WHERE n > 5
  UNION ALL SELECT conv_id, 'not_string' FROM item WHERE shaped UNION ALL SELECT conv_id, 'empty_item' FROM item WHERE NOT shaped AND blank UNION ALL SELECT conv_id, 'comma_in_item' FROM item WHERE NOT shaped AND NOT blank AND comma
  UNION ALL SELECT conv_id, 'too_short' FROM clean WHERE len < 6 UNION ALL SELECT conv_id, 'too_long' FROM clean WHERE len > 40 UNION ALL SELECT conv_id, 'newline' FROM clean WHERE regexp_matches(hook, '[\\r\\n]|\\\\n|\\\\r')
  UNION ALL SELECT conv_id, 'dup' FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, k ORDER BY i) AS r FROM key WHERE k <> '') WHERE r > 1
) SELECT conv_id AS subject, code, 'invalid' AS status, count(*) AS n FROM found GROUP BY ALL"""
)
def hook_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with conversations' questions as kept questions of a note."""
    rows = a.table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("q_hooks"))
    return quality.hook_rules(rows)


@query(
    """WITH u AS (SELECT conv_id, turn, text, role, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), k AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM u WHERE role = 'user' AND nr = 'assistant'
), f AS (
  SELECT 'missing_field' AS code, 'error' AS status FROM k WHERE trim(text) = '' OR trim(answer) = ''
  UNION ALL SELECT 'high_without_evidence', 'error' FROM k WHERE confidence = 'high' AND conv_id % 2 <> 0 AND trim(text) <> '' AND trim(answer) <> ''
  UNION ALL SELECT 'low_confidence', 'info' FROM k WHERE confidence = 'low' AND trim(text) <> '' AND trim(answer) <> ''
  UNION ALL SELECT 'high_with_inference', 'warning' FROM k WHERE confidence = 'high' AND length(text) > 200 AND trim(text) <> '' AND trim(answer) <> ''
) SELECT code, status, count(*) AS n FROM f GROUP BY ALL"""
)
def unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on question-answer units, by code."""
    return quality.unit_rules(a.qa_units(spark, sf_dir)).groupBy("code", "status").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT source || '/' || doc_id AS locator, regexp_replace(text, '[\\s`]+', '', 'g') AS bare FROM documents)
SELECT sha256(bare) AS fingerprint, count(*) AS n, min(locator) AS first_locator FROM d WHERE bare <> '' GROUP BY bare HAVING count(*) >= 2"""
)
def asset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand in several places."""
    return aggregate.duplicate_assets(a.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("locator"), "text"))


@query(
    f"""WITH {a.NOTE_SQL}, {a.TOPIC_SQL}, busiest AS (SELECT topic FROM topic GROUP BY topic ORDER BY count(DISTINCT path) DESC, topic LIMIT 10),
row_tier AS (SELECT path, CASE WHEN source = 'src1' THEN 1 WHEN EXISTS (SELECT 1 FROM topic t WHERE t.path = note.path AND t.topic IN (SELECT topic FROM busiest ORDER BY topic LIMIT 1)) THEN 2
    WHEN EXISTS (SELECT 1 FROM topic t WHERE t.path = note.path AND t.topic IN (SELECT topic FROM busiest)) THEN 3 END AS tier,
    (SELECT count(*) FROM topic t WHERE t.path = note.path AND t.topic IN (SELECT topic FROM busiest ORDER BY topic LIMIT 1)) AS overlap FROM note)
SELECT path, CAST(tier AS INTEGER) AS tier, CAST(overlap AS INTEGER) AS overlap FROM row_tier WHERE tier IS NOT NULL ORDER BY tier, overlap DESC, path LIMIT 200"""
)
def citable_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two hundred notes worth citing beside those of one source."""
    rows = a.notes(spark, sf_dir).select("path", "body", "source")
    rows = rows.join(a.topic_words(rows), "path", "left").withColumn("topics", F.coalesce("topics", F.expr("cast(array() as array<string>)")))
    seed = aggregate.topic_counts(rows).orderBy(F.desc("doc_count"), "topic").limit(10).orderBy("topic").first()
    return aggregate.citable(rows, "src1", [seed["topic"]] if seed else [])
