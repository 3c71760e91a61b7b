"""Full-text retrieval: an inverted index, BM25 with column weights, a floor for weak hits, filters and rank cascades.

An index is a folder of tables, built once: texts are tokenised in one scan, and queries read postings only.
Statistics (number of notes, mean length, document frequencies) are of the whole index; filters apply to candidates.
Only postings of the queries' terms are shuffled. Queries are tables, so many are answered in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillspark.functions import text as t
from quillspark.operators.similar import sharing
from quillspark.operators.skew import salted
from quillspark.plans.scratch import Scratch

# Weights and constants of the score.
COLUMN_WEIGHTS = {"title": 1.0, "body": 1.0, "dimtext": 0.6, "qhooks": 3.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
LEAST_GRAMS = 2
OF_QUERY, OF_HOOK = 0.5, 0.35  # shares of terms
HELD_RUN = 8
PUSHED = 200
PART_BYTES = 8 << 20  # of text that one task takes apart
POSTING = "gram string, path string, length bigint, tf bigint, weighted double"
TAG_DIMENSIONS = ("domains", "forms", "tools", "types", "projects", "topics")
RANK_KEYS = ("相关度", "时间", "类型优先级")


class QueryError(ValueError):
    """A request that cannot be answered: it says what is allowed."""


def text_parts(rows: DataFrame, *columns: str) -> int:
    """In how many parts texts are dealt, so that each has about ``PART_BYTES`` of them, however much a file's compression hides."""
    size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in columns), F.lit(0).cast("bigint")))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def terms(notes: DataFrame) -> DataFrame:
    """(path, length, terms): by note the number of indexed terms of all columns, and an array of (gram, weight)."""
    columns = [c for c in COLUMN_WEIGHTS if c in notes.columns]
    arrays = notes.select("path", *[t.index_grams(F.col(c)).alias(c) for c in columns])
    weighted = [_weighted(c, COLUMN_WEIGHTS[c]) for c in columns]
    length = sum((F.size(c) for c in columns), F.lit(0))
    return arrays.select("path", length.cast("bigint").alias("length"), F.concat(*weighted).alias("terms"))


def _weighted(column: str, weight: float) -> Column:
    return F.transform(column, lambda g: F.struct(g.alias("gram"), F.lit(weight).alias("weight")))


def postings(indexed: DataFrame) -> DataFrame:
    """(gram, path, tf, weighted) from ``terms``: how often a note has a term, plain and by column weight."""
    rows = indexed.select("path", F.explode("terms").alias("x")).select("path", "x.gram", "x.weight")
    return rows.groupBy("gram", "path").agg(F.count("*").alias("tf"), F.sum("weight").alias("weighted"))


@dataclass(frozen=True)
class Index:
    """The tables of an index: postings (gram, path, length, tf, weighted), lengths (path, length), terms (gram, df, tf).

    One of ``segments`` also has its postings in blocks, void notes, the notes themselves, how many there are with their mean length, and the terms of each.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    blocks: DataFrame | None = None
    dead: DataFrame | None = None
    notes: DataFrame | None = None
    whole: tuple[int, float] | None = None
    forward: DataFrame | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """The postings of some terms (gram). A few are read by the files' own statistics; more meet the postings in a join."""
        few = [r[0] for r in wanted.select("gram").distinct().limit(PUSHED + 1).collect()]
        return self.postings.where(F.col("gram").isin(few)) if len(few) <= PUSHED else self.postings


def build_index(notes: DataFrame, folder: str) -> Index:
    """Write the tables of notes (path and columns of ``COLUMN_WEIGHTS``); each text is tokenised once.

    The index is cut by notes: texts are dealt by path, and each file holds the postings of its notes in order of terms.
    So no term, however common, is the work of one task, and a term's postings are a few pages of each file.
    """
    spark = notes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, notes.rdd.getNumPartitions())
    columns = [c for c in COLUMN_WEIGHTS if c in notes.columns]
    arrays = notes.select("path", *columns).repartition(parts, "path").select("path", *[t.index_grams(F.col(c)).alias(c) for c in columns])
    length = sum((F.size(c) for c in columns), F.lit(0)).cast("bigint").alias("length")
    weighted = F.concat(*[_weighted(c, COLUMN_WEIGHTS[c]) for c in columns])
    rows = arrays.select("path", length, F.explode_outer(weighted).alias("x")).select("path", "length", "x.gram", "x.weight")
    counted = rows.groupBy("path", "length", "gram").agg(F.count("gram").alias("tf"), F.sum("weight").alias("weighted"))
    counted.select("gram", "path", "length", "tf", "weighted").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/posting")
    found = spark.read.schema(POSTING).parquet(f"{folder}/posting")
    found.groupBy("path").agg(F.max("length").alias("length")).write.mode("overwrite").parquet(f"{folder}/doc_len")
    found.where("gram is not null").groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).write.mode("overwrite").parquet(f"{folder}/term")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """An index that ``build_index`` or ``write_index`` has written."""
    found = spark.read.schema(POSTING).parquet(f"{folder}/posting").where("gram is not null")
    return Index(found, spark.read.schema("path string, length bigint").parquet(f"{folder}/doc_len"), spark.read.schema("gram string, df bigint, tf bigint").parquet(f"{folder}/term"))


def indexed(notes: DataFrame | Index) -> Index:
    """The index itself, or a new one of notes in the session's shared folder."""
    return notes if isinstance(notes, Index) else build_index(notes, Scratch(notes.sparkSession, "index").path("tables"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, gram) of queries (query_id, text), and the number of distinct terms of each."""
    grams = queries.select("query_id", t.query_grams(F.col("text")).alias("grams"))
    return grams.select("query_id", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))


def bm25(notes: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """(query_id, path, bm25, hits, n_grams) of every note that has a term of the query; smaller scores are better.

    ``notes`` is an index, or notes of which one is built first.
    """
    index = indexed(notes)
    wanted = query_terms(queries)
    whole = index.lengths.agg(F.count("*").alias("notes"), F.avg("length").alias("mean"))
    if index.whole:
        whole = notes_of_session(queries, index.whole)
    idf = F.ln((F.col("notes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(index.terms.select("gram", "df"), "gram").join(F.broadcast(whole)).select("query_id", "n_grams", "gram", "mean", F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)).alias("idf"))
    parts = weights.join(index.of(wanted).select("gram", "path", "length", "weighted"), "gram")
    gain = F.col("weighted") * (K1 + 1) / (F.col("weighted") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return parts.groupBy("query_id", "path").agg((-F.sum(F.col("idf") * gain)).alias("bm25"), F.count("*").alias("hits"), F.first("n_grams").alias("n_grams"))


def notes_of_session(queries: DataFrame, whole: tuple[int, float]) -> DataFrame:
    """The number of notes and their mean length, where the index knows them, as one row."""
    return queries.sparkSession.createDataFrame([whole], "notes bigint, mean double")


def above_floor(least: int = LEAST_GRAMS) -> Column:
    """Whether a hit has enough of the query's distinct terms; a query of one term has no floor."""
    return (F.col("n_grams") < 2) | (F.col("hits") >= least) if least > 1 else F.lit(True)


def split_by_floor(scored: DataFrame, least: int = LEAST_GRAMS) -> DataFrame:
    """The hits with ``kept``: what the floor rejects is told, not lost."""
    return scored.withColumn("kept", above_floor(least))


def best(scored: DataFrame, k: int, by: tuple = ("bm25", "path")) -> DataFrame:
    """The first k hits of each query, ranked from 1."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return ranked.where(F.col("rank") <= k)


# Filters and ranks -------------------------------------------------------------------------------------------------


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def passes(filters: dict[str, list[str]], exclude: list[str] = (), primary: dict[str, str] | None = None, include_stale: bool = False) -> Column:
    """Tag filter: any value within a dimension, all dimensions, none of the excluded tags, equal primary fields."""
    unknown = [d for d in filters if d not in TAG_DIMENSIONS]
    if unknown:
        raise QueryError(f"no such dimension: {', '.join(unknown)}; there are {', '.join(TAG_DIMENSIONS)}")
    out = F.lit(True) if include_stale else ~F.coalesce(F.col("stale"), F.lit(False))
    if exclude:
        out = out & ~F.arrays_overlap(F.concat(*TAG_DIMENSIONS), _strings(list(exclude)))
    for field, value in (primary or {}).items():
        if field == "stage":
            out = out & (t.stage_key(F.coalesce(F.col("stage"), F.lit(""))) == t.stage_key(F.lit(value)))
        else:
            out = out & F.coalesce(F.col(field) == value, F.lit(False))
    for dimension, values in filters.items():
        out = out & F.arrays_overlap(F.col(dimension), _strings(values))
    return out


def tag_score(filters: dict[str, list[str]]) -> Column:
    """Mean over the filtered dimensions of the share of wanted values that a note has."""
    if not filters:
        return F.lit(0.0)
    shares = [F.size(F.array_intersect(F.col(d), _strings(v))) / len(v) for d, v in filters.items()]
    return sum(shares[1:], shares[0]) / len(shares)


def type_priority() -> Column:
    weights = F.create_map(*[x for k, v in t.TYPE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.array_max(F.transform("types", lambda x: F.coalesce(F.try_element_at(weights, x), F.lit(0.0)))), F.lit(0.0))


def rank_order(rank: list[str], has_keywords: bool, filters: dict[str, list[str]]) -> list[Column]:
    """Sort keys, first ones first: those named, or the defaults with and without keywords; the path breaks ties."""
    updated = F.desc(F.coalesce(F.col("updated"), F.lit("")))
    named = {"相关度": [F.asc("bm25")] if has_keywords else [], "时间": [updated], "类型优先级": [F.desc(type_priority())]}
    rank = [r for r in rank if r in RANK_KEYS]
    if rank:
        keys = [c for r in rank for c in named[r]]
    elif has_keywords:
        keys = [F.asc("bm25"), F.desc(tag_score(filters)), updated]
    else:
        keys = [F.desc(tag_score(filters)), F.desc(type_priority()), updated]
    return [*keys, F.asc("path")]


def hook_matches(hooks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path, hook, shared) where a question kept with a note answers a query.

    It does if one text holds the other, or half of the query's terms are shared, or at least two terms and 0.35 of the
    hook's are. Distinct texts meet on their rarest terms (``similar``); where one text holds the other without enough terms in common (part of a
    word), they meet on the rarest of the inner text's runs of ``HELD_RUN`` characters.
    """
    # Both sides are met several times below: they are written, so that every text is tokenised once. Pairs are of numbers: a file of pairs of
    # repeated texts is small, and what a join would take of it into the driver's memory is not.
    scratch = Scratch(hooks.sparkSession, "hook-match")

    def numbered(texts: DataFrame, table: str) -> DataFrame:
        return scratch.store(texts.where("text is not null").distinct().withColumn("id", F.monotonically_increasing_id()).withColumn("members", t.query_grams(F.col("text"))), table)

    asked, kept = numbered(queries.select("text"), "asked"), numbered(hooks.select(F.col("hook").alias("text")), "kept").where(F.size("members") > 0)
    alike = scratch.store(sharing(asked.select("id", "members"), kept.select("id", "members"), OF_QUERY, OF_HOOK, LEAST_GRAMS, scratch), "alike")
    own, other = held_ids(kept, asked, scratch, "held_own"), held_ids(asked, kept, scratch, "held_other")
    either = own.select(F.col("outer").alias("asked"), F.col("inner").alias("kept")).union(other.select(F.col("inner").alias("asked"), F.col("outer").alias("kept"))).distinct()
    held = either.join(alike.select("asked", "kept").hint("merge"), ["asked", "kept"], "left_anti")
    # A pair that is held but not alike may still share terms.
    counted = held.join(asked.select(F.col("id").alias("asked"), F.col("members").alias("q")), "asked").join(kept.select(F.col("id").alias("kept"), F.col("members").alias("h")).hint("merge"), "kept")
    counted = counted.select("asked", "kept", F.size(F.array_intersect("q", "h")).cast("bigint").alias("shared"))
    pairs = scratch.store(alike.unionByName(counted), "pairs")
    places, asking = hooks.select("path", F.col("hook").alias("text")).distinct(), queries.select("query_id", "text").distinct()
    paths = scratch.store(places.join(kept.select("text", F.col("id").alias("kept")).hint("merge"), "text").select("path", "kept", F.col("text").alias("hook")), "paths")
    asking = scratch.store(asking.join(asked.select("text", F.col("id").alias("asked")).hint("merge"), "text").select("query_id", "asked"), "asking")
    found = scratch.store(salted(paths, pairs.hint("merge"), "kept", paths.count(), "path"), "found")
    return salted(found, asking, "asked", found.count(), "path").select("query_id", "path", "hook", "shared")


def held_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of texts (first columns of both) where the first one stands in the second one, under both names."""
    x, y, scratch = inner.columns[0], outer.columns[0], Scratch(inner.sparkSession, "held-pairs")
    one, two = (scratch.store(f.select(F.col(f.columns[0]).alias("text")).distinct().withColumn("id", F.monotonically_increasing_id()), n) for f, n in ((inner, "inner"), (outer, "outer")))
    found = held_ids(one, two, scratch, "held")
    return found.join(one.select(F.col("id").alias("inner"), F.col("text").alias(x)), "inner").join(two.select(F.col("id").alias("outer"), F.col("text").alias(y)), "outer").select(x, y)


def held_ids(inner: DataFrame, outer: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """(inner, outer): ids of texts (id, text) of which the first one stands in the second one; both tables are read several times.

    An inner text is looked up by that run of its characters which the fewest outer texts have, so a run that most texts
    share brings no pairs together; one shorter than a run is looked up by itself among the outer texts' shorter runs.
    Runs are kept as numbers (a hash brings a few pairs more together) without the texts, which are met again to be compared.
    """
    # Inner texts shorter than a run need runs of their own length: at most HELD_RUN numbers.
    some = inner.where(F.length("text") > 0)
    lengths = [r[0] for r in some.select(F.least(F.lit(HELD_RUN), F.length("text")).alias("n")).distinct().collect()]
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    hashed = lambda runs: F.explode(F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))).alias("run")
    own = scratch.store(some.select(F.col("id").alias("inner"), hashed(_runs(F.col("text"), F.least(F.lit(HELD_RUN), F.length("text"))))), f"{table}_own")
    outs = outer.where(F.length("text") > 0).select(F.col("id").alias("outer"), hashed(F.flatten(F.transform(sizes, lambda n: _runs(F.col("text"), n)))))
    outs = scratch.store(outs, f"{table}_outs")
    common = outs.groupBy("run").agg(F.count("*").alias("n"))
    rarest = own.join(common.hint("merge"), "run", "left").groupBy("inner").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("run"))
    met = rarest.join(outs.hint("merge"), "run").select("inner", "outer")
    one, two = inner.select(F.col("id").alias("inner"), F.col("text").alias("x")), outer.select(F.col("id").alias("outer"), F.col("text").alias("y"))
    found = met.join(one.hint("merge"), "inner").join(two.hint("merge"), "outer").where(F.col("y").contains(F.col("x"))).select("inner", "outer")
    return scratch.store(found, table)


def _runs(text: Column, n: Column) -> Column:
    """All runs of n characters, in one pass: each character that a run begins with is matched, and the run looked ahead at."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("})).")), F.lit(1))


def hooks_holding(hooks: DataFrame, query: str) -> DataFrame:
    """(path, hook) where hook and query hold one another."""
    return hooks.where(F.col("hook").contains(query) | F.lit(query).contains(F.col("hook"))).select("path", "hook")


def search(notes: DataFrame, keywords: str = "", filters: dict | None = None, exclude: list[str] = (), rank: list[str] = (), limit: int = 20, primary: dict | None = None, include_stale: bool = False, least: int = LEAST_GRAMS, index: Index | None = None) -> DataFrame:
    """Filtered, ranked notes for one request; notes whose hooks match stand first. ``index`` is that of the notes, if it was built before."""
    filters = filters or {}
    spark = notes.sparkSession
    candidates = notes.where(passes(filters, exclude, primary, include_stale))
    order = rank_order(list(rank), bool(keywords), filters)
    if not keywords:
        return candidates.withColumn("bm25", F.lit(0.0)).withColumn("hooked", F.lit(False)).orderBy(*order).limit(limit)
    query = spark.createDataFrame([(0, keywords)], "query_id int, text string")
    scored = bm25(index or notes, query).where(above_floor(least)).select("path", "bm25")
    kept = notes.select("path", F.explode("q_hooks").alias("hook"))
    hooks = hook_matches(kept, query).select("path").distinct().withColumn("hooked", F.lit(True))
    found = candidates.join(scored, "path").join(hooks, "path", "left").withColumn("hooked", F.coalesce("hooked", F.lit(False)))
    return found.orderBy(F.desc("hooked"), *order).limit(limit)


def pull(notes: DataFrame, recipe: dict, index: Index | None = None) -> DataFrame:
    """The notes that a recipe asks for."""
    return search(notes, recipe.get("keywords", ""), recipe.get("filters", {}), recipe.get("exclude", []), recipe.get("rank", []), int(recipe.get("limit", 20)), index=index)


def units(rows: DataFrame, kind: str = "", topic: str = "", confidence: str = "", status: str = "", limit: int = 20) -> DataFrame:
    """The first units (with ``line``, their place in the file) that have all that is asked for; an empty wish asks nothing."""
    for column, value in (("type", kind), ("confidence", confidence), ("status", status)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(F.array_contains("topic_ids", topic)) if topic else rows
    return rows.orderBy("line").limit(limit)


def stale_count(notes: DataFrame, filters: dict, exclude: list[str] = (), primary: dict | None = None) -> DataFrame:
    """How many stale notes a search with these filters hides."""
    return notes.where(passes(filters, exclude, primary, True) & F.coalesce(F.col("stale"), F.lit(False))).agg(F.count("*").alias("hidden"))
