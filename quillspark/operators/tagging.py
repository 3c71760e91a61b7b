"""Rule tagging by a controlled vocabulary, tag summaries, and the predicate for body documents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Vocabulary:
    """What a base tags by: canonical tags by dimension, further words that mean them, what a project implies, the tools
    that imply a domain, kinds of sources from the most to the least telling one."""

    canon: dict[str, list[str]]
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    implies: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    tools_of: tuple[str, list[str]] = ("", [])
    source_priority: list[str] = field(default_factory=list)

    def variants(self, dimension: str) -> dict[str, list[str]]:
        """The words, in lower case, of each tag of a dimension."""
        return {c: sorted({c.lower(), *(v.lower() for v in self.synonyms.get(c, []))}) for c in self.canon.get(dimension, [])}

    def table(self, spark: SparkSession) -> DataFrame:
        """(dimension, canon, variant)."""
        rows = [(d, c, v) for d in self.canon for c, words in self.variants(d).items() for v in words]
        return spark.createDataFrame(sorted(rows), "dimension string, canon string, variant string")


#: A small vocabulary of a garden's notes, for trials; a base brings its own.
SAMPLE = Vocabulary(
    canon={
        "domains": ["garden", "water"],
        "forms": ["article", "film"],
        "tools": ["pump", "sensor"],
        "types": ["guide", "case", "question"],
        "projects": ["pond", "greenhouse"],
        "sources": ["scan", "web"],
    },
    synonyms={"garden": ["/en/", "plants"], "water": ["/fr/", "/de/"], "article": ["blog", ".html"], "pump": ["page="], "sensor": ["utm_"], "guide": ["#top", "manual"], "case": ["m."], "pond": ["spam", "ref="], "web": ["https"], "scan": [".pdf"]},
    implies={"pond": {"domains": ["water"], "forms": ["film"]}, "greenhouse": {"domains": ["garden"], "tools": ["sensor"]}},
    tools_of=("garden", ["sensor"]),
    source_priority=["scan", "web"],
)
PLANNED = 400  # words that are a part of the plan; more are one automaton
AUTOMATON = 4 << 20  # characters of the words of one automaton
# Fixed values.
SKIPPED_FOLDERS = ("tmp", "00_索引·规范·日志", ".trash", "__MACOSX")
NAVIGATION_NAMES = ("清单", "索引", "日志", "待下载", "报告", "总览", "说明")
ESSENCE = "·精华笔记.md"
TAGGED = ("domains", "forms", "tools", "types", "projects")


def tag_paths(paths: DataFrame, vocabulary: Vocabulary = SAMPLE) -> DataFrame:
    """Tags of each (path), by words its lower-cased path holds, what these imply, a confidence, and whether to review.

    A path is compared with some hundred words in the row, as a part of the plan; with more by an automaton of all of them, in one pass (``held_words``).
    """
    low = F.lower("path")
    dimensions = (*TAGGED, "sources")
    words = {d: vocabulary.variants(d) for d in dimensions}
    if sum(len(v) for own in words.values() for v in own.values()) > PLANNED:
        places = {(d, c): (i, j) for i, d in enumerate(dimensions) for j, c in enumerate(words[d])}
        held = held_words(paths.sparkSession, low, [(v, *places[d, c]) for d in dimensions for c, own in words[d].items() for v in own], [list(words[d]) for d in dimensions])
        rows = paths.select("path", held.alias("_held"))
        tags = rows.select("path", *[F.col("_held")[i].alias(d) for i, d in enumerate(TAGGED)], F.col("_held")[len(TAGGED)].alias("_sources"))
    else:
        found = {d: _found(low, words[d]) for d in dimensions}
        tags = paths.select("path", *[found[d].alias(d) for d in TAGGED], found["sources"].alias("_sources"))
    for d in ("domains", "forms", "tools"):
        for project, implied in vocabulary.implies.items():
            if d in implied:
                tags = tags.withColumn(d, F.when(F.array_contains("projects", project), F.array_union(F.col(d), F.array(*map(F.lit, implied[d])))).otherwise(F.col(d)))
    domain, tools = vocabulary.tools_of
    if tools:
        used = F.arrays_overlap("tools", F.array(*map(F.lit, tools)))
        tags = tags.withColumn("domains", F.when(used, F.array_union("domains", F.array(F.lit(domain)))).otherwise(F.col("domains")))
    source = F.lit(None).cast("string")
    for name in reversed(vocabulary.source_priority):
        source = F.when(F.array_contains("_sources", name), F.lit(name)).otherwise(source)
    core = (F.size("domains") > 0) & (F.size("types") > 0)
    score = sum((F.when(F.size(d) > 0, w).otherwise(0.0) for d, w in (("domains", 0.4), ("types", 0.3), ("tools", 0.15), ("forms", 0.1), ("projects", 0.15))), F.lit(0.0))
    confidence = F.least(F.round(F.when(core, score).otherwise(F.least(score, F.lit(0.5))), 3), F.lit(0.95))
    tags = tags.withColumn("source_kind", source).withColumn("confidence", confidence).withColumn("needs_review", F.col("confidence") < 0.6)
    return tags.select("path", F.substring_index("path", "/", 1).alias("bucket"), *[F.array_sort(d).alias(d) for d in TAGGED], "source_kind", "confidence", F.lit("规则").alias("classified_by"), "needs_review")


def held_words(spark: SparkSession, low: Column, words: list[tuple[str, int, int]], names: list[list[str]]) -> Column:
    """For each group of ``names`` an array of those, in their order, of which the text holds a word (word, group, place of the name).

    Words go to automata (Aho-Corasick) of at most ``AUTOMATON`` characters each, which are broadcast and built once in each Python
    worker; a text is read once for each of them, however many words it has. An empty word is in every text; a null text holds nothing.
    """
    lots, size = [[]], 0
    for word in sorted(words):
        if size + len(word[0]) > AUTOMATON and lots[-1]:
            lots.append([])
            size = 0
        lots[-1].append(word)
        size += len(word[0])
    shared = [(uuid.uuid4().hex, spark.sparkContext.broadcast(lot)) for lot in lots]
    labels = spark.sparkContext.broadcast(names)

    @F.pandas_udf("array<array<string>>")
    def held(texts: pd.Series) -> pd.Series:
        automata, always = zip(*[_automaton(name, lot.value) for name, lot in shared], strict=True)
        known = frozenset().union(*always)
        out = []
        for text in texts:
            hits = set(known) if text is not None else set()
            if text:
                for automaton in automata:
                    if len(automaton):
                        hits.update(*(own for _, own in automaton.iter(text)))
            found: list[list[str]] = [[] for _ in labels.value]
            for group, at in sorted(hits):
                found[group].append(labels.value[group][at])
            out.append(found)
        return pd.Series(out)

    return held(low)


_automata: dict[str, tuple] = {}


def _automaton(name: str, lot: list[tuple[str, int, int]]) -> tuple:
    """The automaton of a broadcast lot of words, kept by the worker, and what the empty word stands for."""
    import ahocorasick

    if name not in _automata:
        automaton, own = ahocorasick.Automaton(), {}
        for word, group, at in lot:
            own.setdefault(word, set()).add((group, at))
        for word, places in own.items():
            if word:
                automaton.add_word(word, tuple(places))
        if len(automaton):
            automaton.make_automaton()
        _automata[name] = automaton, frozenset(own.get("", ()))
    return _automata[name]


def _found(low: Column, variants: dict[str, list[str]]) -> Column:
    """Array of the canonical tags of which the text holds a variant."""
    hits = []
    for canon, words in variants.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        hits.append(F.when(hit, F.lit(canon)))
    return F.array_compact(F.array(*hits)) if hits else F.expr("cast(array() as array<string>)")


def tag_summary(tags: DataFrame) -> DataFrame:
    """Totals over tagged paths: how many have domains and types, and how many need review."""
    return tags.agg(
        F.count("*").alias("n"), F.sum((F.size("domains") > 0).cast("bigint")).alias("with_domain"), F.sum((F.size("types") > 0).cast("bigint")).alias("with_type"),
        F.sum(F.col("needs_review").cast("bigint")).alias("to_review"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def body_documents(files: DataFrame) -> DataFrame:
    """Files (path, size) that hold text of their own: not tiny, hidden or navigation; an essence note only without its original."""
    top, name = F.substring_index("path", "/", 1), F.substring_index("path", "/", -1)
    navigation = F.lit(False)
    for word in NAVIGATION_NAMES:
        navigation = navigation | name.contains(word)
    kept = files.where((F.col("size") >= 200) & ~top.startswith(".") & ~top.isin(*SKIPPED_FOLDERS) & ~((F.col("size") < 500) & navigation))
    original = F.when(name.endswith(ESSENCE), F.concat(F.expr(f"left(path, length(path) - {len(ESSENCE)})"), F.lit(".md")))
    return kept.withColumn("_original", original).join(files.select(F.col("path").alias("_original")), "_original", "left_anti").drop("_original")


def tag_tiers(tags: DataFrame, dimension: str, least: int = 5, known: list[str] | None = None, promoted: int = 3) -> DataFrame:
    """(tag, n, tier) of a dimension: primary from ``least`` uses on, else candidate.

    With the tags known before, others are new: these are primary from ``promoted`` uses on.
    """
    counted = tags.select(F.explode(dimension).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    enough = F.lit(least) if known is None else F.when(F.col("tag").isin(known), least).otherwise(promoted)
    return counted.withColumn("tier", F.when(F.col("n") >= enough, "primary").otherwise("candidate"))


def archived_tags(uses: DataFrame, today: str, days: int = 180) -> DataFrame:
    """(tag, last) of tags (tag, updated) that nothing has used for so many days."""
    return uses.groupBy("tag").agg(F.max("updated").alias("last")).where(F.datediff(F.lit(today).cast("date"), F.col("last").cast("date")) > days)
