"""Routed retrieval over four channels: full text, kept questions, topics, and relations between concepts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import text as t
from quillspark.operators import search as s
from quillspark.operators.graph import traverse
from quillspark.operators.segments import hook_scan
from quillspark.plans.scratch import Scratch

# What a channel counts.
CHANNEL_WEIGHT = {"hook": 4, "fts": 3, "topic": 2, "relation": 1}
CORE_HITS = 2
ROUTE_FIELDS = {"keywords": list, "topics": list, "flow": str, "stage": str, "unit_type": str, "include_stale": bool, "need_relations": bool, "top_k": int}
UNIT_TYPES = ("claim", "concept", "qa", "open_question", "relation", "procedure", "conflict", "asset")


class RouteError(ValueError):
    """A route that cannot be followed at all; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Route:
    """Where to look; ``warnings`` holds (code, detail) of what was dropped."""

    keywords: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    flow: str = ""
    stage: str = ""
    unit_type: str = ""
    include_stale: bool = False
    need_relations: bool = False
    top_k: int = 10
    warnings: list[tuple[str, str]] = field(default_factory=list)


def read_route(raw: object, notes: DataFrame) -> Route:
    """A checked route: wrong shapes end the request, unknown values are dropped with a warning."""
    if not isinstance(raw, dict):
        raise RouteError("route_not_object", "a route is an object")
    out = Route()
    for name, value in raw.items():
        kind = ROUTE_FIELDS.get(name)
        if kind is None:
            out.warnings.append(("unknown_field", name))
        elif kind is list and not (isinstance(value, list) and all(isinstance(x, str) for x in value)):
            raise RouteError("route_bad_type", f"{name} is a list of texts")
        elif kind is not list and (not isinstance(value, kind) or kind is int and isinstance(value, bool)):
            raise RouteError("route_bad_type", f"{name} is of type {kind.__name__}")
        else:
            setattr(out, name, value)
    if not 1 <= out.top_k <= 100:
        raise RouteError("route_top_k", "top_k is from 1 to 100")
    if out.topics:
        known = {r[0] for r in notes.select(F.explode("topics").alias("x")).where(F.col("x").isin(out.topics)).distinct().collect()}
        out.warnings += [("unknown_topic", x) for x in out.topics if x not in known]
        out.topics = [x for x in out.topics if x in known]
    if out.unit_type and out.unit_type not in UNIT_TYPES:
        out.warnings.append(("unknown_unit_type", out.unit_type))
        out.unit_type = ""
    if out.flow and notes.where(F.col("flow") == out.flow).isEmpty():
        out.warnings.append(("unknown_flow", out.flow))
        out.flow = ""
    if out.stage:
        same = t.stage_key(F.col("stage")) == t.stage_key(F.lit(out.stage))
        if notes.where(same).isEmpty():
            out.warnings.append(("unknown_stage", out.stage))
            out.stage = ""
        elif out.flow and notes.where(same & (F.col("flow") == out.flow)).isEmpty():
            out.warnings.append(("stage_flow_mismatch", out.stage))
            out.stage = ""
    return out


def text_channel(notes: DataFrame | s.Index, query: DataFrame, least: int) -> DataFrame:
    return s.bm25(notes, query).where(s.above_floor(least)).select("path", F.lit("fts").alias("channel"), "bm25")


def _channel(paths: DataFrame, name: str) -> DataFrame:
    return paths.select("path", F.lit(name).alias("channel"), F.lit(None).cast("double").alias("bm25"))


def topic_seeds(notes: DataFrame, text_hits: DataFrame, hook_hits: DataFrame, topics: list[str]) -> DataFrame:
    """(topic): the route's own, and those of notes whose questions match and of the two best text hits."""
    core = hook_hits.select("path").union(text_hits.orderBy("bm25", "path").limit(CORE_HITS).select("path")).distinct()
    found = notes.join(core, "path").select(F.explode("topics").alias("topic"))
    own = notes.sparkSession.createDataFrame([(x,) for x in topics], "topic string")
    return found.union(own).distinct()


def merge_channels(hits: DataFrame, notes: DataFrame, route: Route) -> DataFrame:
    """One row a note: its channels, the best of their weights, its score; filtered, ranked and cut."""
    weight = F.create_map(*[x for k, v in CHANNEL_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    merged = hits.groupBy("path").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.max(F.element_at(weight, F.col("channel"))).alias("weight"), F.min("bm25").alias("bm25"))
    rows = merged.join(notes.select("path", "title", "flow", "stage", "updated", "stale"), "path")
    if not route.include_stale:
        rows = rows.where(~F.coalesce(F.col("stale"), F.lit(False)))
    if route.flow:
        rows = rows.where(F.col("flow") == route.flow)
    if route.stage:
        rows = rows.where(t.stage_key(F.col("stage")) == t.stage_key(F.lit(route.stage)))
    order = [F.desc("weight"), F.asc(F.coalesce("bm25", F.lit(0.0))), F.desc(F.coalesce("updated", F.lit(""))), F.asc("path")]
    return rows.orderBy(*order).limit(route.top_k)


def recall(notes: DataFrame, query: str, route: Route | None = None, units: DataFrame | None = None, hops: int = 1, least: int = s.LEAST_GRAMS, index: s.Index | None = None) -> DataFrame:
    """(path, title, flow, stage, updated, stale, channels, weight, bm25) of the notes that any channel finds.

    Channels feed one another; the hits of each are written tables.
    """
    spark: SparkSession = notes.sparkSession
    scratch = Scratch(spark, "recall")
    route = route or Route(keywords=[query] if query else [])
    words = " ".join(route.keywords) or query
    if not (words or route.topics):
        raise RouteError("route_empty", "a query, keywords or topics are needed")
    asked = spark.createDataFrame([(0, words)], "query_id int, text string")
    texts = scratch.store(text_channel(index or notes, asked, least), "texts")
    if "hook_terms" in notes.columns:
        hooked = hook_scan(notes, words)
    else:
        hooked = s.hook_matches(notes.select("path", F.explode("q_hooks").alias("hook")), asked).select("path").distinct()
    hooked = scratch.store(hooked, "hooked")
    seeds = scratch.store(topic_seeds(notes, texts, hooked, route.topics), "seeds")
    topical = notes.select("path", F.explode("topics").alias("topic")).join(seeds, "topic").select("path").distinct()
    hits = texts.unionByName(_channel(hooked, "hook")).unionByName(_channel(topical, "topic"))
    if route.need_relations and units is not None and route.unit_type in ("", "relation"):
        start = seeds.select(F.col("topic").alias("concept")).union(spark.createDataFrame([(x,) for x in [*route.topics, *route.keywords] if x], "concept string")).distinct()
        relations = units.where("type = 'relation'").select("subject", "object", "doc_id")
        reached = traverse(relations, start, hops).join(notes.select("path"), F.col("doc_id") == F.col("path")).select("path").distinct()
        hits = hits.unionByName(_channel(reached, "relation"))
    return merge_channels(hits, notes, route)


def rescued(result: DataFrame, rejected: DataFrame) -> DataFrame:
    """Notes in a result that the text channel's floor had rejected and another channel brought back."""
    return result.join(rejected.select("path"), "path", "left_semi")
