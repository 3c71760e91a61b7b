"""Graphs as edge tables: connected components, degrees, isolated nodes, traversal in hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.skew import lookup
from quillspark.plans.scratch import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of an undirected edge table (src, dst) with the least node it can reach: (node, component).

    In each round every root hooks onto its least neighbour if that is smaller, pointers are halved until all of them
    meet their root, and edges are drawn anew between roots. A root that stays has taken in a neighbour after two rounds
    at most, so their number halves at least every two rounds, whatever the order of the ids; pointers lead to smaller
    ids, so there is no circle. Rounds end when no edge is left. What a round writes is as large as the graph it meets.
    Hubs are joined apart (``skew``), so no node's edges meet in one task.
    Null ends are ignored, loops and repeated edges are harmless, an empty table gives an empty result.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select("src", "dst").where("src is not null and dst is not null")
    live = scratch.store(pairs.union(pairs.select("dst", "src")).distinct(), "edges0")
    forests: list[DataFrame] = []
    n = live.count()
    while not forests or n:
        step = len(forests)
        forest = _to_roots(live.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("parent")), scratch, step)
        forests.append(forest)
        once, n = live.where("src < dst"), n // 2
        one = lookup(once, forest.select(F.col("node").alias("src"), F.col("parent").alias("a")), "src", n).select("dst", "a")
        two = lookup(one, forest.select(F.col("node").alias("dst"), F.col("parent").alias("b")), "dst", n).where("a <> b")
        both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
        live = scratch.store(two.select(F.explode(both).alias("e")).select("e.*").distinct(), f"edges{step + 1}")
        n = live.count()
        scratch.drop(f"edges{step}")
    # Each round's roots are nodes of the next one, or final.
    labels = forests.pop()
    while forests:
        beyond = labels.select(F.col("node").alias("parent"), F.col("parent").alias("beyond"))
        below = forests.pop()
        labels = scratch.store(lookup(below, beyond, "parent", below.count(), "left").select("node", F.coalesce("beyond", "parent").alias("parent")), f"labels{len(forests)}")
    return labels.select("node", F.col("parent").alias("component"))


def _to_roots(forest: DataFrame, scratch: Scratch, step: int) -> DataFrame:
    """(node, parent) with each node's root as its parent; each pass halves what is left of the way."""
    forest, at = scratch.store(forest, f"forest{step}_0"), 0
    n = forest.count()
    while True:
        beyond = forest.where("node <> parent").select(F.col("node").alias("parent"), F.col("parent").alias("beyond"))
        found = lookup(forest, beyond, "parent", n, "left").select("node", F.coalesce("beyond", "parent").alias("parent"), F.col("beyond").isNotNull().alias("moved"))
        found = scratch.store(found, f"forest{step}_{at + 1}")
        scratch.drop(f"forest{step}_{at}")
        forest, at = found.select("node", "parent"), at + 1
        if found.where("moved").isEmpty():
            return forest


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of nodes once, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree) of all nodes of (node); isolated ones have zero."""
    pairs = undirected(edges)
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(degree, nodes)."""
    return degrees(edges, nodes).groupBy("degree").agg(F.count("*").alias("nodes"))


def components_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of all nodes; isolated ones are their own."""
    return nodes.join(connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within so many undirected hops of the seeds (node), which have hop 0; equal ids join.

    What a hop reaches is a written table, so the next one does not work it out again.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    both = scratch.store(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    seen = scratch.store(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "hop0")
    frontier = seen
    for hop in range(1, hops + 1):
        near = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = scratch.store(near.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        seen = seen.unionByName(frontier)
    scratch.drop("edges")
    return seen


def _held(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): texts that stand in others. A text's first two characters are among the other's runs of two."""
    key = F.col("inner").substr(1, 2)
    runs = F.transform(F.sequence(F.lit(1), F.length("outer")), lambda i: F.array(F.col("outer").substr(i, F.lit(1)), F.col("outer").substr(i, F.lit(2))))
    places = outer.where("outer <> ''").select("outer", F.explode(F.array_distinct(F.flatten(runs))).alias("key"))
    return inner.where("inner <> ''").withColumn("key", key).join(places, "key").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def traverse(relations: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The relations (subject, object, ...) within so many hops of seed concepts (concept), with the hop of each.

    An end matches a concept if one text holds the other. Distinct ends meet distinct concepts of a hop by an equality
    on short runs of characters; relations then join by equality.
    """
    scratch = Scratch(relations.sparkSession, "traverse")
    relations = scratch.store(relations, "relations")
    ends = relations.select(F.explode(F.array("subject", "object")).alias("end")).where("end <> ''").distinct()
    frontier = scratch.store(seeds.where("concept <> ''").select("concept").distinct(), "frontier0")
    out, known = None, frontier
    for hop in range(1, hops + 1):
        inside = _held(ends.select(F.col("end").alias("inner")), frontier.select(F.col("concept").alias("outer"))).select(F.col("inner").alias("end"))
        around = _held(frontier.select(F.col("concept").alias("inner")), ends.select(F.col("end").alias("outer"))).select(F.col("outer").alias("end"))
        touched = inside.union(around).distinct()
        first = relations.join(touched, relations["subject"] == touched["end"], "left_semi")
        second = relations.join(touched, relations["object"] == touched["end"], "left_semi")
        found = scratch.store(first.union(second).distinct().withColumn("hop", F.lit(hop)), f"found{hop}")
        out = found if out is None else out.unionByName(found.join(out.select("subject", "object", "doc_id"), ["subject", "object", "doc_id"], "left_anti"))
        reached = found.select(F.explode(F.array("subject", "object")).alias("concept")).distinct()
        if hop < hops:
            frontier = scratch.store(reached.join(known, "concept", "left_anti"), f"frontier{hop}")
            known = known.union(frontier)
    return out


def resolve(names: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, path): the note that a name means, by path, file name, stem or title, in this order, then by least path."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    ways = (F.col("path"), F.substring_index("path", "/", -1), stem, F.col("title"))
    keys = None
    for order, way in enumerate(ways):
        part = notes.select(way.alias("name"), "path", F.lit(order).alias("way"))
        keys = part if keys is None else keys.union(part)
    found = names.select("name").distinct().join(keys, "name")
    return found.groupBy("name").agg(F.min(F.struct("way", "path"))["path"].alias("path"))


def explicit_edges(notes: DataFrame) -> DataFrame:
    """(src, dst, kind) of wikilinks between notes; a target's anchor is dropped; unknown targets give none."""
    links = notes.select(F.col("path").alias("src"), F.explode("links").alias("raw")).select("src", F.trim(F.substring_index("raw", "#", 1)).alias("name")).where("name <> ''")
    return links.join(resolve(links, notes), "name").select("src", F.col("path").alias("dst"), F.lit("link").alias("kind"))


def concept_edges(relations: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, dst, kind): notes that own the two concepts of a relation as topics."""
    owners = notes.select("path", F.explode("topics").alias("topic")).distinct()
    first = relations.join(owners.select(F.col("path").alias("src"), F.col("topic").alias("subject")), "subject")
    return first.join(owners.select(F.col("path").alias("dst"), F.col("topic").alias("object")), "object").select("src", "dst", F.lit("concept").alias("kind")).where("src <> dst").distinct()
