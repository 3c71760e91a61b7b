"""Trie of conversation prefixes with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. Its id is the sum of hashes of its turns by their place, 128 bits in all, so that ids of all
prefixes are running sums, also of a conversation that lies in many tasks. Members of a node are the conversations that
begin with it.

Subtrees are summed along heavy paths. A node's heavy child is the one with the most members (then the least conversation), so
a light child has at most half of its parent's members and no way from the root has more light edges than the logarithm of
the conversations. A leaf's least member runs through all nodes of its path, so the path of a leaf is the stretch of that
conversation below its last light node, and the number of light nodes on it is the path's round. Rounds go from the most
light edges to none: in each the paths are summed from their ends, in segments of ``SEGMENT`` nodes and then over segments, and the sum at a
path's top is added to the node from which the path branches off, which is met in the next round.

Edge cases: rows without a conversation take no part; null roles and texts count as empty; turns with equal numbers are
ordered by role, then by a hash of the text, null numbers first; repeated rows are turns of their own; conversations without turns
are members of the root alone; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.arrow import bound_batches
from quillspark.llm.merkle import CRC_SQL
from quillspark.llm.ranks import ranges, ranked
from quillspark.operators.skew import lookup
from quillspark.plans.scratch import Scratch

SEGMENT = 4096  # nodes of a path that one group sums
CHUNK = 1 << 16  # characters of ids that are joined before they are hashed
FAMILY, MOST_SHARED = 5, 9  # of ``rebuild``
ROOT = bytes(16)


def _id(a: str, b: str) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)]))


def _hashed(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, hx, hy, bytes): texts are hashed where they are read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("hx"), F.xxhash64(F.lit("y"), text, role).alias("hy"), F.octet_length(text).cast("bigint").alias("bytes"),
    )


def rebuild(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, hx, hy, bytes, last) and (conv, length): each conversation c with the first h turns of c - c % ``FAMILY`` in place of its
    own first h, where h is the CRC-32 of c modulo ``MOST_SHARED``."""
    turns = scratch.store(ranked(_hashed(conversations), "conv", ["turn", "role", "hx", "hy"], scratch, "numbered"), "turns")
    scratch.drop("numbered")
    h, base = F.crc32(F.col("conv").cast("string")) % MOST_SHARED, F.col("conv") - F.col("conv") % FAMILY
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", base)
    givers = convs.select(F.col("conv").alias("base"), F.col("n").alias("theirs"))
    given = F.least("h", F.coalesce("theirs", F.lit(0)))
    convs = convs.join(givers, "base", "left").withColumn("given", given).withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.store(convs.select("conv", "base", "h", "given", "length"), "convs")
    columns = ("conv", "depth", "hx", "hy", "bytes", (F.col("depth") == F.col("length")).alias("last"))
    own = lookup(turns, convs.drop("base"), "conv", turns.count()).where("rank > h").withColumn("depth", F.col("rank") - F.col("h") + F.col("given"))
    first = turns.where(f"rank < {MOST_SHARED} and conv % {FAMILY} = 0").withColumnRenamed("conv", "base").withColumnRenamed("rank", "depth")
    theirs = first.join(convs.drop("h"), "base").where("depth <= given")
    return own.select(*columns).unionByName(theirs.select(*columns)), convs.select("conv", "length")


def _suffix_sums(rows: DataFrame, values: list[str], longest: int) -> DataFrame:
    """``rows`` (path, i, ...) with each value replaced by its sum over the rest of the path from i on."""
    if longest <= SEGMENT:
        rest = Window.partitionBy("path").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({v: F.sum(v).over(rest) for v in values})
    cut = rows.withColumn("segment", F.expr(f"i div {SEGMENT}"))
    rest = Window.partitionBy("path", "segment").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy("path", F.col("segment").alias("i")).agg(*[F.sum(v).alias(v) for v in values], *[F.sum(v).alias(f"own_{v}") for v in values])
    beyond = _suffix_sums(totals, values, -(-longest // SEGMENT)).select("path", F.col("i").alias("segment"), *[(F.col(v) - F.col(f"own_{v}")).alias(f"beyond_{v}") for v in values])
    met = cut.withColumns({v: F.sum(v).over(rest) for v in values}).join(beyond, ["path", "segment"])
    return met.withColumns({v: F.col(v) + F.col(f"beyond_{v}") for v in values}).drop("segment", *[f"beyond_{v}" for v in values])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first, ids) of sorted (node, conv): runs of a node's ids joined by commas, each of about ``CHUNK`` characters."""
    out: list[tuple] = []
    node, first, ids, size = None, None, [], 0

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])
        out.clear()
        return made

    for b in batches:
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n != node or size >= CHUNK:
                if ids:
                    out.append((node, first, ",".join(ids)))
                node, first, ids, size = n, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) * 64 + sum(len(r[2]) for r in out[-64:]) >= CHUNK:
            yield batch()
    if ids:
        out.append((node, first, ",".join(ids)))
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of chunks in order; one hash is open at a time."""
    node, state = None, None

    def one(batch: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in batch], pa.binary()), pa.array([r[1] for r in batch], pa.string())], names=["node", "ends_sha256"])

    for b in batches:
        out = []
        for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n != node:
                if state:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield one(out)
    if state:
        yield one([(node, state.hexdigest())])


def end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of each node's conversations (node, conv), ascending and joined by commas."""
    spark = ends.sparkSession
    bound_batches(spark)
    n = ends.count()
    chunks = ends.select("node", "conv").repartitionByRange(ranges(spark, n), "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_chunks, "node binary, first bigint, ids string")
    chunks = scratch.store(chunks, "chunks")
    return chunks.repartition(ranges(spark, n), "node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_digests, "node binary, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the conversations (conv,
    length) with turns (conv, depth, hx, hy, bytes, last); ``hx`` and ``hy`` stand for a turn's role and text."""
    keyed = turns.select("conv", "depth", F.xxhash64("depth", "hx", "hy").alias("x"), F.xxhash64("hy", "depth", "hx").alias("y"), "bytes", "last")
    rows = ranked(keyed, "conv", ["depth"], scratch, "prefixes", ["x", "y"])
    rows = scratch.store(rows.select("conv", "depth", _id("x_sum", "y_sum").alias("node"), _id("x_before", "y_before").alias("parent"), "bytes", "last"), "rows")
    scratch.drop("prefixes")
    n, root = rows.count(), F.lit(ROOT)
    none = F.lit(None).cast("binary")
    found = rows.groupBy("node").agg(F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("parent").alias("parent"))
    top = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = scratch.store(found.unionByName(top.select(root.alias("node"), "conv_id", F.lit(0).cast("bigint").alias("depth"), "n_convs", F.lit(0).cast("bigint").alias("bytes"), none.alias("parent"))), "nodes")
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.min(F.struct((-F.col("n_convs")).alias("n"), "conv_id", "node"))["node"].alias("heavy"))
    kids = scratch.store(kids, "kids")
    heavy = kids.select(F.col("heavy").alias("node"), F.lit(False).alias("light"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = nodes.join(kids.select(F.col("parent").alias("node"), "n_children"), "node", "left").join(heavy, "node", "left")
    nodes = nodes.select("node", "conv_id", "depth", "n_convs", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.coalesce("light", F.lit(True)) & (F.col("depth") > 0)).alias("light"), saved.alias("saved"))
    nodes = scratch.store(nodes, "linked")

    # The conversations that stand for leaves, and the stretch of each that is its path.
    leaves = nodes.where("n_children = 0 and depth > 0").select(F.col("conv_id").alias("conv"))
    routes = scratch.store(lookup(rows.select("conv", "node"), leaves, "conv", n), "routes")
    marked = lookup(routes, nodes.select("node", "depth", "parent", "light", "n_children", "saved"), "node", n)
    routes = scratch.store(marked, "marked")
    tops = routes.groupBy("conv").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("top"), F.sum(F.col("light").cast("int")).alias("round"))
    tops = scratch.store(tops, "tops")
    paths = lookup(routes, tops, "conv", n).where("depth >= top")
    paths = paths.select(F.col("conv").alias("path"), "round", (F.col("depth") - F.col("top")).alias("i"), "node", "parent", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    zero = F.lit(0).cast("bigint")
    first = tops.where("round = 0").first()  # the root's path; there is none without turns
    heir, alone = (F.lit(first["conv"]), 0) if first else (F.col("conv_id"), 1)
    start = top.select(heir.alias("path"), zero.alias("round"), zero.alias("i"), root.alias("node"), none.alias("parent"), F.lit(alone).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens"))
    paths.unionByName(start).write.mode("overwrite").partitionBy("round").parquet(scratch.path("paths"))
    paths = rows.sparkSession.read.schema(paths.schema).parquet(scratch.path("paths"))
    ends = paths.agg(F.max("round"), F.max("i")).first()
    values, summed, attached = ["n_leaves", "saved_tokens"], None, None
    for at in range(ends[0] if ends[0] is not None else -1, -1, -1):
        own = paths.where(F.col("round") == at).drop("round")
        if attached is not None:
            own = own.join(attached, "node", "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values}).drop(*[f"more_{v}" for v in values])
        own = scratch.store(_suffix_sums(own, values, ends[1] + 1), f"round{at}")
        attached = own.where("i = 0 and parent is not null").groupBy(F.col("parent").alias("node")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        summed = own.select("node", *values) if summed is None else summed.unionByName(own.select("node", *values))
    if summed is None:
        summed = paths.select("node", *values)

    last = rows.where("last").select("node", "conv").unionByName(members.where("length = 0").select(root.alias("node"), "conv"))
    digests = end_digests(last, scratch)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = lookup(nodes, parents, "parent", n, "left").join(summed, "node").join(digests, "node", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations as ``rebuild`` gives them."""
    scratch = Scratch(conversations.sparkSession, "trie")
    return trie(*rebuild(conversations, scratch), scratch)


TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS n, c - c % {FAMILY} AS base, {CRC_SQL.format("CAST(c AS VARCHAR)")} % {MOST_SHARED} AS h FROM turns GROUP BY c
), rebuilt AS (
  SELECT v.c, t.k - v.h + least(v.h, coalesce(b.n, 0)) AS d, t.role, t.text
  FROM turns t JOIN convs v ON v.c = t.c LEFT JOIN convs b ON b.c = v.base WHERE t.k > v.h
  UNION ALL
  SELECT v.c, t.k, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.k <= v.h
), rows AS (
  SELECT c, d, strlen(text) AS bytes, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d) AS node FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs
), nodes AS (
  SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, left(node, greatest(d - 1, 0) * 64) AS parent
  FROM rows GROUP BY d, node
), families AS (
  SELECT n.*, coalesce(k.kids, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN (SELECT parent, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY parent) k ON k.parent = n.node
  LEFT JOIN nodes p ON n.d > 0 AND p.node = n.parent
), below AS (
  SELECT a.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM families f JOIN rows a ON a.c = f.conv_id AND a.d <= f.d GROUP BY a.node
), ends AS (
  SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h
  FROM (SELECT c, max_by(node, d) AS node FROM rows GROUP BY c) GROUP BY node
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM families f JOIN below b ON b.node = f.node LEFT JOIN ends e ON e.node = f.node
"""
