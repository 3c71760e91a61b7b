"""Merkle manifest of a dataset: leaves by group and key, folded by runs of eight to a subroot for each group and to one root.

Rows are indexed in their group by ranges (``ranks``). A task meets a stretch of consecutive leaves and keeps a mountain-range stack:
for each level the nodes of the run that is not complete. A leaf that completes a run of eight carries: the run is written as a node
record and its digest goes to the level above, where the same holds. What remains is residue: nodes before the first aligned
place and the peaks left in the stack at the stretch's end, some fourteen a level. Residues of all tasks meet by run, one
level after the other; a run that is short there is the last one of its group and is hashed as it is, without padding. Subroots are the leaves of
a second tree of the same kind, in the order of their groups.

A proof is a leaf's siblings on each level up to the root. Records join from the top down, so a node's way upwards is made once
for all leaves below it.

Edge cases: nulls in any column have an encoding of their own, a null group comes first, null keys come first in their group;
rows with equal keys are ordered by their leaf, and equal leaves are leaves of their own; a group of one leaf has it as its
subroot and one group's subroot is the root; an empty table gives no rows and a root of None; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.arrow import bound_batches, longs
from quillspark.llm.ranks import ranked
from quillspark.plans.scratch import Scratch

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RECORD = "group string, level int, run bigint, at int, kids array<binary>"
BATCH = 4096  # records
STEPS = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)), 256))


def _joined(kids: Column) -> Column:
    return F.concat_ws("", F.transform(kids, _hex))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


class _Stack:
    """The incomplete runs of a stretch of consecutive leaves of one group, by level."""

    def __init__(self, group: str, write):
        self.group, self.write, self.levels = group, write, []

    def push(self, at: int, digest: bytes) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            open_ = self.levels[level]
            if not open_ and at % FANOUT:  # its run began before the stretch
                self.write(self.group, level, at // FANOUT, at % FANOUT, [digest])
                return
            open_.append((at, digest))
            if len(open_) < FANOUT:
                return
            kids = [d for _, d in open_]
            at //= FANOUT
            self.write(self.group, level, at, None, kids)
            open_.clear()
            digest = hashlib.sha256("".join(d.hex() for d in kids).encode()).digest()
            level += 1

    def close(self) -> None:
        for level, open_ in enumerate(self.levels):
            for at, digest in open_:
                self.write(self.group, level, at // FANOUT, at % FANOUT, [digest])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of complete runs (``at`` is null) and of residue, from (group, rank, digest) in order."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary())]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
        out.clear()
        return made

    stack, expected = None, -1
    for b in batches:
        for group, rank, digest in zip(b.column(0).to_pylist(), longs(b.column(1)).tolist(), b.column(2).to_pylist(), strict=True):
            if stack is None or rank != expected or group != stack.group:
                if stack:
                    stack.close()
                stack = _Stack(group, lambda *r: out.append(r))
            stack.push(rank - 1, digest)
            expected = rank + 1
            if len(out) >= BATCH:
                yield batch()
    if stack:
        stack.close()
    yield batch()


@dataclass
class Tree:
    """Node records of all levels by (group, run), and each group's top (group, top, digest): its level and its digest."""

    runs: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame, scratch: Scratch, name: str) -> Tree:
    """The trees of (group, rank, digest), one for each group."""
    spark = leaves.sparkSession
    records = scratch.store(leaves.select("group", "rank", "digest").mapInArrow(_carry, RECORD), f"{name}_records")
    sizes = leaves.groupBy("group").agg(F.count("*").alias("n"))
    top, most = F.lit(0), sizes.agg(F.max("n")).first()[0] or 0
    depth, width = 0, 1
    while width < most:
        top = F.when(F.col("n") > width, depth + 1).otherwise(top)
        depth, width = depth + 1, width * FANOUT
    sizes = sizes.select("group", top.alias("top"))
    residue = scratch.store(records.where("at is not null").join(sizes, "group").select("group", "top", "level", "run", "at", F.col("kids")[0].alias("digest")), f"{name}_residue")
    runs, tops, risen = [], [], None
    for level in range(depth + 1):
        nodes = residue.where(F.col("level") == level).drop("level")
        nodes = nodes if risen is None else nodes.unionByName(risen)
        tops.append(nodes.where(F.col("top") == level).select("group", "top", "digest"))
        met = nodes.where(F.col("top") > level).groupBy("group", "top", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda k: k["digest"]).alias("kids"))
        met = scratch.store(met, f"{name}_met{level}")
        runs.append(records.where((F.col("level") == level) & F.col("at").isNull()).select("group", "run", "kids").unionByName(met.select("group", "run", "kids")))
        above = F.unhex(F.sha2(_joined(F.col("kids")), 256))
        risen = met.select("group", "top", F.expr(f"run div {FANOUT}").alias("run"), F.expr(f"cast(run % {FANOUT} as int)").alias("at"), above.alias("digest"))
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Tree(runs[:depth], scratch.store(found, f"{name}_tops") if depth or most else spark.createDataFrame([], "group string, top int, digest binary"))


def _step(kids: Column, at: Column) -> Column:
    before, after = F.slice(kids, 1, at), F.slice(kids, at + 2, FANOUT)
    return F.struct(_joined(before).alias("before"), _joined(after).alias("after"))


def proofs(leaves: DataFrame, tree: Tree, above: DataFrame) -> DataFrame:
    """``leaves`` with their group's subroot and ``steps``, from the leaf up: what stands before and after it in its run, as hex, then the
    same for its run's node. ``above`` (group, subroot, steps) continues the way of each group's top."""
    tops = tree.tops.select("group", "top").join(above, "group")
    ways = None  # of the nodes of the level above, by their number
    for level in reversed(range(len(tree.runs))):
        starts = tops.where(F.col("top") == level + 1).select("group", F.lit(0).cast("bigint").alias("run"), "subroot", "steps")
        ways = starts if ways is None else ways.unionByName(starts)
        met = tree.runs[level].join(ways, ["group", "run"])
        if not level:
            break
        kids = met.select("group", "run", "kids", "subroot", "steps", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("at"))
        ways = kids.select("group", (F.col("run") * FANOUT + F.col("at")).alias("run"), "subroot", F.concat(F.array(_step(F.col("kids"), F.col("at"))), "steps").alias("steps"))
    alone = tops.where("top = 0").select("group", F.lit(0).cast("bigint").alias("run"), F.lit(None).cast("array<binary>").alias("kids"), "subroot", "steps")
    met = met.unionByName(alone) if ways is not None else alone
    own = leaves.withColumn("at", F.expr(f"cast((rank - 1) % {FANOUT} as int)")).withColumn("run", F.expr(f"(rank - 1) div {FANOUT}"))
    first = F.when(F.col("kids").isNull(), F.array().cast(STEPS)).otherwise(F.array(_step(F.col("kids"), F.col("at"))))
    return own.join(met, ["group", "run"]).withColumn("steps", F.concat(first, "steps")).drop("kids", "run", "at")


def folded(digest: Column, steps: Column) -> Column:
    """The root that follows from a leaf (hex) and its siblings."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(rows: DataFrame, columns: dict[str, Column], group: str, scratch: Scratch) -> tuple[DataFrame, str | None]:
    """(group, digest, further columns, subroot, steps) of each leaf and the root of all. ``rows`` has columns ``key``, ``digest`` and those of
    ``columns``; leaves ascend by key in the groups that column ``group`` names."""
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null comes first, as the empty name
    leaves = ranked(rows.select(named.alias("group"), "key", "digest", *[c.alias(n) for n, c in columns.items()]), "group", ["key", "digest"], scratch, "leaves")
    trees = build(leaves, scratch, "rows")
    tops = ranked(trees.tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), "group", ["name"], scratch, "subroots")
    over = build(tops, scratch, "groups")
    root = over.tops.select(_hex(F.col("digest"))).first()
    start = over.tops.select("group", _hex(F.col("digest")).alias("subroot"), F.array().cast(STEPS).alias("steps"))
    above = proofs(tops, over, start).select(F.col("name").alias("group"), _hex(F.col("digest")).alias("subroot"), "steps")
    return proofs(leaves, trees, above), root[0] if root else None


def verified(docs: DataFrame) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and whether the root follows from the leaf of what may be tampered texts and its proof.

    A text is tampered with, by lower-casing A to Z, where three divides the CRC-32 of the id.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    fields = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf([*fields[:-1], F.translate("text", UPPER, LOWER)]))
    rows = docs.select("lang", F.col("doc_id").alias("key"), leaf(fields).alias("digest"), tampered.alias("tampered"))
    rows = scratch.store(rows, "rows")
    proved, root = manifest(rows, {"tampered": F.col("tampered")}, "lang", scratch)
    siblings = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"])))
    out = proved.select(
        F.col("key").alias("doc_id"), _hex(F.col("digest")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded(_hex(F.coalesce("tampered", "digest")), F.col("steps")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


CRC_SQL = (  # CRC-32 of the ASCII text {0}, bit by bit
    "xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split({0}, '')],"
    " lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)


def _enc(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


VERIFIED_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, sha256({" || ".join(map(_enc, FIELDS))}) AS leaf,
    {CRC_SQL.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS changed,
    sha256({" || ".join(map(_enc, FIELDS[:-1]))} || {_enc(f"translate(text, '{UPPER}', '{LOWER}')")}) AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM docs
), nodes AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, i // 8, n
), way AS (
  SELECT l.lang, l.i AS leaf_at, 0 AS level, l.i, l.n, '' AS proof, CASE WHEN changed THEN other ELSE leaf END AS folded FROM leaves l
  UNION ALL
  SELECT w.lang, w.leaf_at, w.level + 1, w.i // 8, (w.n + 7) // 8,
    w.proof || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> w.i), ''),
    sha256(string_agg(CASE WHEN x.i = w.i THEN w.folded ELSE x.h END, '' ORDER BY x.i))
  FROM way w JOIN nodes x ON x.lang IS NOT DISTINCT FROM w.lang AND x.level = w.level AND x.i // 8 = w.i // 8 WHERE w.n > 1
  GROUP BY w.lang, w.leaf_at, w.level, w.i, w.n, w.proof, w.folded
), higher AS (
  SELECT w.lang, w.leaf_at, 0 AS level, s.i, s.n, w.proof, w.folded FROM way w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.lang, w.leaf_at, w.level + 1, w.i // 8, (w.n + 7) // 8,
    w.proof || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> w.i), ''),
    sha256(string_agg(CASE WHEN x.i = w.i THEN w.folded ELSE x.h END, '' ORDER BY x.i))
  FROM higher w JOIN upper x ON x.level = w.level AND x.i // 8 = w.i // 8 WHERE w.n > 1
  GROUP BY w.lang, w.leaf_at, w.level, w.i, w.n, w.proof, w.folded
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root, h.folded = r.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN higher h ON h.lang IS NOT DISTINCT FROM l.lang AND h.leaf_at = l.i AND h.n = 1
CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
"""
