"""How many notes each note leads to by relations of their topics, counted without drawing the edges.

Notes with the same topics lead to the same notes, so each set of topics is counted once. Notes that are led to are dealt to chunks, of which there are
``CELLS`` at most; sets are dealt to parts; a cell is a part and a chunk. So relations and sets go to a bounded number of cells, however
many notes there are, and a task holds those of its part as numbers, some twelve bytes for each of their topics. There, some of the chunk's notes at a
time are the bits of a row, as many as let the rows of all subjects have ``ROW_BYTES``: a topic's row is the union of those of the topics
that it is related to, and what a set leads to is the union of its topics' rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.operators.skew import lookup
from quillspark.plans.scratch import Scratch

CHUNK = 8192  # notes that are led to: bits of a row at most, and notes for which a chunk of their own is too many
CELLS = 48  # chunks of a part, or as many as there are cores
PART = 1 << 22  # sets of topics
ROW_BYTES = 64 << 20
SLICE_BYTES = 1 << 20  # of rows that are met at once
CELL = "cell bigint, kind int, a bigint, ids array<bigint>"
OWNERS, RELATIONS, SETS = 0, 1, 2  # in this order they come to a cell


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists and where each list begins (one more at the end)."""
    edges = column.offsets.to_numpy()
    return column.values.to_numpy()[edges[0] : edges[-1]], edges - edges[0]


def _find(values: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values stand among keys, and which of them do."""
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return at, sorted_keys[at] == values


def _joined(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal, neighbouring keys as their union."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return (keys[first], np.bitwise_or.reduceat(rows, first, axis=0)) if len(first) else (keys, rows)


class _Cell:
    """What has come to a cell: by kind the numbers ``a``, the values of their lists and these lists' lengths."""

    def __init__(self) -> None:
        self.held: tuple[list[tuple], ...] = ([], [], [])

    def add(self, kind: int, a: np.ndarray, values: np.ndarray, edges: np.ndarray) -> None:
        self.held[kind].append((a.copy(), values.copy(), np.diff(edges)))

    def _of(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, self.held[kind][:] = [*self.held[kind]], []
        return tuple(np.concatenate(c) if rows else np.empty(0, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The sets and how many of the chunk's notes each leads to, where it leads to any."""
        _, topics, sizes = self._of(OWNERS)
        keys, topic = np.unique(topics, return_inverse=True)
        note, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        subjects, objects, sizes = self._of(RELATIONS)
        at, there = _find(objects, keys)
        subjects, objects = np.repeat(subjects, sizes)[there], at[there].astype(np.int32)
        subject_keys, subject = np.unique(subjects, return_inverse=True)
        order = np.argsort(subject, kind="stable")
        subject, objects = subject[order].astype(np.int32), objects[order]
        sets, topics, sizes = self._of(SETS)
        at, there = _find(topics, subject_keys)
        owner, at = np.repeat(np.arange(len(sets)), sizes)[there], at[there].astype(np.int32)
        sizes = np.bincount(owner, minlength=len(sets))
        begin = np.cumsum(sizes) - sizes
        # Sets with as many subjects have their rows' places in one array.
        alike = [(own := np.flatnonzero(sizes == k), at[begin[own][:, None] + np.arange(k)]) for k in np.unique(sizes[sizes > 0])]
        words = max(1, min(CHUNK, ROW_BYTES * 8 // max(1, len(subject_keys))) // 64)
        step, found = max(1, SLICE_BYTES // (8 * words)), np.zeros(len(sets), dtype=np.int64)
        rows = np.zeros((len(subject_keys), words), dtype=np.uint64)
        for first in range(0, n if len(subject_keys) else 0, words * 64):
            some = slice(*np.searchsorted(note, [first, first + words * 64]))
            used, row = np.unique(topic[some], return_inverse=True)
            bits, plain = note[some] - first, np.zeros((len(used), words * 8), dtype=np.uint8)
            np.bitwise_or.at(plain, (row, bits >> 3), (1 << (bits & 7)).astype(np.uint8))
            own, place = plain.view(np.uint64), np.full(len(keys), -1, dtype=np.int32)
            place[used] = np.arange(len(used))
            met = np.flatnonzero(place[objects] >= 0)
            rows[:] = 0
            for i in range(0, len(met), step):
                part = met[i : i + step]
                at, union = _joined(subject[part], own[place[objects[part]]])
                rows[at] |= union
            for which, places in alike:
                for i in range(0, len(which), step):
                    union = rows[places[i : i + step, 0]]
                    for k in range(1, places.shape[1]):
                        union |= rows[places[i : i + step, k]]
                    found[which[i : i + step]] += np.bitwise_count(union).sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(found)
        return sets[some], found[some]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, cell = None, _Cell()

    def results() -> Iterator[pa.RecordBatch]:
        keys, n = cell.counted()
        for i in range(0, len(keys), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + CHUNK], pa.int64()), pa.array(n[i : i + CHUNK], pa.int64())], names=["set", "n"])

    for b in batches:
        number, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1 if len(number) else []
        for start, end in zip([0, *cuts], [*cuts, len(number)], strict=True):
            if start == end:
                continue
            if number[start] != now:
                yield from results()
                now, cell = number[start], _Cell()
            cell.add(int(kind[start]), b.column(2).slice(start, end - start).to_numpy(), *_lists(b.column(3).slice(start, end - start)))
    yield from results()


def concept_degrees(relations: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, n): the number of other notes that each note (path, topics) leads to by relations (subject, object); those that lead to none are left out.

    The same as counting ``graph.concept_edges`` by src.
    """
    spark, scratch = notes.sparkSession, Scratch(notes.sparkSession, "concept-degrees")
    owners = scratch.store(notes.where("path is not null").select("path", F.explode("topics").alias("topic")).where("topic is not null").distinct(), "owners")
    ids = scratch.store(owners.select("topic").distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
    subject, object_ = (ids.select(F.col("topic").alias(c), F.col("id").alias(x)) for c, x in (("subject", "s"), ("object", "o")))
    pairs = scratch.store(relations.select("subject", "object").distinct().join(subject, "subject").join(object_, "object").select("s", "o"), "relations")
    own = lookup(owners, ids, "topic", owners.count()).groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    own = scratch.store(own.select("path", "ids"), "own")
    sets = scratch.store(own.groupBy("ids").agg(F.count("*").alias("notes")).withColumn("set", F.monotonically_increasing_id()), "sets")
    n_notes, n_sets = own.count(), sets.count()
    chunks, parts = max(1, min(-(-n_notes // CHUNK), max(CELLS, spark.sparkContext.defaultParallelism))), max(1, -(-n_sets // PART))
    every_chunk, every_part = (F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))) for n in (chunks, parts))
    chunk, part = F.pmod(F.xxhash64("path"), F.lit(chunks)), F.pmod(F.xxhash64("set"), F.lit(parts))

    def rows(frame: DataFrame, kind: int, a: str, ids_: F.Column) -> DataFrame:
        return frame.select((F.col("part") * chunks + F.col("chunk")).alias("cell"), F.lit(kind).alias("kind"), F.col(a).cast("bigint").alias("a"), ids_.alias("ids"))

    # A relation goes to the parts that have its subject.
    wanted = sets.select(part.alias("part"), F.explode("ids").alias("s")).distinct()
    there = rows(own.select("ids", chunk.alias("chunk"), every_part.alias("part")).withColumn("a", F.lit(0)), OWNERS, "a", F.col("ids"))
    led = pairs.groupBy("s").agg(F.collect_list("o").alias("led"))
    related = rows(led.join(wanted, "s").select("s", "led", "part", every_chunk.alias("chunk")), RELATIONS, "s", F.col("led"))
    asked = rows(sets.select("set", "ids", part.alias("part"), every_chunk.alias("chunk")), SETS, "set", F.col("ids"))
    # Cells stand for themselves: there are few, and two in one task would let others wait.
    met = there.union(related).union(asked).repartitionById(chunks * parts, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "a").mapInArrow(_counted, "set bigint, n bigint")
    counted = met.groupBy("set").agg(F.sum("n").alias("n"))
    # A set that is related to itself leads its notes to themselves too.
    ends = sets.select("set", F.explode("ids").alias("s"), "ids").select("set", "s", F.explode("ids").alias("o"))
    inward = ends.join(pairs, ["s", "o"], "left_semi").select("set").distinct().withColumn("itself", F.lit(1))
    degree = counted.join(inward, "set", "left").select("set", (F.col("n") - F.coalesce("itself", F.lit(0))).alias("n")).where("n > 0")
    found = scratch.store(degree.join(sets, "set").select("ids", "n"), "found")
    return lookup(own, found, "ids", n_notes).select(F.col("path").alias("src"), "n")
