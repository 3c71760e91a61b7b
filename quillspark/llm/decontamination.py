"""Benchmark decontamination by greedy string tiling.

1. Items and documents become words (letters and digits, lower-cased in A-Z). Every run of ``SEED`` words is a seed; an
   item of fewer words is one seed of its own length.
2. The items' seeds set bits of a filter of fixed size, which every task gets. A document's seeds that pass it go to an
   equi-join with the items' seeds, and only these: what is shuffled grows with what documents share with the benchmark.
   Copies of an item are one class there.
3. A pair whose seeds, each as often as it stands in the item, could not cover enough of it even if none overlapped is
   dropped. For the others the runs of
   the document that lie under shared seeds are tiled: for match lengths from the longest possible down, Karp-Rabin
   hashes of unmarked runs of the item are looked up among those of the document, matches are grown, and the longest
   ones that overlap no tile are marked, until none of ``SEED`` words is left. Every tile lies under seeds, so the
   document's other words cannot change the result.
4. A pair is a leak if tiles cover at least ``COVERAGE`` of the item, in whatever order they stand in the document.

Edge cases: items and documents that are null, empty or without words match nothing; rows with a null id of either
table cannot be named in a pair and are left out; documents that share an id are one, with the words of each apart;
repeated items each give their pairs; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.arrow import bound_batches, lean, slices
from quillspark.llm.bloom import may_hold
from quillspark.llm.shingle_hash import MARKS, window_hashes, word_hashes
from quillspark.operators.skew import lookup, salted
from quillspark.plans.scratch import Scratch

SEED = 5
COVERAGE = 0.5
FILTER_BITS = 24
LEAKS = "doc_id bigint, item_id bigint, coverage double, n_tiles bigint, tiled_words bigint, item_words bigint"


def _seed_length(words: int, seed: int) -> int:
    return min(words, seed)


class _Words:
    """Words with hashes of their runs of every power of two, to find how far two places agree."""

    def __init__(self, words: np.ndarray):
        self.words, self.hashes = words, {}

    def of(self, power: int) -> np.ndarray:
        if power not in self.hashes:
            self.hashes[power] = window_hashes(self.words, 1 << power)
        return self.hashes[power]


def _common(one: _Words, a: int, two: _Words, b: int, most: int) -> int:
    """How many words from two places on are equal, ``most`` at most; in steps that grow with its logarithm."""
    n = 0
    for power in range(most.bit_length() - 1, -1, -1):
        if n + (1 << power) <= most and one.of(power)[a + n] == two.of(power)[b + n]:
            n += 1 << power
    return n


def tiles(item: np.ndarray, runs: list[np.ndarray], least: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling: non-overlapping matches (place in item, run, place in run, length), longest first.

    Of matches of one length those earlier in the item, then in the document, are marked first.
    """
    starts = np.cumsum([0, *(len(r) + 1 for r in runs)])
    text = np.zeros(int(starts[-1]), dtype=np.uint64)  # runs, each with a place after it that is never free
    free_item, free = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)
    for r, at in zip(runs, starts, strict=False):
        text[at : at + len(r)] = r
        free[at + len(r)] = False
    one, two = _Words(item), _Words(text)
    out: list[tuple[int, int, int, int]] = []
    length = min(len(item), max((len(r) for r in runs), default=0))
    while length >= least and free_item.any():
        found = _matches(one, two, free_item, free, length)
        if not found:
            length = length // 2 if length // 2 > least else least if length > least else least - 1
            continue
        top = max(m[2] for m in found)
        for a, b, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if free_item[a] and free[b] and free_item[a : a + n].all() and free[b : b + n].all() and np.array_equal(item[a : a + n], text[b : b + n]):
                free_item[a : a + n] = False
                free[b : b + n] = False
                r = int(np.searchsorted(starts, b, side="right")) - 1
                out.append((a, r, b - int(starts[r]), n))
        # What was blocked may match in a shorter form; nothing unmarked is longer than before.
        length = min(length, top)
        if top == length and not any(free_item[a] for a, _, _ in found):
            length -= 1
    return out


def _matches(one: _Words, two: _Words, free_item: np.ndarray, free: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """All maximal matches (place in item, in text, length) of free words of at least ``length``, found by hashes of runs of that length.

    Places of one hash are kept by the word before them: where these are equal too, the match begins before, so a word
    that is repeated over and over makes as many pairs as it has places, not their square.
    """
    table: dict[int, dict[int | None, list[int]]] = defaultdict(lambda: defaultdict(list))
    for a, h, before in _free_windows(one.words, free_item, length):
        table[h][before].append(a)
    ends_item, ends = _next_blocked(free_item), _next_blocked(free)
    found = []
    for b, h, before in _free_windows(two.words, free, length):
        for other, places in table.get(h, {}).items():
            if other is None or other != before:
                for a in places:
                    n = _common(one, a, two, b, int(min(ends_item[a] - a, ends[b] - b)))
                    if n >= length:
                        found.append((a, b, n))
    return found


def _next_blocked(free: np.ndarray) -> np.ndarray:
    """For each place the first place from it on that is not free."""
    at = np.where(free, len(free), np.arange(len(free)))
    return np.minimum.accumulate(at[::-1])[::-1]


def _free_windows(words: np.ndarray, free: np.ndarray, length: int) -> Iterator[tuple[int, int, int | None]]:
    """Place and hash of each run of ``length`` free words, and the free word before it, if there is one."""
    hashes = window_hashes(words, length)
    blocked = np.concatenate([[0], np.cumsum(~free)])
    clear = np.flatnonzero(blocked[length:] == blocked[:-length]) if len(hashes) else []
    for at in clear:
        yield int(at), int(hashes[at]), int(words[at - 1]) if at and free[at - 1] else None


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, edges = word_hashes(b.column(1).to_pylist(), MARKS)
        own = [words[edges[i] : edges[i + 1]] for i in range(b.num_rows)]
        found = [np.unique(window_hashes(w, _seed_length(len(w), SEED)), return_counts=True) for w in own]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in ([w.view(np.int64) for w in own], [s.view(np.int64) for s, _ in found], [n for _, n in found]))],
            names=["item_id", "words", "seeds", "times"],
        )


def _pairs_runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches that runs of ``length`` words, begun where ``flags`` hold, cover together."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + length).tolist(), strict=True))


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x in b.to_pylist():
            item = np.array(x["words"], dtype=np.int64).view(np.uint64)
            runs = [np.array(r, dtype=np.int64).view(np.uint64) for r in x["runs"]]
            marked = tiles(item, runs, _seed_length(len(item), SEED))
            covered = sum(m[3] for m in marked)
            if covered >= COVERAGE * len(item):
                rows.append({"doc_id": x["doc_id"], "item_id": x["item_id"], "coverage": covered / len(item), "n_tiles": len(marked), "tiled_words": covered, "item_words": len(item)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), *((c, pa.int64()) for c in ("n_tiles", "tiled_words", "item_words"))]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item whose passage it holds: see ``LEAKS``."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "decontamination")
    columns = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    items = scratch.store(columns.mapInArrow(lean(_items), "item_id bigint, words array<bigint>, seeds array<bigint>, times array<bigint>").where("size(words) > 0"), "items")
    # Items of the same words are one class, named by its least item_id.
    classes = items.groupBy("words").agg(F.min("item_id").alias("class_id"), F.first(F.arrays_zip("seeds", "times")).alias("seeds"))
    seeds = scratch.store(classes.select("class_id", F.size("words").alias("item_words"), F.explode("seeds").alias("s")).select("class_id", "item_words", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times")), "seeds")

    # A bit for each value of a seed's first bits: at most 2**FILTER_BITS bits, here 2 MB, however many items there are.
    word = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bits = seeds.select((word / 64).cast("bigint").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) % 64 as int))").alias("bit"))
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[row["at"]] = row["bits"]
    flags = spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").view(bool))
    lengths = sorted(r[0] for r in seeds.select(F.least(F.col("item_words"), F.lit(SEED))).distinct().collect())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, shift = flags.value, np.uint64(64 - FILTER_BITS)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids, spans, found = [], [], []
            for start, stop in slices(texts):
                words, edges = word_hashes(texts[start:stop], MARKS)
                for n in lengths:
                    hashes = window_hashes(words, n)
                    hit = passes[hashes >> shift]
                    for i in np.unique(np.searchsorted(edges, np.flatnonzero(hit), side="right") - 1).tolist():
                        own = slice(edges[i], max(edges[i], edges[i + 1] - n + 1))
                        if not hit[own].any():
                            continue
                        own_words = words[edges[i] : edges[i + 1]].view(np.int64)
                        ids.append(b.column(0)[start + i].as_py())
                        spans.append([own_words[s:e].tolist() for s, e in _pairs_runs(hit[own], n)])
                        found.append(np.unique(hashes[own][hit[own]]).view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "runs", "seeds"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    probed = texts.mapInArrow(lean(probe), "doc_id bigint, runs array<array<bigint>>, seeds array<bigint>")
    probed = scratch.store(probed.withColumn("row", F.monotonically_increasing_id()), "probed")
    n_seeds = probed.agg(F.sum(F.size("seeds"))).first()[0] or 0
    shared = salted(probed.select("row", F.explode("seeds").alias("seed")), seeds, "seed", n_seeds, "row").groupBy("row", "class_id").agg(F.sum("times").alias("n"), F.max("item_words").alias("item_words"))
    likely = scratch.store(shared.where(F.col("n") * SEED >= COVERAGE * F.col("item_words")).select("row", "class_id"), "likely")
    worded = lookup(likely, classes.select("class_id", "words"), "class_id", likely.count())
    pairs = worded.join(probed.select("row", "doc_id", "runs"), "row").select("doc_id", F.col("class_id").alias("item_id"), "runs", "words")
    found = scratch.store(pairs.mapInArrow(lean(_tile), LEAKS), "found")
    # Back from classes to all of their items; of a document's rows the best counts.
    members = items.select("words", "item_id").join(classes.select("words", F.col("class_id")), "words").select("class_id", F.col("item_id").alias("member"))
    named = salted(found.withColumnRenamed("item_id", "class_id"), members, "class_id", found.count(), "doc_id").select("doc_id", F.col("member").alias("item_id"), "coverage", "n_tiles", "tiled_words", "item_words")
    out = scratch.store(named.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("coverage", "n_tiles", "tiled_words", "item_words"), F.struct("coverage", -F.col("n_tiles"))).alias("m")).select("doc_id", "item_id", "m.*"), "leaks")
    scratch.drop("seeds", "probed", "likely", "found", "items")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose documents hold no item's passage, with their columns; rows with a null id stay."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    held = may_hold(found, docs["doc_id"].cast("bigint"))
    # Only rows that the filter passes meet the exact join; it never passes a null.
    return docs.where(~held).unionByName(docs.where(held).join(found, docs["doc_id"] == found["_leak"], "left_anti"))
