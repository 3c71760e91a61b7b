"""Token ids in raw binary shards, each with a minimal perfect hash index for keyed access in constant time.

Documents are ranged by key; each task writes the documents of its range, in ascending order, to shards of bounded
size. A shard is two files: ``.ids`` (raw little-endian ids, 16 bits wide where the vocabulary allows it, else 32)
and ``.mph`` (the index). The index is a cascade of bit levels: at each level a key is hashed to one bit, keys that are
alone on a bit end there, the others go on to the next level; a key's slot is the number of set bits before its own.
Slots hold a fingerprint, the place of the ids and their number. A key that is not in the shard is told by its
fingerprint, but for one case in 2**32.

A task writes under names of its own, and the manifest, a written table, names those of the task that succeeded: a lost
executor's half-written files are never read. Files go through pyarrow's file systems, so the folder may be in any
store that all executors share.

Edge cases: a null or empty text is its end id alone; a null id sorts first; rows that share an id are told apart by
their number within the shard, in order of a hash of their texts; an empty table gives an empty manifest; further
columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.llm.arrow import bound_batches, slices
from quillspark.llm.byte_bpe import ID_BYTES, default_vocabulary, encoder
from quillspark.llm.shingle_hash import mix
from quillspark.plans.scratch import Scratch

MAGIC = b"QIDS0001"
SHARD_TOKENS = 16 * 1024 * 1024
RANGES = 512  # of ids, when keys look for their shards
_SEED = np.uint64(0x2545F4914F6CDD1D)
_MARK = np.uint64(0xA0761D6478BD642F)

MANIFEST = "partition int, seq int, ids_file string, index_file string, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint"
ENTRIES = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def key_hashes(ids: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys; distinct for distinct ids."""
    first = mix(ids.astype(np.uint64) + _SEED)
    other = (occurrence > 0) | null
    return np.where(other, mix(first ^ mix(occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64) + _MARK)), first)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: ``slots`` maps each of n keys to its own number below n."""

    MAX_LEVELS = 64

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * int(_SEED) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        while len(left):
            if len(sizes) == cls.MAX_LEVELS:
                raise ValueError("two keys have the same hash")
            size = -(-2 * len(left) // 64) * 64
            at = cls._bit(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.empty(0, dtype=np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that are not in it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._bit(keys[left], level, int(size)) + self.base[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.rank[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class ShardIndex:
    """The index file of a shard: keys in order, their perfect hash, and by slot fingerprint, place and number of ids."""

    def __init__(self, ids: np.ndarray, occurrence: np.ndarray, null: np.ndarray, width: int, hashed: PerfectHash, prints: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.ids, self.occurrence, self.null, self.width = ids, occurrence, null, width
        self.hashed, self.prints, self.starts, self.lengths = hashed, prints, starts, lengths

    @classmethod
    def of(cls, ids: np.ndarray, occurrence: np.ndarray, null: np.ndarray, lengths: np.ndarray, width: int) -> ShardIndex:
        keys = key_hashes(ids, occurrence, null)
        hashed = PerfectHash.build(keys)
        by_slot = np.empty(len(keys), dtype=np.int64)
        by_slot[hashed.slots(keys)] = np.arange(len(keys))
        starts = np.cumsum(lengths) - lengths
        return cls(ids, occurrence, null, width, hashed, cls._print(keys)[by_slot], starts[by_slot], lengths[by_slot])

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ _MARK) >> np.uint64(32)).astype(np.uint32)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        out.write(MAGIC + struct.pack("<qqqq", self.width, len(self.ids), len(self.hashed.sizes), len(self.hashed.words)))
        for values, kind in ((self.ids, "<i8"), (self.occurrence, "<i8"), (self.null, "u1"), (self.hashed.sizes, "<i8"), (self.hashed.words, "<u8"), (self.prints, "<u4"), (self.starts, "<i8"), (self.lengths, "<i8")):
            out.write(values.astype(kind).tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index of token ids")
        width, n, levels, words = struct.unpack_from("<qqqq", data, len(MAGIC))
        at, parts = len(MAGIC) + 32, []
        for kind, count in (("<i8", n), ("<i8", n), ("u1", n), ("<i8", levels), ("<u8", words), ("<u4", n), ("<i8", n), ("<i8", n)):
            parts.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
            at += parts[-1].nbytes
        ids, occurrence, null, sizes, bits, prints, starts, lengths = parts
        return cls(ids, occurrence, null.astype(bool), width, PerfectHash(sizes, bits), prints, starts, lengths)

    def find(self, ids: np.ndarray, occurrence: np.ndarray | None = None, null: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First id's place and number of ids of each key; -1 and 0 for keys that the shard lacks."""
        occurrence = np.zeros(len(ids), dtype=np.int64) if occurrence is None else occurrence
        keys = key_hashes(ids, occurrence, np.zeros(len(ids), dtype=bool) if null is None else null)
        slots = self.hashed.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == self._print(keys[known])
        starts, lengths = np.full(len(ids), -1, dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        starts[known], lengths[known] = self.starts[slots[known]], self.lengths[slots[known]]
        return starts, lengths


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if ":" in path else (fs.LocalFileSystem(), path)


class _Shard:
    """A shard that is being written."""

    def __init__(self, folder: str, partition: int, seq: int, width: int):
        self.name = f"{folder}/shard-{partition:06d}-{seq:04d}-{uuid.uuid4().hex}"
        self.partition, self.seq, self.width = partition, seq, width
        self.system, path = _store(self.name)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(path + ".ids")
        self.ids: list[int | None] = []
        self.occurrence: list[int] = []
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, coded: bytes) -> None:
        values = np.frombuffer(coded, dtype="<u4")
        self.out.write(values.astype("<u2").tobytes() if self.width == 2 else coded)
        again = bool(self.ids) and self.ids[-1] == doc_id
        self.occurrence.append(self.occurrence[-1] + 1 if again else 0)
        self.ids.append(doc_id)
        self.lengths.append(len(values))
        self.tokens += len(values)

    def close(self) -> dict:
        self.out.close()
        null = np.array([i is None for i in self.ids])
        index = ShardIndex.of(np.array([i or 0 for i in self.ids], dtype=np.int64), np.array(self.occurrence), null, np.array(self.lengths), self.width)
        with self.system.open_output_stream(_store(self.name)[1] + ".mph") as out:
            out.write(index.to_bytes())
        return {"partition": self.partition, "seq": self.seq, "ids_file": self.name + ".ids", "index_file": self.name + ".mph", "n_docs": len(self.ids), "n_tokens": self.tokens, "first_id": next((i for i in self.ids if i is not None), None), "last_id": self.ids[-1]}


def write_token_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents into shards under ``folder`` in ascending order of doc_id; returns the manifest."""
    bound_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    end = int(end_id).to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, partition = encoder(vocabulary), TaskContext.get().partitionId()
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard, done = None, []
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, stop in slices(texts, 2_000_000):
                for doc_id, coded in zip(ids[start:stop], coder.encode(texts[start:stop]), strict=True):
                    if shard and shard.tokens >= shard_tokens:
                        done.append(shard.close())
                        shard = None
                    shard = shard or _Shard(folder, partition, len(done), width)
                    shard.add(doc_id, coded + end)
        if shard:
            done.append(shard.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("partition", pa.int32()), ("seq", pa.int32()), ("ids_file", pa.string()), ("index_file", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "first_id", "last_id"))]))

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row's own number lets a range cut what rows of one id and text there are.
    order = ["doc_id", F.xxhash64("text"), "_row"]
    ranged = columns.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = ranged.select("doc_id", "text").mapInArrow(run, MANIFEST)
    path = f"{folder}/manifest"
    manifest.write.mode("overwrite").parquet(path)
    manifest = docs.sparkSession.read.parquet(path)
    remove_strays(manifest, folder)
    return manifest


def remove_strays(manifest: DataFrame, folder: str) -> None:
    """Delete the shard files of tasks that failed or were repeated: those that the manifest does not name."""
    named = {f.rpartition("/")[2] for r in manifest.select("ids_file", "index_file").toLocalIterator() for f in r}
    system, path = _store(folder)
    for file in system.get_file_info(fs.FileSelector(path)):
        if file.base_name.startswith("shard-") and file.base_name not in named:
            system.delete_file(file.path)


def read_ids(ids_file: str, starts: np.ndarray, lengths: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The ids at each place of a shard, by positioned reads."""
    system, path = _store(ids_file)
    with system.open_input_file(path) as file:
        for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
            yield np.frombuffer(file.read_at(length * width, start * width), dtype="<u2" if width == 2 else "<u4")


def open_index(index_file: str) -> ShardIndex:
    system, path = _store(index_file)
    with system.open_input_file(path) as file:
        return ShardIndex.from_bytes(file.read())


def read_back(manifest: DataFrame) -> DataFrame:
    """Each document's place and a digest of its ids, every key looked up through its shard's index: see ``ENTRIES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.to_pylist():
                index = open_index(shard["index_file"])
                starts, lengths = index.find(index.ids, index.occurrence, index.null)
                if (starts < 0).any():
                    raise ValueError(f"{shard['index_file']} lacks keys of its own")
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in read_ids(shard["ids_file"], starts, lengths, index.width)]
                ids = pa.array(index.ids, pa.int64(), mask=index.null)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts + shard["base"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard of millions of tokens: sums over all of them are small.
    before = Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    tasks = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return placed.select("ids_file", "index_file", "base").repartition(tasks).mapInArrow(run, ENTRIES)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids of given documents: (doc_id, ids), by the index alone, for keys (doc_id); missing keys give no row, and a
    key that several documents share gives one for each.

    Keys meet the shards whose range holds them; a shard's index and its few positioned reads serve all its keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.to_pylist():
                index = open_index(shard["index_file"])
                wanted, again = np.array(shard["keys"], dtype=np.int64), 0
                while len(wanted):
                    starts, lengths = index.find(wanted, np.full(len(wanted), again, dtype=np.int64))
                    known = starts >= 0
                    wanted, again = wanted[known], again + 1
                    ids = [x.astype(np.int64).tolist() for x in read_ids(shard["ids_file"], starts[known], lengths[known], index.width)]
                    yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    # Shards and keys are dealt to ranges cut at quantiles of the shards' first ids, so that they meet by an equality and
    # then by the range, however ids are spread.
    known = manifest.where("first_id is not null")
    cuts = np.unique(np.array(known.approxQuantile("first_id", (np.arange(1, RANGES) / RANGES).tolist(), 0.001), dtype=np.int64))

    @F.pandas_udf("int")
    def bin_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    ranges = known.withColumn("bin", F.explode(F.sequence(bin_of("first_id"), bin_of("last_id"))))
    wanted = keys.select(F.col("doc_id").cast("bigint").alias("k")).where("k is not null").distinct().withColumn("bin", bin_of("k"))
    met = wanted.join(ranges, "bin").where("k between first_id and last_id")
    grouped = met.groupBy("index_file", "ids_file", F.pmod(F.xxhash64("k"), F.lit(64)).alias("part")).agg(F.collect_list("k").alias("keys"))
    return grouped.select("index_file", "ids_file", "keys").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def token_table(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the shards of all documents and read every document's entry back from them."""
    spark: SparkSession = docs.sparkSession
    folder = folder or Scratch(spark, "token-index").folder
    return read_back(write_token_shards(docs, folder))
