"""Near-duplicate detection: MinHash bands, sequential Bayesian pruning, exact verification, components.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes) and a MinHash signature of 16 bits a value,
   kept as a sketch of the low bytes and one of the high bytes. Both give the bucket key of each band. Texts with equal sets form one class, represented by its
   least doc_id; only representatives go on.
2. In each bucket every member is paired with the one of the least id: a bucket gives one pair less than it has members,
   however many copies it holds, and the buckets of a group mostly give the same pairs.
3. A pair is compared batch by batch of its sketches. With a uniform prior, m matches among n give a Beta posterior;
   the pair is dropped as soon as the posterior chance of reaching the threshold falls below ``MISS``. Survivors are
   confirmed on their full shingle sets, and links are joined to components.
4. Only buckets that still hold several components go on. Members of the bucket's largest component meet all others
   there, and these meet each other, in cells bounded by members and by shingles, again first by sketches. A cell with
   few surviving pairs gives these; a cell with more of them than
   ``SPARSE`` a member (a large group of copies that are unlike each other) gives its members, which are then compared
   within the cell by full sets. Either way a pair is confirmed exactly, and only pairs of different components count.

Texts are read again only for documents in surviving pairs, which a Bloom filter of bounded size finds before the exact
join. Hot keys (the buckets and the leader of a very large group) are told apart by their counts and never meet in one task.

With 32 bands of 4 rows two texts at similarity 0.75 share no bucket with probability 5e-6.

Edge cases: null, empty and blank texts have no shingles and link with nothing; texts of under five words are one
shingle; rows with a null doc_id keep their own row, have a null component and are kept; rows that share a doc_id are
one node with the links of all their texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.arrow import bound_batches, groups, lean, longs, slices
from quillspark.llm.bloom import may_hold
from quillspark.llm.shingle_hash import mix, shingle_set, word_hashes
from quillspark.operators.graph import connected_components
from quillspark.operators.skew import least_hot, lookup, salted
from quillspark.plans.scratch import Scratch

WORDS = 5
THRESHOLD = (75, 100)  # similarity at least 75 / 100, held in integers
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32  # signature values compared at a time
MISS = 1e-9  # chance at which a pair that reaches the threshold may be pruned
CELL = 1024  # members of a bucket that one task compares with as many others
CELL_SHINGLES = 1 << 20  # about so many shingles of such members at most
SPARSE = 4  # surviving pairs a member up to which a cell gives pairs
LARGEST = 1 << 30  # added to a part's number for members of a bucket's largest component
PAIR = "src bigint, dst bigint"


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


_XOR, _TIMES = _hash_family(HASHES)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set of shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[i : i + 2048] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1), out=out)
    return out


def band_keys() -> Column:
    """Bucket keys of a signature, one for each band, from the sketches of its low and high bytes."""

    def part(sketch: str, band: int) -> Column:
        return F.substring(sketch, band * ROWS + 1, ROWS)

    return F.array(*[F.xxhash64(F.lit(band), part("sketch", band), part("high", band)) for band in range(BANDS)])


def _as_signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for start, end in slices(texts):
            sizes, one, two, low, high = [], [], [], [], []
            hashes, edges = word_hashes(texts[start:end])
            for i in range(end - start):
                s = shingle_set(hashes[edges[i] : edges[i + 1]], WORDS)
                sizes.append(len(s))
                one.append(_as_signed(int(s.sum(dtype=np.uint64))))
                two.append(_as_signed(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))))
                if len(s):
                    signature = minhash(s)
                    low.append(signature.astype(np.uint8).tobytes())
                    high.append((signature >> np.uint32(8)).astype(np.uint8).tobytes())
                else:
                    low.append(None)
                    high.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, end - start), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(low, pa.binary()), pa.array(high, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sketch", "high"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sketch, high) of each row; (n_shingles, set_a, set_b) tells its shingle set."""
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(lean(_sign), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary, high binary")


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    hashes, edges = word_hashes(texts)
    return [shingle_set(hashes[edges[i] : edges[i + 1]], WORDS) for i in range(len(texts))]


@lru_cache(maxsize=64)
def least_matches(n: int, miss: float = MISS) -> int:
    """The fewest matches among ``n`` bytes that keep a pair: with fewer, P(similarity >= threshold | matches) < miss.

    Bytes of unequal values match by chance once in 256. Under a uniform prior of the chance of a match the posterior
    is Beta(m + 1, n - m + 1); its upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    t, tail = t + (1 - t) / 256, 0.0
    for m in range(n + 2):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _survive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signature rows are left after all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for seen in range(BATCH, HASHES + 1, BATCH):
        matches[alive] += (a[alive, seen - BATCH : seen] == b[alive, seen - BATCH : seen]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(seen)]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def linked(shared: int, size_a: int, size_b: int) -> bool:
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (size_a + size_b - shared)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = _survive(_matrix(batch.column(2)), _matrix(batch.column(3)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["src", "dst"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are linked by a text of each; ids that have several texts come with all pairs of them."""
    for batch in batches:
        src, dst = longs(batch.column(0)), longs(batch.column(1))
        keep, last, one = np.zeros(len(src), dtype=bool), None, None
        for i in range(len(src)):
            # Pairs of one leader follow one another; its rows may have different texts.
            text = batch.column(2)[i].as_py()
            if last != (src[i], text):
                last, one = (src[i], text), sets_of([text])[0]
            other = sets_of([batch.column(3)[i].as_py()])[0]
            keep[i] = linked(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other))
        yield pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep])], names=["src", "dst"])


def _both_sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(src, dst, value of src, value of dst)."""
    one = values.select(F.col("doc_id").alias("src"), F.col(column).alias("_a"))
    two = values.select(F.col("doc_id").alias("dst"), F.col(column).alias("_b"))
    # A leader is the source of all pairs of its buckets; they are counted before values are joined to them.
    return salted(pairs, one, "src", pairs.count(), "dst").join(two, "dst").select("src", "dst", "_a", "_b")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each cell with its members' components, and which pairs of rows are to be compared there (upper triangle)."""
    for cell in groups(batches, ["key", "cell"]):
        part, comp = longs(cell.column("part").combine_chunks()), longs(cell.column("comp").combine_chunks())
        whole = cell.column("cell")[0].as_py() % (1 << 32) == cell.column("cell")[0].as_py() >> 32
        differ = np.triu(comp[:, None] != comp[None, :], 1)
        if not whole:
            differ &= part[:, None] != part[None, :]
        yield cell, comp, differ


def _prune_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sketches leave of each cell: pairs (doc_id, other), or if these are many, the members that have partners."""
    for cell, _, differ in _cells(batches):
        sketch = _matrix(cell.column("sketch"))
        one, two = [], []
        for i in range(cell.num_rows):
            others = np.flatnonzero(differ[i])
            if len(others):
                hit = others[_survive(np.broadcast_to(sketch[i], (len(others), HASHES)), sketch[others])]
                one.append(np.full(len(hit), i))
                two.append(hit)
        first, second = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (one, two))
        if not len(first):
            continue
        sparse = len(first) <= SPARSE * cell.num_rows
        rows = first if sparse else np.unique(np.concatenate([first, second]))
        out = cell.select(["key", "cell", "part", "doc_id", "comp"]).take(pa.array(rows)).combine_chunks()
        other = cell.column("doc_id").take(pa.array(second)).combine_chunks() if sparse else pa.nulls(len(rows), pa.int64())
        yield from out.append_column("other", other).combine_chunks().to_batches()


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components in each cell, by full sets; a link is given only if it joins what was apart there."""
    for cell, comp, differ in _cells(batches):
        ids = longs(cell.column("doc_id").combine_chunks())
        sets = sets_of(cell.column("text").to_pylist())
        size = np.array([len(s) for s in sets])
        # A shingle that no other member has is in no intersection: what is left bounds every similarity.
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = count[place] > 1
        common = np.bincount(owner[shared], minlength=len(sets))
        sets = [s[shared[e - n : e]] for s, n, e in zip(sets, size, np.cumsum(size), strict=True)]
        root = {c: c for c in comp.tolist()}

        def find(x: int, root: dict[int, int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        src, dst = [], []
        for i in range(len(sets)):
            most = np.minimum(common[i], common)
            for j in np.flatnonzero(differ[i] & (THRESHOLD[1] * most >= THRESHOLD[0] * (size[i] + size - most))).tolist():
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a != b and linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), int(size[i]), int(size[j])):
                    root[a] = b
                    src.append(int(ids[i]))
                    dst.append(int(ids[j]))
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _dealt(members: DataFrame) -> DataFrame:
    """Rows of one cell together and in sequence."""
    return members.repartition("key", "cell").sortWithinPartitions("key", "cell")


def _in_buckets(bands: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """The rows of ``bands`` whose bucket has several members, with its leader; hot buckets are a bounded broadcast."""
    least = least_hot(total)
    hot = F.broadcast(buckets.where(F.col("n") >= least))
    cold = bands.join(hot.select("key"), "key", "left_anti").join(buckets.where(F.col("n") < least), "key")
    return bands.join(hot, "key").unionByName(cold)


def _dealt_to_cells(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, cell, part, doc_id, comp): each member of a mixed bucket once for each cell that it is compared in."""
    shares = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("n", "size", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("comps")).where("comps > 1")

    def parts(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / CELL), F.ceil(size / CELL_SHINGLES)).cast("bigint")

    ours, others = parts(F.col("top.n"), F.col("top.size")), parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))
    mixed = scratch.store(mixed.select("key", F.col("top.comp").alias("largest"), ours.alias("ours"), others.alias("others")), "mixed")
    rows = lookup(labelled, mixed, "key", labelled.count())
    in_largest = F.col("comp") == F.col("largest")
    part = F.pmod(F.xxhash64("doc_id"), F.when(in_largest, F.col("ours")).otherwise(F.col("others"))) + F.when(in_largest, LARGEST).otherwise(0)
    rows = rows.select("key", "doc_id", "comp", "ours", "others", in_largest.alias("in_largest"), part.cast("bigint").alias("part"))
    all_others = F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)
    all_ours = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("ours") - 1), lambda o: o + LARGEST)
    met = F.when(F.col("in_largest"), all_others).otherwise(F.concat(all_others, all_ours))
    cell = F.explode(F.transform(met, lambda o: F.shiftleft(F.least(o, F.col("part")), 32) + F.greatest(o, F.col("part"))))
    return rows.select("key", "doc_id", "comp", "part", cell.alias("cell"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``; kept rows are the least of their component."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "near-dup")
    signed = scratch.store(signatures(docs), "signed")
    sets = ["n_shingles", "set_a", "set_b"]
    # Texts with equal sets have equal signatures, so any row of a class can give them.
    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy(*sets)
    nodes = classes.agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("high").alias("high"))
    nodes = scratch.store(nodes.select("doc_id", "n_shingles", "sketch", "high"), "nodes")
    signed = scratch.store(signed.select("doc_id", *sets), "sets")
    scratch.drop("signed")

    bands = nodes.select("doc_id", "n_shingles", F.explode(band_keys()).alias("key"))
    total = nodes.count() * BANDS
    buckets = scratch.store(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1"), "buckets")
    members = scratch.store(_in_buckets(bands, buckets, total), "members")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = nodes.select("doc_id", "sketch")

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """The texts of some documents."""
        wanted = scratch.store(ids.distinct(), f"wanted-{name}")
        return texts.where(may_hold(wanted, F.col("doc_id"))).join(wanted, "doc_id", "left_semi")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the likely pairs that are links."""
        known = scratch.store(texts_of(pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")), name), "known")
        links = scratch.store(_both_sides(pairs, known, "text").mapInArrow(lean(_confirm), PAIR), name)
        scratch.drop("known")
        return links

    tried = scratch.store(members.where("doc_id <> leader").select(F.least("doc_id", "leader").alias("src"), F.greatest("doc_id", "leader").alias("dst")).distinct(), "tried")
    likely = scratch.store(_both_sides(tried, sketches, "sketch").mapInArrow(lean(_compare), PAIR), "likely")
    links = confirmed(likely, "links")
    labels = scratch.store(connected_components(links), "labels")

    # Buckets that hold several components still; cells of at most CELL members from each of two parts of a bucket.
    labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("comp"))
    labelled = scratch.store(labelled, "labelled")
    rest = _dealt_to_cells(labelled, scratch)
    schema = "key bigint, cell bigint, part bigint, doc_id bigint, comp bigint, other bigint"
    left = scratch.store(_dealt(rest.join(sketches, "doc_id")).mapInArrow(lean(_prune_cells), schema), "left")
    scratch.drop("members", "labelled", "nodes")
    pairs = left.where("other is not null").select(F.least("doc_id", "other").alias("src"), F.greatest("doc_id", "other").alias("dst")).distinct()
    pairs = scratch.store(pairs.join(tried, ["src", "dst"], "left_anti"), "pairs")
    few = confirmed(pairs, "few")
    dense = left.where("other is null").drop("other")
    dense_texts = texts_of(dense.select("doc_id"), "dense")
    many = scratch.store(_dealt(dense.join(dense_texts, "doc_id")).mapInArrow(lean(_link_cells), PAIR), "many")
    scratch.drop("left", "pairs", "tried", "likely")

    some = signed.where("doc_id is not null and n_shingles > 0")
    least = some.groupBy(*sets).agg(F.min("doc_id").alias("least"))
    # Rows that share an id are one node, which links the classes of their texts.
    spread = [f(c).alias(f"{name}_{c}") for c in sets for name, f in (("lo", F.min), ("hi", F.max))]
    several = some.groupBy("doc_id").agg(*spread).where(" or ".join(f"lo_{c} <> hi_{c}" for c in sets)).select("doc_id")
    shared = some.join(several, "doc_id", "left_semi").join(least, sets).where("doc_id <> least").select(F.col("least").alias("src"), F.col("doc_id").alias("dst"))
    shared = scratch.store(shared.distinct(), "shared")
    final = connected_components(links.union(few).union(many).union(shared)).select(F.col("node").alias("least"), "component")
    found = least.join(final, "least", "left").select(*sets, F.coalesce("component", "least").alias("component"))
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    # A class of very many copies is a hot key.
    rows = signed.select("doc_id", F.struct(*sets).alias("class"))
    out = lookup(rows, found.select(F.struct(*sets).alias("class"), "component"), "class", rows.count(), "left").select("doc_id", F.col("class.n_shingles").alias("n_shingles"), "component")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    out = scratch.store(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop("sets", "buckets", "mixed", "links", "labels", "few", "many", "shared", *[f"wanted-{x}" for x in ("links", "few", "dense")])
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; rows that share an id stay or go together.

    Rows that the Bloom filter of the dropped ids does not hold stay as they are; only the others are shuffled.
    """
    dropped = Scratch(docs.sparkSession, "dropped").store(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct(), "ids")
    likely = may_hold(dropped, docs["doc_id"].cast("bigint"))
    return docs.where(~likely).unionByName(docs.where(likely).join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti"))
