"""Approximate nearest neighbours by cosine: stable projections in kd-trees, searched until a chi-square test stops.

Vectors of length one are projected to ``DIMS`` dimensions with normal (2-stable) weights. If two of them lie d apart, the square of their
projected distance divided by d**2 is chi-square distributed. So a query meets candidates in the order of their projected
distance and verifies each with the vectors themselves; once the distance r of the next ones is such that a vector nearer than the
k-th best so far would have come before r with probability ``CONFIDENCE``, it stops.

The first levels of the kd-tree are cuts at medians of a bounded sample (they decide where a row goes, never a result). A cell's rows are
ranked by id and cut into blocks of at most ``BLOCK``; a block is one row of the index, which holds its vectors and the rest of
the tree, a box for each node. Queries go out in lots of bounded size, as a broadcast, and vectors do not move: in a first pass over the index
a query searches its home block and the first block of its cell, in the second pass all other blocks whose boxes come as near as the test
allows for what it has found. Within a block leaves are taken by their distance, twice as many at each step.

Edge cases: vectors that are null, empty, all zero, or hold a null or a component that is not finite take no part; rows without an id take
none either; shorter vectors count as filled up with zeros; rows that repeat an id are candidates of their own, and as a query an id is asked
once, with its least vector by components; no row of a query's id is its candidate; ties go to the smaller id; with fewer
than k candidates the search finds all; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from quillspark.llm.arrow import bound_batches, groups, longs
from quillspark.llm.ranks import ranked
from quillspark.plans.scratch import Scratch

K = 5
DIMS = 10  # even, for the closed form of the distribution
CONFIDENCE = 0.95
BLOCK = 4096  # vectors of a block, at most
BLOCK_BYTES = 16 << 20
LEAF = 32  # vectors of a leaf, at least, where there are so many
CELLS = 256
SAMPLE = 16_384
SAMPLE_BYTES = 16 << 20
LOT_BYTES = 16 << 20  # of queries that are broadcast at once
AT_ONCE = 256  # queries that share a matrix of scores
NEAR = 1e-9  # far above rounding errors of scores and squared distances
INDEX = "block bigint, cell int, first boolean, n int, ids binary, vectors binary, lows binary, highs binary"
FOUND = "query_id bigint, vec_id bigint, score double, verified bigint"


def chi_square(x: float, dims: int = DIMS) -> float:
    """The probability that a chi-square variable of an even number of dimensions is at most x."""
    if x == math.inf:
        return 1.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def reach(confidence: float, dims: int = DIMS) -> float:
    """The x that a chi-square variable stays below with this probability."""
    if confidence >= 1:
        return math.inf
    low, high = 0.0, 1.0
    while chi_square(high, dims) < confidence:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < confidence else (low, middle)
    return high


def weights(width: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((width, DIMS))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; components keep their type if that is float, else they are doubles."""
    kind = "float" if isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), FloatType) else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & some).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = longs(lists.value_lengths())
    out = np.zeros((len(lengths), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Doubles, each row multiplied by a power of two so that no square is lost; cosines stay as they are."""
    vectors = vectors.astype(float)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _units(scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the lengths that they had."""
    lengths = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / lengths[:, None], lengths


def _median_cuts(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and threshold of the nodes of a full tree, in heap order from 1."""
    dims, cuts = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
    parts = {1: points}
    for node in range(1, 1 << depth):
        own = parts.pop(node)
        if len(own):
            dims[node] = (own.max(axis=0) - own.min(axis=0)).argmax()
            cuts[node] = np.median(own[:, dims[node]])
        right = own[:, dims[node]] >= cuts[node]
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return dims, cuts


def _cell(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.ones(len(points), dtype=np.int64)
    for _ in range(len(dims).bit_length() - 1):
        node = 2 * node + (points[np.arange(len(points)), dims[node]] >= cuts[node])
    return node - len(dims)


def _bounds(n: int) -> np.ndarray:
    """Where the leaves of a block of n rows begin; a power of two of them."""
    leaves = 1 << max(0, (n // LEAF).bit_length() - 1)
    return np.arange(leaves + 1) * n // leaves


def kd_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows by leaf, and the least and the largest coordinates of each node in heap order from 1."""
    bounds = _bounds(len(points))
    leaves = len(bounds) - 1
    order = np.arange(len(points))
    width = leaves
    while width > 1:
        for first in range(0, leaves, width):
            a, b, cut = bounds[first], bounds[first + width], bounds[first + width // 2]
            own = points[order[a:b]]
            by = own[:, (own.max(axis=0) - own.min(axis=0)).argmax()]
            order[a:b] = order[a:b][np.argpartition(by, cut - a)]
        width //= 2
    lows, highs = np.empty((2 * leaves, points.shape[1])), np.empty((2 * leaves, points.shape[1]))
    lows[leaves:], highs[leaves:] = np.minimum.reduceat(points[order], bounds[:-1]), np.maximum.reduceat(points[order], bounds[:-1])
    for node in range(leaves - 1, 0, -1):
        lows[node], highs[node] = np.minimum(lows[2 * node], lows[2 * node + 1]), np.maximum(highs[2 * node], highs[2 * node + 1])
    return order, lows, highs


class _Block:
    """One row of the index, and the search in it."""

    def __init__(self, row: dict, width: int, kind: str, projection: np.ndarray):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.scaled = _scaled(np.frombuffer(row["vectors"], dtype=kind).reshape(-1, width))
        self.units, self.lengths = _units(self.scaled)
        self.points = self.units @ projection
        self.lows, self.highs = (np.frombuffer(row[c], dtype=float).reshape(-1, DIMS) for c in ("lows", "highs"))
        self.bounds = _bounds(len(self.ids))

    def leaves(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, squared distance of its box) within each query's squared radius, by query and distance."""
        query, node = np.arange(len(points)), np.ones(len(points), dtype=np.int64)
        while True:
            gap = np.maximum(np.maximum(self.lows[node] - points[query], points[query] - self.highs[node]), 0)
            far = (gap * gap).sum(axis=1)
            near = far <= radius[query]
            query, node, far = query[near], node[near], far[near]
            if not len(node) or node[0] >= len(self.bounds) - 1:
                order = np.lexsort((far, query))
                return query[order], node[order] - (len(self.bounds) - 1), far[order]
            query, node = np.repeat(query, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))

    def search(self, asked: dict[str, np.ndarray], k: int, stop: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, ids, scores, candidates verified) for the queries that come this near."""
        bar = asked["bar"].copy()
        radius = self._radius(bar, stop)
        query, leaf, far = self.leaves(asked["points"], radius)
        if not len(query):
            return
        met = np.unique(query)
        row = np.searchsorted(met, query)
        turn = np.arange(len(query)) - np.searchsorted(query, query)
        scores = np.full((len(met), len(self.ids)), -np.inf)
        verified = np.zeros(len(met), dtype=np.int64)
        done, step = 0, 1
        while True:
            now = (turn >= done) & (turn < done + step) & (far <= radius[query])
            if not now.any():
                break
            for at in np.unique(leaf[now]):
                rows = row[now & (leaf == at)]
                part, own = slice(self.bounds[at], self.bounds[at + 1]), met[rows]
                gap = asked["points"][own][:, None, :] - self.points[part][None]
                wanted = ((gap * gap).sum(axis=2) <= radius[own, None]) & (self.ids[part] != asked["ids"][own, None])
                scores[rows, part] = np.where(wanted, asked["units"][own] @ self.units[part].T, -np.inf)
                verified[rows] += wanted.sum(axis=1)
            touched = np.unique(row[now])
            if len(self.ids) >= k:
                kth = np.partition(scores[touched], len(self.ids) - k, axis=1)[:, len(self.ids) - k]
                bar[met[touched]] = np.maximum(bar[met[touched]], kth)
                radius = self._radius(bar, stop)
            done, step = done + step, 2 * step
        for i, q in enumerate(met.tolist()):
            some = np.flatnonzero(scores[i] >= max(bar[q] - NEAR, -2))
            # Row by row in one order of summation, so that equal vectors have equal scores.
            exact = (self.scaled[some] * asked["scaled"][q]).sum(axis=1) / (asked["lengths"][q] * self.lengths[some])
            ids = self.ids[some]
            better = (exact > asked["bar"][q]) | (exact == asked["bar"][q]) & (ids < asked["bar_id"][q])
            best = np.lexsort((ids[better], -exact[better]))[:k]
            yield q, ids[better][best], exact[better][best], int(verified[i])

    @staticmethod
    def _radius(bar: np.ndarray, stop: float) -> np.ndarray:
        """Squared projected distance up to which a query goes on, from the cosine of its k-th best."""
        if stop == math.inf:
            return np.full(len(bar), math.inf)
        return np.where(np.isneginf(bar), math.inf, np.maximum(2 - 2 * np.where(np.isneginf(bar), 0, bar), 0) * stop + NEAR)


def build_index(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int, str]:
    """The index, one row for each block; the rows (vec_id, v, block, cell); the width of a vector and its type."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors)
    kind = "f4" if rows.schema["v"].dataType.elementType == FloatType() else "f8"
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    projection = weights(width)
    drawn = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("v").toArrow()["v"]
    size = max(LEAF, min(BLOCK, BLOCK_BYTES // (8 * width)))
    depth = max(0, min(CELLS, n // size).bit_length() - 1)
    cuts = _median_cuts(_units(_scaled(_matrix(drawn, width, kind)))[0] @ projection if len(drawn) else np.zeros((0, DIMS)), depth)
    shared = spark.sparkContext.broadcast((projection, cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found, (dims, at) = shared.value
                points = _units(_scaled(_matrix(b.column(1), width, kind)))[0] @ found
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_cell(points, dims, at).astype(np.int32))], names=["vec_id", "v", "cell"])

    placed = rows.mapInArrow(place, f"vec_id bigint, v {rows.schema['v'].dataType.simpleString()}, cell int")
    dealt = ranked(scratch.store(placed, "placed"), "cell", ["vec_id"], scratch, "ranked")
    dealt = dealt.withColumn("block", F.col("cell").cast("bigint") * (1 << 40) + F.expr(f"(rank - 1) div {size}")).drop("rank")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for t in groups(batches, ["block"]):
            found = shared.value[0]
            v = _matrix(t["v"], width, kind)
            order, lows, highs = kd_tree(_units(_scaled(v))[0] @ found)
            block, ids = t["block"][0].as_py(), longs(t["vec_id"].combine_chunks())
            row = [block, t["cell"][0].as_py(), block % (1 << 40) == 0, len(ids), ids[order].tobytes(), v[order].tobytes(), lows.tobytes(), highs.tobytes()]
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind_) for x, kind_ in zip(row, types, strict=True)], names=names)

    # A block that lies in two splits of a file becomes two; any cut of the rows gives the same results.
    dealt.select("vec_id", "v", "cell", "block").mapInArrow(make, INDEX).write.mode("overwrite").option("parquet.block.size", 2 * BLOCK_BYTES).parquet(scratch.path("index"))
    scratch.drop("placed")
    return spark.read.schema(INDEX).parquet(scratch.path("index")), dealt, width, kind


def _pass(index: DataFrame, asked: pa.Table, width: int, kind: str, k: int, confidence: float, home: bool) -> DataFrame:
    """What a lot of queries finds in the blocks of its first or its second pass; a row without a query counts what the task verified."""
    projection, stop = weights(width), reach(confidence)
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = shared.value
        scaled = _scaled(_matrix(lot["v"], width, kind)) if lot.num_rows else np.zeros((0, width))
        units, lengths = _units(scaled)
        every = {"scaled": scaled, "units": units, "lengths": lengths, "points": units @ projection} | {c: lot[c].to_numpy() for c in ("ids", "block", "cell", "bar", "bar_id")}
        count = 0
        for b in batches:
            for row in b.to_pylist():
                near = (every["block"] == row["block"]) | ((every["cell"] == row["cell"]) & row["first"])
                chosen = np.flatnonzero(near == home)
                if not len(chosen):
                    continue
                block = _Block(row, width, kind, projection)
                out: list[tuple[int, int, float]] = []
                for first in range(0, len(chosen), AT_ONCE):
                    part = {c: x[chosen[first : first + AT_ONCE]] for c, x in every.items()}
                    for q, ids, scores, verified in block.search(part, k, stop):
                        out += [(int(part["ids"][q]), i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
                        count += verified
                if out:
                    yield _found(out)
        yield _found([(None, None, None)], count)

    return index.mapInArrow(find, FOUND)


def _found(rows: list[tuple], verified: int = 0) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([verified] * len(rows), pa.int64())], names=["query_id", "vec_id", "score", "verified"])


def nearest(vectors: DataFrame, is_query: Column, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score, verified_share): the k nearest by cosine that are found for each row of which ``is_query`` (of vec_id) holds.

    ``verified_share`` is that of all pairs of a query and a vector that were verified; with a confidence of 1 it is 1 and the search is exact.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    index, rows, width, kind = build_index(vectors, scratch)
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("ids")).agg(F.min(F.struct("v", "block", "cell")).alias("m")).select("ids", "m.v", "m.block", "m.cell")
    queries = scratch.store(queries, "queries")
    n, total = queries.count(), index.agg(F.sum("n")).first()[0] or 0
    lots = max(1, -(-n * 8 * width // LOT_BYTES))
    found = None
    for lot in range(lots):
        own = queries.where(F.pmod(F.xxhash64("ids"), F.lit(lots)) == lot)
        asked = own.toArrow()
        open_ = asked.append_column("bar", pa.array(np.full(len(asked), -np.inf))).append_column("bar_id", pa.array(np.zeros(len(asked), dtype=np.int64)))
        first = scratch.store(_pass(index, open_, width, kind, k, confidence, True), f"home{lot}")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        kth = first.where("query_id is not null").withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "score", "vec_id").toArrow()
        bars = dict(zip(kth["query_id"].to_pylist(), zip(kth["score"].to_pylist(), kth["vec_id"].to_pylist(), strict=True), strict=True))
        known = [bars.get(q, (-math.inf, 0)) for q in asked["ids"].to_pylist()]
        barred = asked.append_column("bar", pa.array([b for b, _ in known], pa.float64())).append_column("bar_id", pa.array([i for _, i in known], pa.int64()))
        rest = scratch.store(_pass(index, barred, width, kind, k, confidence, False), f"rest{lot}")
        found = first.unionByName(rest) if found is None else found.unionByName(first).unionByName(rest)
    share = (found.agg(F.sum("verified")).first()[0] or 0) / max(1, n * total)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.where("query_id is not null").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    out = scratch.store(best.select("query_id", "rank", "vec_id", "score", F.lit(share).alias("verified_share")), "result")
    scratch.drop("ranked", "index", "queries", *[f"{p}{lot}" for p in ("home", "rest") for lot in range(lots)])
    return out


def recall(vectors: DataFrame, is_query: Column, k: int = K, confidence: float = CONFIDENCE) -> float:
    """The share of the exact answers, from a search that verifies everything, that a search finds; 1 without any."""
    exact, found = (nearest(vectors, is_query, k, c).select("query_id", "vec_id").distinct() for c in (1.0, confidence))
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / max(1, exact.count()) if not exact.isEmpty() else 1.0
