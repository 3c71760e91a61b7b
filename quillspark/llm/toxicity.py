"""A convolutional text classifier trained in numpy, with decision thresholds calibrated by language.

A word's vector is the sum of two hashed embeddings: of the whole word and of its first four bytes, so that rare forms of
a stem share what is known of it. Filters of width 1, 2 and 3 run over the whole text; each is rectified and its
largest value taken over all positions; a logistic layer scores these maxima. Gradients flow to the positions of the
maxima only, so a step touches few rows of the tables. Labelled documents are dealt to ``FOLDS`` parts; each member of the classifier is
fitted on all parts but one, and a document's score is that of the members' mean. Every labelled row has a score
of the member that has not seen it. On these a logistic fit, with the classes weighted as they stand among the labels,
gives the scale, moved so that 0.7 (``CUTOFF``) is the cut of the best F1. Each language's own cut is taken in the same way and drawn to
the common one with the weight of ``PRIOR`` rows, so that a language of few labelled rows stays near it.

Every labelled row is learned from, with all of its text. Members start from a bounded set of rows that they see ``EPOCHS`` times: at most ``SAMPLE``
documents of each class, chosen by hash, one text an id (its longest), of at most ``DOC_WORDS`` words each and ``SAMPLE_WORDS`` in all, half of them
for each class. From there each of at most ``SHARDS`` tasks takes all members once over its share of all labelled rows, and what the tasks come to is averaged by rows.
Scale and thresholds come from counts of all labelled rows by language, class and score, in steps of ``STEP`` of the raw score. Labels are learned only from
rows with crc32(doc_id as text) % 3 <> 1; a language or source is never an input of a score. The threshold of a language decides only what is rejected.

Edge cases: null and empty texts score as texts without words; a null doc_id is never labelled and not held out; labels
that contradict each other count as toxic; without labels of both classes all scores are the share of toxic labels (0
if there are none); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.arrow import bound_batches, lean, longs, release, slices
from quillspark.llm.bloom import filter_of, passes, places_of
from quillspark.llm.shingle_hash import MARKS, Words
from quillspark.plans.scratch import Scratch

BUCKETS = 1 << 15
STEM_BYTES = 4
SIZE = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
SAMPLE = 2500
SAMPLE_WORDS = 4_000_000
DOC_WORDS = 20_000  # words of a document to start from
SHARDS = 24  # tasks that learn from all rows, each with members of its own
SHARD_ROWS = 4096  # and the rows of one, where there are fewer than SHARDS times as many
PIECE = 1 << 16  # parameters that are averaged in one group
STEP = 1 / 256
EPOCHS = 8
BATCH = 32
RATE = 0.08
CUTOFF = 0.7
FOLDS = 4
PRIOR = 25  # rows of the rarer class that weigh as much for a language's cut as the common one does
SCORES = "doc_id bigint, lang string, score double"

Coded = list[tuple[np.ndarray, np.ndarray]]  # by document, its words and its stems


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of their stems, and where each text's words begin (one more at the end)."""
    words = Words(texts, MARKS)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (words.hashes() >> shift).astype(np.int32), (words.hashes(STEM_BYTES) >> shift).astype(np.int32), words.edges


@dataclass
class TextCnn:
    """Hashed embeddings, filters, and a logistic layer."""

    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    bias: np.ndarray  # of all filters
    weights: np.ndarray
    offset: float = 0.0
    sums: dict | None = None  # of squared gradients, while it learns

    @classmethod
    def new(cls, seed: int = 5) -> TextCnn:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        return cls(normal(BUCKETS, SIZE, by=0.1), normal(BUCKETS, SIZE, by=0.1), [normal(w, SIZE, FILTERS, by=(2 / (w * SIZE)) ** 0.5) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), normal(FILTERS * len(WIDTHS), by=0.3))

    def maxima(self, words: np.ndarray, stems: np.ndarray, edges: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Of each text and filter the rectified maximum, and where it stands (-1: none above zero)."""
        n, widest = len(edges) - 1, max(WIDTHS)
        out = np.zeros((n, FILTERS * len(WIDTHS)), dtype=np.float32)
        at = np.full(out.shape, -1, dtype=np.int64) if places else None
        some = np.flatnonzero(np.diff(edges))
        if not len(some):
            return out, at
        x = np.zeros((len(words) + widest, SIZE), dtype=np.float32)
        x[: len(words)] = self.words[words] + self.stems[stems]
        owner_end = np.repeat(edges[1:][some], np.diff(edges)[some])
        position = np.arange(len(words))
        for k, w in enumerate(WIDTHS):
            z = x[: len(words)] @ self.filters[k][0]
            for j in range(1, w):
                part = x[j : len(words) + j] @ self.filters[k][j]
                part[position + j >= owner_end] = 0  # words of the next text
                z += part
            z += self.bias[k * FILTERS : (k + 1) * FILTERS]
            best = np.maximum.reduceat(z, edges[:-1][some], axis=0)
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            out[some, columns] = np.maximum(best, 0)
            if places:
                for i, t in enumerate(some):
                    where = z[edges[t] : edges[t + 1]].argmax(axis=0) + edges[t]
                    at[t, columns] = np.where(best[i] > 0, where, -1)
        return out, at

    def raw(self, words: np.ndarray, stems: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return self.maxima(words, stems, edges)[0] @ self.weights + self.offset

    def fit(self, docs: Coded, toxic: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 6) -> None:
        """Adagrad on the logistic loss, each class with half of the weight."""
        rng = np.random.default_rng(seed)
        share = class_weights(toxic, (toxic == 0).sum(), (toxic == 1).sum())
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
                self.step([docs[i] for i in batch], toxic[batch], share[batch], rate)

    def step(self, docs: Coded, toxic: np.ndarray, share: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad on some documents, ``share`` being their weights."""
        if self.sums is None:
            self.sums = {k: np.full_like(getattr(self, k), 1e-6) for k in ("words", "stems", "bias", "weights")} | {"filters": [np.full_like(f, 1e-6) for f in self.filters], "offset": 1e-6}
        sums = self.sums
        words, stems = (np.concatenate([d[s] for d in docs]) for s in (0, 1))
        edges = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
        best, at = self.maxima(words, stems, edges, places=True)
        error = ((_sigmoid(best @ self.weights + self.offset) - toxic) * share / len(docs)).astype(np.float32)
        back = error[:, None] * self.weights * (at >= 0)
        steps = {"weights": best.T @ error, "bias": back.sum(axis=0)}
        rows, grads = [], []
        for k, w in enumerate(WIDTHS):
            text, column = np.nonzero(back[:, k * FILTERS : (k + 1) * FILTERS])
            gradient = back[text, k * FILTERS + column]
            place, end = at[text, k * FILTERS + column], edges[text + 1]
            change = np.zeros_like(self.filters[k])
            for j in range(w):
                inside = place + j < end
                row, col, g = place[inside] + j, column[inside], gradient[inside, None]
                np.add.at(change[j].T, col, g * (self.words[words[row]] + self.stems[stems[row]]))
                rows.append(row)
                grads.append(g * self.filters[k][j].T[col])
            sums["filters"][k] += change**2
            self.filters[k] -= rate * change / np.sqrt(sums["filters"][k])
        row, grad = np.concatenate(rows), np.concatenate(grads)
        for name, ids in (("words", words), ("stems", stems)):
            unique, inverse = np.unique(ids[row], return_inverse=True)
            total = np.zeros((len(unique), SIZE), dtype=np.float32)
            np.add.at(total, inverse, grad)
            square = total**2
            sums[name][unique] += square if sums[name].shape[1] > 1 else square.mean(axis=1, keepdims=True)
            getattr(self, name)[unique] -= rate * total / np.sqrt(sums[name][unique])
        for name, g in steps.items():
            sums[name] += g**2
            getattr(self, name).__isub__(rate * g / np.sqrt(sums[name]))
        sums["offset"] += float(error.sum()) ** 2
        self.offset -= rate * float(error.sum()) / sums["offset"] ** 0.5

    def by_row(self) -> None:
        """From here on a bucket's vector has one sum, its components' mean, so that a member in learning is little larger than one that has learned."""
        if self.sums:
            self.sums |= {k: self.sums[k].mean(axis=1, keepdims=True) for k in ("words", "stems")}

    def vector(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([*(p.ravel() for p in (self.words, self.stems, *self.filters, self.bias, self.weights)), np.array([self.offset], np.float32)])

    @classmethod
    def of_vector(cls, values: np.ndarray) -> TextCnn:
        """The model of these parameters."""
        out, at = cls.new(), 0
        for p in (out.words, out.stems, *out.filters, out.bias, out.weights):
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        out.offset = float(values[at])
        return out


@dataclass
class Classifier:
    """The members' mean on the common scale, and the languages' thresholds."""

    members: list[TextCnn] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        coded = word_ids(texts)
        raw = sum(m.raw(*coded).astype(float) for m in self.members) / len(self.members)
        return _sigmoid(raw * self.scale[0] + self.scale[1])

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", CUTOFF)


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def class_weights(toxic: np.ndarray, zeros: int, ones: int) -> np.ndarray:
    """Weights of rows, one on average, with half of the weight for each class of so many rows."""
    return np.where(toxic == 1, 0.5 / max(1, ones), 0.5 / max(1, zeros)) * (zeros + ones)


def _platt(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit; targets are drawn in a little, so that separable scores stay finite."""
    ones, zeros, weight = count[toxic == 1].sum(), count[toxic == 0].sum(), weight * count
    target = np.where(toxic == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    spread = float(np.average((raw - np.average(raw, weights=count)) ** 2, weights=count)) ** 0.5 or 1.0
    x = np.stack([raw / spread, np.ones_like(raw)], axis=1)
    theta = np.zeros(2)
    for _ in range(60):
        p = _sigmoid(x @ theta)
        gradient = x.T @ (weight * (p - target)) + 1e-3 * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.linalg.solve(hessian, gradient)
    return float(theta[0] / spread), float(theta[1])


def _cut(scores: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> float:
    """The threshold of the best F1, in the middle of the gap where it lies."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum((toxic * count)[order])
    f1 = 2 * hits / (np.cumsum(count[order]) + (toxic * count).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no cut within equal scores
    best = int(f1.argmax())
    low = s[best + 1] if best + 1 < len(s) else s[best] / 2
    return float((s[best] + low) / 2)


def deal(toxic: np.ndarray) -> np.ndarray:
    """The part of each row; both classes are dealt evenly."""
    fold = np.zeros(len(toxic), dtype=np.int64)
    for c in (0, 1):
        fold[toxic == c] = np.arange((toxic == c).sum()) % min(FOLDS, (toxic == 1).sum(), (toxic == 0).sum())
    return fold


def fit_member(coded: Coded, toxic: np.ndarray, fold: np.ndarray, k: int) -> TextCnn:
    """A member fitted on all parts but one."""
    member, seen = TextCnn.new(5 + k), np.flatnonzero(fold != k)
    member.fit([coded[i] for i in seen], toxic[seen], seed=6 + k)
    member.by_row()
    return member


def calibrate(members: list[TextCnn], raw: np.ndarray, toxic: np.ndarray, langs: np.ndarray, share: float, count: np.ndarray | None = None) -> Classifier:
    """Scale and thresholds from the rows' scores by the member that has not seen them; ``count`` are the rows of each (raw, toxic, lang)."""
    model, count = Classifier(members), np.ones(len(raw)) if count is None else count
    ones, zeros = count[toxic == 1].sum(), count[toxic == 0].sum()
    weight = np.where(toxic == 1, share / max(1, ones), (1 - share) / max(1, zeros)) * count.sum()
    slope, offset = _platt(raw, toxic, weight, count)
    offset += _logit(CUTOFF) - _logit(_cut(_sigmoid(raw * slope + offset), toxic, count))
    model.scale = slope, offset
    scores = _sigmoid(raw * slope + offset)
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        n = min((toxic * count)[own].sum(), ((1 - toxic) * count)[own].sum())
        if n:  # without rows of both classes there is no cut of its own, and the weight is all on the common one
            model.thresholds[lang] = float(_sigmoid((n * _logit(_cut(scores[own], toxic[own], count[own])) + PRIOR * _logit(CUTOFF)) / (n + PRIOR)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the ids whose labels may be learned."""
    rows = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    return rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.when(F.max("toxic").cast("int") > 0, 1).otherwise(0).alias("toxic"))


def code(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, lang, n, ids, toxic) of every row that has a label: its number of words, and their and their stems' buckets, two bytes each."""

    held, size = filter_of(labelled.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(passes(held.value, b.column(3), b.column(4)))
            texts = b.column(2).to_pylist()
            for start, stop in slices(texts):
                words, stems, edges = word_ids(texts[start:stop])
                packed = [np.stack([words[edges[i] : edges[i + 1]], stems[edges[i] : edges[i + 1]]]).astype(np.uint16).tobytes() for i in range(stop - start)]
                part = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(edges), pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "lang", "n", "ids"])

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Only rows that the filter passes are coded and meet the exact join, by which texts do not move.
    placed = columns.where("doc_id is not null").select("*", *[p.alias(f"place{i}") for i, p in enumerate(places_of(F.col("doc_id"), size))])
    return placed.mapInArrow(lean(run), "doc_id bigint, lang string, n bigint, ids binary").join(labelled, "doc_id")


def _decoded(ids: list[bytes]) -> Coded:
    return [tuple(np.frombuffer(x, dtype=np.uint16).reshape(2, -1).astype(np.int32)) for x in ids]


def first_rows(coded: DataFrame, labelled: DataFrame) -> list:
    """The bounded rows (place, doc_id, toxic, ids) that members start from, in order."""
    drawn = [labelled.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id") for c in (0, 1)]
    # One row for each id, so at most SAMPLE of a class; the words are summed without the texts' ids.
    some = coded.where(F.col("n") <= DOC_WORDS).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id", "left_semi")
    scratch = Scratch(coded.sparkSession, "toxicity-start")
    single = scratch.store(some.groupBy("doc_id", "toxic").agg(F.max(F.struct("n", "ids")).alias("m")).select("doc_id", F.xxhash64("doc_id").alias("place"), "toxic", "m.*"), "single")
    so_far = F.sum("n").over(Window.partitionBy("toxic").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = single.select("doc_id", "toxic", "place", "n").withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_WORDS // 2).select("doc_id")
    rows = single.join(F.broadcast(kept), "doc_id", "left_semi").select("place", "doc_id", "toxic", "ids").collect()
    scratch.close()
    return sorted(rows, key=lambda r: (r.place, r.doc_id))


def parts_of(doc_ids: np.ndarray, dealt: dict[int, int], folds: int) -> np.ndarray:
    """The part of each document: that of the rows to start from, else by its id's hash."""
    spread = (doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.array([dealt.get(d, int(h)) for d, h in zip(doc_ids.tolist(), spread % np.uint64(folds), strict=True)], dtype=np.int64)


def learn_all(coded: DataFrame, members: list[TextCnn], dealt: dict[int, int], zeros: int, ones: int) -> list[TextCnn]:
    """The members after all labelled rows: each task takes them over its rows, and the results' means by rows are taken piece by piece."""
    shards, shared = min(SHARDS, -(-(zeros + ones) // SHARD_ROWS)), coded.sparkSession.sparkContext.broadcast((members, dealt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, shard = copy.deepcopy(shared.value[0]), [0] * len(shared.value[0]), TaskContext.get().partitionId()
        for b in batches:
            toxic, part = longs(b.column(1)), parts_of(longs(b.column(0)), shared.value[1], len(own))
            share = class_weights(toxic, zeros, ones)
            for start in range(0, b.num_rows, BATCH):
                rows = np.arange(start, min(start + BATCH, b.num_rows))
                docs = _decoded(b.column(2).slice(start, len(rows)).to_pylist())
                for k, member in enumerate(own):
                    at = np.flatnonzero(part[rows] != k)
                    if len(at):
                        seen[k] += len(at)
                        member.step([docs[i] for i in at], toxic[rows[at]], share[rows[at]])
        for k, member in enumerate(own):
            values = member.vector()
            for at in range(0, len(values) if seen[k] else 0, PIECE):
                yield pa.RecordBatch.from_pydict({"fold": [k], "piece": [at // PIECE], "shard": [shard], "n": [seen[k]], "v": [values[at : at + PIECE].tobytes()]})

    def mean(table: pa.Table) -> pa.Table:
        order = np.argsort(table["shard"].to_numpy())
        n, total = table["n"].to_numpy().astype(float), 0.0
        for i in order.tolist():
            total = total + np.frombuffer(table["v"][i].as_py(), dtype=np.float32) * (n[i] / n.sum())
        return pa.table({"fold": table["fold"].slice(0, 1), "piece": table["piece"].slice(0, 1), "v": pa.array([np.asarray(total, np.float32).tobytes()], pa.binary())})

    # In order of a hash, so that rows of one kind do not follow one another.
    rows = coded.select("doc_id", "toxic", "ids").coalesce(shards).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "ids")
    moved = rows.mapInArrow(lean(run), "fold bigint, piece bigint, shard bigint, n bigint, v binary")
    pieces = moved.groupBy("fold", "piece").applyInArrow(mean, "fold bigint, piece bigint, v binary").collect()
    shared.destroy()
    out = list(members)
    for k in {r.fold for r in pieces}:
        out[k] = TextCnn.of_vector(np.concatenate([np.frombuffer(r.v, dtype=np.float32) for r in sorted((r for r in pieces if r.fold == k), key=lambda r: r.piece)]))
    return out


def score_counts(coded: DataFrame, members: list[TextCnn], dealt: dict[int, int]) -> DataFrame:
    """(lang, toxic, raw, n): all labelled rows by language, class and the raw score, in steps, of the member that has not seen them."""
    shared = coded.sparkSession.sparkContext.broadcast((members, dealt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, raw = parts_of(longs(b.column(0)), shared.value[1], len(shared.value[0])), np.zeros(b.num_rows)
            docs = _decoded(b.column(3).to_pylist())
            for k, member in enumerate(shared.value[0]):
                at = np.flatnonzero(part == k)
                if len(at):
                    words, stems = (np.concatenate([docs[i][s] for i in at]) for s in (0, 1))
                    raw[at] = member.raw(words, stems, np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in at])]))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(np.rint(raw / STEP).astype(np.int64))], names=["lang", "toxic", "raw"])

    scored = coded.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "toxic", "ids").mapInArrow(lean(run), "lang string, toxic int, raw bigint")
    return scored.groupBy("lang", "toxic", "raw").agg(F.count("*").alias("n"))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit the classifier on all labelled rows, and its scale and thresholds on their scores."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "toxicity")
    labelled = scratch.store(known(labels), "labels")
    share = float(labelled.agg(F.avg("toxic")).first()[0] or 0.0)
    coded = scratch.store(code(docs, labelled), "coded")
    sizes = {r.toxic: r.n for r in coded.groupBy("toxic").agg(F.countDistinct("doc_id").alias("ids"), F.count("*").alias("n")).where("ids >= 2").collect()}
    if len(sizes) < 2:
        scratch.close()
        return Classifier(constant=share)
    first = first_rows(coded, labelled)
    toxic = np.array([r.toxic for r in first], dtype=np.int64)
    if min((toxic == 1).sum(), (toxic == 0).sum()) >= 2:
        fold = deal(toxic)
        shared, folds = spark.sparkContext.broadcast(([r.ids for r in first], toxic, fold)), int(fold.max()) + 1
        dealt = {r.doc_id: int(k) for r, k in zip(first, fold, strict=True)}
        first = None  # the driver keeps one copy, the broadcast's

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k in (k for b in batches for k in b.column(0).to_pylist()):
                yield pa.RecordBatch.from_pydict({"fold": [k], "member": [pickle.dumps(fit_member(_decoded(shared.value[0]), *shared.value[1:], k))]})

        fitted = spark.range(0, folds, 1, folds).mapInArrow(lean(fit), "fold bigint, member binary").collect()
        members = [pickle.loads(r.member) for r in sorted(fitted, key=lambda r: r.fold)]
        shared.destroy()
        fitted = shared = None
        release()
    else:  # a class of long texts only: members start from nothing
        members, dealt = [TextCnn.new(5 + k) for k in range(2)], {}
    members = learn_all(coded, members, dealt, sizes[0], sizes[1])
    counted = score_counts(coded, members, dealt).toArrow()
    scratch.close()
    n, raw, classes = (counted[c].to_numpy() for c in ("n", "raw", "toxic"))
    return calibrate(members, raw * STEP, classes.astype(np.int64), np.array(counted["lang"].to_pylist()), share, n.astype(float))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows' (doc_id, lang, score); the model, a few megabytes whatever the corpus, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for start, stop in slices(texts):
                part = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.score(texts[start:stop]), pa.float64())], names=["doc_id", "lang", "score"])

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(lean(run), SCORES)


def thresholds(model: Classifier, lang: Column) -> Column:
    """The threshold of a row's language."""
    out = F.lit(CUTOFF)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(F.coalesce(lang, F.lit("")) == name, F.lit(value)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, rejected) of each row."""
    model = train(docs, labels)
    scored = score(docs, model).withColumn("threshold", thresholds(model, F.col("lang")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected")
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(names.index("text")).to_pylist(), b.column(names.index("lang")).to_pylist()
            for start, stop in slices(texts):
                cuts = np.array([shared.value.threshold(x) for x in langs[start:stop]])
                yield b.slice(start, stop - start).filter(pa.array(shared.value.score(texts[start:stop]) < cuts))

    return docs.mapInArrow(lean(run), schema)
