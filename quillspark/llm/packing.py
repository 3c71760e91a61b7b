"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

A document's ids are an item with a demand in three dimensions: tokens, one segment, and tokens under the loss mask. One
that is over a limit alone is cut into pieces that are not. A bin is filled by the dot-product heuristic: of the items
that fit, take the one whose demand has the largest inner product with the room that is left, each dimension in parts
of its limit. If none fits, the item of which most tokens still fit is cut to fill the room; where only the loss limit is
reached, these are tokens that bear none. A bin that cannot be filled is cut back to a power of two of tokens and the rest returns to the pool, so bins
need no padding. Bins are filled within a partition from a pool of bounded size: nothing is shuffled, and a lost task is
repeated alone.

The loss mask of a document is a range of its ids. Examples bring theirs in code points (``mask``: two columns, as operator
3's ``loss_start`` and ``loss_end``; an id bears loss if its text overlaps the range). A plain document's first line, up to and with the first id that is a
line break by itself, is its heading: it is context and bears none, all after it does; without a line break all but the first
id bear loss.

Edge cases: a null or empty text is its end id alone; a null bound of a mask counts as the text's own; null ids and
repeated rows are packed like others; an empty table gives no pieces; limits below one are refused; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.arrow import bound_batches, lean, slices
from quillspark.llm.byte_bpe import ID_BYTES, default_vocabulary, encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"
POOL = 128
MEMO, RUN = 250_000, 1_000_000  # stretches that the tokenizer keeps, characters in one run: a worker needs memory for both beside those of other stages


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 12
    loss: int = 2032

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are one at least")


@dataclass
class Item:
    """A stretch of a document's ids, from ``start`` on; those from ``loss_from`` to ``loss_to`` in the document bear loss."""

    doc_id: int | None
    ids: bytes
    start: int
    doc_tokens: int
    loss_from: int
    loss_to: int

    @property
    def tokens(self) -> int:
        return len(self.ids) // ID_BYTES

    def context(self) -> int:
        """Ids before the first one that bears loss."""
        return max(0, min(self.loss_from - self.start, self.tokens)) if self.loss_to > self.start else self.tokens

    def loss(self, tokens: int | None = None) -> int:
        """Loss-bearing ids among the first ones."""
        end = self.start + (self.tokens if tokens is None else tokens)
        return max(0, min(end, self.loss_to) - max(self.start, self.loss_from))

    def within(self, tokens: int, loss: int) -> int:
        """How many of the first ids have room."""
        most = min(self.tokens, tokens)
        return most if self.loss(most) <= loss else self.context() + loss

    def cut(self, tokens: int) -> tuple[Item, Item]:
        at = tokens * ID_BYTES
        mask = self.doc_tokens, self.loss_from, self.loss_to
        return Item(self.doc_id, self.ids[:at], self.start, *mask), Item(self.doc_id, self.ids[at:], self.start + tokens, *mask)


class Packer:
    """Fills bins from a pool of items; ``add`` and ``finish`` give the bins that are closed.

    What a choice depends on stands in arrays beside the pool, a row for each item.
    """

    def __init__(self, limits: Limits):
        self.limits, self.pool = limits, []
        self.demand = np.zeros((2 * POOL, 3))  # tokens, segments, loss
        self.place = np.zeros((2 * POOL, 3), dtype=np.int64)  # start, loss_from, loss_to

    def _put(self, item: Item) -> None:
        n = len(self.pool)
        if n == len(self.demand):
            self.demand, self.place = (np.concatenate([x, np.zeros_like(x)]) for x in (self.demand, self.place))
        self.demand[n] = item.tokens, 1, item.loss()
        self.place[n] = item.start, item.loss_from, item.loss_to
        self.pool.append(item)

    def _keep(self, which: np.ndarray) -> None:
        """Take all but these out of the pool."""
        n = int(which.sum())
        self.demand[:n], self.place[:n] = self.demand[: len(which)][which], self.place[: len(which)][which]
        self.pool = [self.pool[k] for k in np.flatnonzero(which)]

    def add(self, item: Item) -> Iterator[list[Item]]:
        limits = self.limits
        while item.tokens > limits.tokens or item.loss() > limits.loss:
            piece, item = item.cut(item.within(limits.tokens, limits.loss))
            if piece.tokens == limits.tokens:
                yield [piece]
            else:
                yield from self._hold(piece)
        yield from self._hold(item)

    def _hold(self, item: Item) -> Iterator[list[Item]]:
        self._put(item)
        while len(self.pool) >= POOL:
            yield self._fill()

    def finish(self) -> Iterator[list[Item]]:
        while self.pool:
            yield self._fill()

    def _within(self, tokens: int, loss: int) -> np.ndarray:
        """``Item.within`` of the whole pool."""
        n = len(self.pool)
        own, (start, first, last) = self.demand[:n, 0].astype(np.int64), self.place[:n].T
        most = np.minimum(own, tokens)
        bears = np.maximum(0, np.minimum(start + most, last) - np.maximum(start, first))
        context = np.where(last > start, np.maximum(0, np.minimum(first - start, own)), own)
        return np.where(bears <= loss, most, context + loss)

    def _fill(self) -> list[Item]:
        limits = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=float)
        demand = self.demand[: len(self.pool)]
        room, chosen, free = limits.copy(), [], np.ones(len(self.pool), dtype=bool)
        rests: list[Item] = []
        while room[0] > 0 and room[1] > 0 and free.any():
            fits = free & (demand[:, 0] <= room[0]) & (demand[:, 2] <= room[2])
            if room[1] == 1 and (free & (demand[:, 0] >= room[0])).any():
                fits[:] = False  # the last segment takes what reaches the end, if there is such an item
            score = np.where(fits, demand @ (room / limits**2), -1.0)
            best = int(score.argmax())
            take = self.pool[best].tokens
            if score[best] < 0:
                parts = np.where(free, self._within(int(room[0]), int(room[2])), 0)
                best = int(parts.argmax())
                take = int(parts[best])
                if take <= 0:
                    break
            item = self.pool[best]
            if take < item.tokens:
                item, rest = item.cut(take)
                rests.append(rest)
            free[best] = False
            chosen.append(item)
            room -= (item.tokens, 1, item.loss())
        self._keep(free)
        for rest in rests:
            self._put(rest)
        return self._close(chosen)

    def _close(self, chosen: list[Item]) -> list[Item]:
        """Cut a bin that is not full back to a power of two of tokens."""
        total = sum(i.tokens for i in chosen)
        if total == self.limits.tokens:
            return chosen
        keep, out = 1 << (total.bit_length() - 1), []
        for item in chosen:
            if keep >= item.tokens:
                out.append(item)
            elif keep:
                piece, rest = item.cut(keep)
                out.append(piece)
                self._put(rest)
            else:
                self._put(item)
            keep = max(0, keep - item.tokens)
        return out


def _rows(sequences: Iterator[list[Item]]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    columns: list[list] = [[] for _ in range(8)]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    for number, sequence in enumerate(sequences):
        offset = 0
        for i in sequence:
            for c, v in zip(columns, (i.doc_id, i.start, i.tokens, zlib.crc32(i.ids), i.doc_tokens, first + number, offset, i.loss()), strict=True):
                c.append(v)
            offset += i.tokens
        if len(columns[0]) >= 20_000:
            yield batch()
            columns = [[] for _ in range(8)]
    yield batch()


def _plain_mask(coded: bytes, line_break: bytes) -> tuple[int, int]:
    """The loss-bearing ids of a plain document, its end id included."""
    n, at = len(coded) // ID_BYTES, coded.find(line_break)
    while at % ID_BYTES and at >= 0:
        at = coded.find(line_break, at + 1)
    return (at // ID_BYTES + 1 if at >= 0 else min(1, n)), n


def _given_mask(offsets: list[tuple[int, int]], begin: int | None, end: int | None, chars: int) -> tuple[int, int]:
    """The ids whose text overlaps a range of code points; the end id does if the range reaches the text's end."""
    begin, end = 0 if begin is None else begin, chars if end is None else end
    hit = [i for i, (a, b) in enumerate(offsets) if b > begin and a < end] if end > begin else []
    if not hit:
        return 0, 0
    return hit[0], len(offsets) + 1 if end >= chars else hit[-1] + 1


def pack(docs: DataFrame, vocabulary: str | None = None, limits: Limits = Limits(), end_id: int = 1, mask: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of all documents and their places in sequences: see ``PIECES``."""
    bound_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    end = int(end_id).to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, coder = Packer(limits), encoder(vocabulary, MEMO)
        breaks = coder.tokenizer.encode("\n", add_special_tokens=False).ids
        line_break = int(breaks[0]).to_bytes(ID_BYTES, "little")

        def coded(texts: list[str | None], ranges: list[tuple]) -> Iterator[tuple[bytes, tuple[int, int]]]:
            if mask is None:
                for ids in coder.encode(texts):
                    yield ids + end, _plain_mask(ids + end, line_break)
                return
            for text, e, (a, b) in zip(texts, coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False), ranges, strict=True):
                yield np.array([*e.ids, end_id], dtype="<u4").tobytes(), _given_mask(e.offsets, a, b, len(text or ""))

        def sequences() -> Iterator[list[Item]]:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                ranges = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) if mask else []
                for start, stop in slices(texts, RUN):
                    for doc_id, (row, loss) in zip(ids[start:stop], coded(texts[start:stop], ranges[start:stop]), strict=True):
                        yield from packer.add(Item(doc_id, row, 0, len(row) // ID_BYTES, *loss))
            yield from packer.finish()

        yield from _rows(sequences())

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    columns += [F.col(c).cast("bigint").alias(f"mask{i}") for i, c in enumerate(mask or ())]
    return docs.select(*columns).mapInArrow(lean(run, memos=False), PIECES)
