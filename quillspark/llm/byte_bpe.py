"""Token ids of whole texts from the tokenizers library, with a bounded memo of what stands between spaces.

A byte-level BPE cuts a text before each space that a visible character follows and around a line feed between two visible
characters, and merges never cross such a cut. So a text's ids are the ids of its stretches between spaces and line
feeds, and a stretch met before need not be encoded again. Texts with runs of white space are cut only where that holds
for certain; all others are cut together by Arrow, and each of their distinct stretches is looked up once. Of a stretch
that ends with punctuation after a letter or digit both parts are looked up apart. Everything the memo lacks goes
to the library, many stretches in one call with a control character between them that no merge takes in.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID_BYTES = 4
#: Runs of white space, white space other than spaces and line feeds, and control characters that count as such here or there.
_ODD = r"[ \n][ \n]|[\x00-\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = re.compile(r"(?= \S)")
_LONGEST = 64  # bytes; a longer stretch is encoded anew each time
_CHUNK = 5_000  # stretches in one call of the library
_LETTER = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{410}-\x{44f}\x{4e00}-\x{9fa5}]"  # those of every Unicode version


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.calls = limit, 0
        self.stretches = pa.array([""], pa.large_string())
        self.ids = pa.array([b""], pa.large_binary())
        self.used = np.zeros(1, dtype=np.int64)  # the last call that met a stretch

        self.separator, self.separator_id = self._free_control()
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = "".join(c for c in string.punctuation if c not in special)
        self.marked = f"{_LETTER}[{re.escape(self.marks)}]+$"

    @property
    def spaced(self) -> pa.Array:
        """The memo's stretches that begin with a space."""
        return self.stretches.filter(pc.starts_with(self.stretches, " "))

    @property
    def plain(self) -> pa.Array:
        """The memo's other stretches."""
        return self.stretches.filter(pc.invert(pc.starts_with(self.stretches, " ")))

    def _free_control(self) -> tuple[str, int]:
        """A control character whose id stands in no longer token."""
        vocabulary = self.tokenizer.get_vocab()
        for code in (*range(0x00, 0x09), *range(0x0E, 0x1C)):
            ids = self.tokenizer.encode(chr(code), add_special_tokens=False).ids
            shown = self.tokenizer.id_to_token(ids[0]) if len(ids) == 1 else None
            if shown and not any(shown in token and token != shown for token in vocabulary):
                return chr(code), ids[0]
        raise ValueError("every control character is part of a longer token")

    def _alone(self, text: str) -> bool:
        """Whether a neighbour could change how a stretch is split."""
        return text[:1] == "'" or text[-2:-1].isspace() or self.separator in text

    def _library(self, texts: list[str]) -> list[bytes]:
        joined, apart = [], []
        for t in texts:
            (apart if self._alone(t) else joined).append(t)
        found: dict[str, bytes] = {}
        for i in range(0, len(joined), _CHUNK):
            part = joined[i : i + _CHUNK]
            ids = np.array(self.tokenizer.encode_batch_fast([self.separator.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.separator_id).tolist()
            data = ids.tobytes()
            ends = [ID_BYTES * c for c in (*cuts, len(ids))]
            found.update(zip(part, (data[a:b] for a, b in zip([0, *(e + ID_BYTES for e in ends)], ends)), strict=True))
        found.update((t, array("I", e.ids).tobytes()) for t, e in zip(apart, self.tokenizer.encode_batch_fast(apart, add_special_tokens=False), strict=True))
        return [found[t] for t in texts]

    def _known(self, stretches: pa.Array) -> pa.Array:
        """The ids of distinct stretches, from the memo or the library."""
        self.calls += 1
        at = pc.index_in(stretches, value_set=self.stretches)
        lacking = stretches.filter(at.is_null())
        found = pa.array(self._library(lacking.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        at = at.to_numpy(zero_copy_only=False)
        new = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), dtype=bool)
        place = np.where(new, len(self.ids) + np.cumsum(new) - 1, at).astype(np.int64)
        ids = pa.concat_arrays([self.ids, found])
        out = ids.take(pa.array(place))

        used = np.concatenate([self.used, np.zeros(len(found), dtype=np.int64)])
        used[place] = self.calls
        known = pa.concat_arrays([self.stretches, lacking])
        keep = np.concatenate([np.ones(len(self.used), dtype=bool), pc.less_equal(pc.binary_length(lacking), _LONGEST).to_numpy(zero_copy_only=False)])
        if keep.sum() > self.limit:  # a quarter goes, what was met last stays
            own = np.flatnonzero(keep)
            keep[own[np.argsort(used[own], kind="stable")[: len(own) - self.limit * 3 // 4]]] = False
        if not keep.all():
            known, ids, used = known.filter(pa.array(keep)), ids.filter(pa.array(keep)), used[keep]
        self.stretches, self.ids, self.used = known, ids, used
        return out

    def _coded(self, stretches: pa.Array) -> pa.Array:
        """The ids of distinct stretches; punctuation at their ends is looked up by itself."""
        marked = pc.match_substring_regex(stretches, self.marked)
        bare = pc.if_else(marked, pc.utf8_rtrim(stretches, self.marks), stretches)
        tails = pc.replace_substring_regex(stretches.filter(marked), f"(?s)^.*{_LETTER}", "")
        both = pa.concat_arrays([bare, tails]).dictionary_encode()
        ids = self._known(both.dictionary).take(both.indices)
        own = ids.slice(0, len(bare))
        ended = pc.binary_join_element_wise(own.filter(marked), ids.slice(len(bare)), pa.scalar(b"", pa.large_binary()))
        return pc.replace_with_mask(own, marked, ended)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, without special ones added; null counts as empty."""
        if not texts:
            return []
        column = pa.array(texts, pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(column, _ODD)
        even = column.filter(pc.invert(odd))
        for mark in " \n":
            even = pc.replace_substring(even, mark, "\0" + mark)
        cut = pc.split_pattern(even, "\0")
        odd = odd.to_numpy(zero_copy_only=False)
        rest = [_CUT.split(texts[i]) for i in np.flatnonzero(odd).tolist()]
        stretches = pa.concat_arrays([cut.values, pa.array([x for r in rest for x in r], pa.large_string())]).dictionary_encode()
        _, ends, data = self._coded(stretches.dictionary).take(stretches.indices).buffers()
        borders = np.concatenate([cut.offsets.to_numpy(), len(cut.values) + np.cumsum([len(r) for r in rest], dtype=np.int64)])
        at = np.frombuffer(ends, dtype="<i8")[borders].tolist()
        out: list[bytes] = [b""] * len(texts)
        for i, a, b in zip([*np.flatnonzero(~odd).tolist(), *np.flatnonzero(odd).tolist()], at, at[1:]):
            out[i] = data[a:b].to_pybytes() if b > a else b""
        return out


@lru_cache(maxsize=1)
def encoder(path: str, limit: int = 600_000) -> Encoder:
    """The encoder of a Python worker: another one takes the place of the last, so that no memo stays beside it."""
    return Encoder(path, limit)


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
