"""Vectorised word and shingle hashing shared by the operators that compare word sequences.

Texts are lower-cased in A-Z only and split at ASCII white space. A word's hash is a polynomial over its bytes
modulo 2**64, taken from prefix sums over a whole batch, so no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; they grow to the longest batch seen."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        inverse = pow(int(_BASE), -1, 1 << 64)
        base = np.full(size, _BASE)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
        base[1:] = np.uint64(inverse)
        _inverse = np.multiply.accumulate(base)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


#: Bytes that stand between words: ASCII white space, or all of ASCII but letters and digits.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z; null counts as no words."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Words:
    """The words of several texts: their hashes in order, and for each text the place of its first word (and one more)."""

    def __init__(self, texts: list[str | None], between: np.ndarray = SPACES):
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
        powers, self._inverse = _tables(len(data) + 1)
        apart = between[data]
        self._starts = np.flatnonzero(apart[:-1] & ~apart[1:]) + 1
        self._ends = np.flatnonzero(~apart[:-1] & apart[1:]) + 1
        self._prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._prefix[1:])
        self.edges = np.searchsorted(self._starts, np.cumsum([1] + [len(r) + 1 for r in raw]))

    def hashes(self, first: int | None = None) -> np.ndarray:
        """Hashes of the words, or of the first bytes of each."""
        ends = self._ends if first is None else np.minimum(self._ends, self._starts + first)
        return mix((self._prefix[ends] - self._prefix[self._starts]) * self._inverse[self._starts] + (ends - self._starts).astype(np.uint64))


def word_hashes(texts: list[str | None], between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and for each text the place of its first word (one more at the end)."""
    words = Words(texts, between)
    return words.hashes(), words.edges


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += words[i : i + n]
    return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the word runs of length ``k``, sorted; a shorter text is one shingle, no words are none."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(words, min(k, len(words))))
