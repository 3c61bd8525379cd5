"""Word shingles as 64-bit hashes, one document at a time, in numpy.

A word is a maximal run of characters other than space and ``\\t``..``\\r``; only ``A``-``Z`` fold to
lower case. The hash of a word comes from xxh3, so every executor gives the same value.
"""

from __future__ import annotations

import numpy as np
import xxhash

_FOLD = {c: c + 32 for c in range(65, 91)}
_SPACE = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}
_FOLD_SPACE = {**_FOLD, **_SPACE}
_CACHE_LIMIT = 100_000
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()


def words(text: str | None) -> list[str]:
    """Folded words of a text; none for null or blank text."""
    return [w for w in text.translate(_FOLD_SPACE).split(" ") if w] if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(28))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; the whole sequence when there are fewer words."""
    return word_shingles(words(text), size)


def word_shingles(tokens: list[str], size: int = 5) -> np.ndarray:
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        if len(h) < size:
            total = np.uint64(len(h))
            for k in range(len(h)):
                total = mix(total * np.uint64(0x2545F4914F6CDD1D) + h[k : k + 1])[0]
            return np.array([total], np.uint64)
        n = len(h) - size + 1
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += h[k : k + n] * (_STEPS[k % len(_STEPS)] + np.uint64(2 * (k // len(_STEPS))))
            total ^= total >> np.uint64(29)
    return np.unique(mix(total))
