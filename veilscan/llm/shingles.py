"""Word shingles as sorted 64-bit keys with their counts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a shingle.
SIZE = 5
#: Words whose hash a worker remembers.
REMEMBERED = 100_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")


class Hashes(dict):
    """Hashes of words in lower case, by the words as they stand."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h


_hashes = Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Keys of the shingles at each word that has `size` - 1 more after it."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = hashes[:n].copy()
    for i in range(1, size):
        key = key * _FACTOR + hashes[i : i + n]
    return mixed(key + np.uint64(size))


def keys_of(text: str | None, size: int = SIZE) -> np.ndarray:
    """Shingles in the order of the text; one of all words if there are fewer than `size`; none without words.

    Words are what white space separates, in lower case.
    """
    words = text.split() if text else []
    return windows(word_hashes(words), min(size, len(words))) if words else np.zeros(0, np.uint64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)
