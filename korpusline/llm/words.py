"""Word and hash helpers of the text operators (all run inside Arrow batches)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")

#: Entries a task keeps in a word or token cache before it starts afresh.
CACHE_ENTRIES = 500_000


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, lower-cased, ё read as е."""
    return WORD.findall(text.lower().replace("ё", "е"))


class WordHashes(dict):
    """word -> 64-bit hash, remembered within a task; equal on every machine."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (multiply-xorshift finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `size` successive words of each text.

    hashes: the word hashes of all texts of a batch, one after the other; lengths: words of each.
    Returns the shingle hashes, ascending within each text, and how many each text has.
    """
    ends = np.cumsum(lengths)
    count = np.maximum(lengths - size + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    if not len(owner):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - lengths, count)
    value = np.zeros(len(owner), np.uint64)
    for k in range(size):
        value = mix(value + hashes[first + k] + np.uint64(k + 1))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.bincount(owner[keep], minlength=len(lengths))
