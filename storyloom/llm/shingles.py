"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from .common import kept

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered; empties itself when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    return kept("word hashes", WordHashes)


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; a shorter text is one run; no words, no run."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    with np.errstate(over="ignore"):
        n = len(hashes) - width + 1
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = (h ^ hashes[k : k + n]) * MULTIPLIER
            h ^= h >> np.uint64(29)
    return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, in ascending order."""
    return np.unique(shingle_hashes(hash_words(words_of(text)), width)) if text else np.zeros(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
