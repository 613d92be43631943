"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import numpy as np


def _mixed(h: np.ndarray, kind: int, size: int) -> np.ndarray:
    """Hashes of one kind of feature, below ``size``."""
    h = (h ^ np.uint64(kind * 0x51ED2701)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.int64) % size


def hashed_features(words: list[str], size: int, grams: tuple[int, ...], affixes: tuple[int, ...] = (), whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Features of each word, word by word, and how many each word has.

    They are the word itself (if ``whole``), its n-grams of the lengths ``grams`` and its first and last characters of
    the lengths ``affixes``, a mark at each end of the word counted; hashed to numbers below ``size``.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    with np.errstate(over="ignore"):
        runs, h = {}, np.zeros(len(codes), np.uint64)
        padded = np.concatenate([codes, np.zeros(max(grams + affixes), np.uint64)])
        for n in range(1, max(grams + affixes) + 1):
            h = h * np.uint64(0x100000001B3) + padded[n - 1 : n - 1 + len(codes)] + np.uint64(1)
            runs[n] = h.copy()
        of, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if whole:
            power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
            of, ids = [np.arange(len(words))], [_mixed(np.add.reduceat(codes * power[place], starts), 1, size)]
        for n in grams:
            at = np.flatnonzero(place + n <= sizes[owner])
            of.append(owner[at])
            ids.append(_mixed(runs[n][at], 10 + n, size))
        for n in affixes:
            at = np.flatnonzero(sizes >= n)
            of += [at, at]
            ids += [_mixed(runs[n][starts[at]], 20 + n, size), _mixed(runs[n][ends[at] - n], 30 + n, size)]
    of, ids = np.concatenate(of), np.concatenate(ids)
    return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))
