"""String likeness: restricted Damerau distance, Monge-Elkan, q-gram MinHash and its collision curve."""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment distance: insertions, deletions, replacements and swaps of neighbours."""
    if a == b:
        return 0
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            cur.append(d)
        before, prev = prev, cur
    return prev[-1]


def within_one_edit(a: str, b: str) -> bool:
    """Whether :func:`edit_distance` is at most 1, in linear time."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) < len(b):
        return a[k:] == b[k + 1 :]
    return a[k + 1 :] == b[k + 1 :] or (a[k + 1 : k + 2] == b[k : k + 1] and b[k + 1 : k + 2] == a[k : k + 1] and a[k + 2 :] == b[k + 2 :])


@lru_cache(maxsize=1 << 16)
def token_similarity(a: str, b: str) -> float:
    """1 less the edit distance over the greater length; an initial equals every word it begins."""
    if a == b or (min(len(a), len(b)) == 1 and a[:1] == b[:1]):
        return 1.0
    return 1.0 - (1 if within_one_edit(a, b) else edit_distance(a, b)) / max(len(a), len(b))


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The lower of both directions of the mean best likeness of each word of one name in the other."""
    if not a or not b:
        return float(a == b)
    best = lambda x, others: 1.0 if x in others else max(token_similarity(x, y) for y in others)
    return min(sum(best(x, b) for x in a) / len(a), sum(best(y, a) for y in b) / len(b))


def qgrams(text: str, q: int = 3) -> set[str]:
    """The q-grams of a text padded with q - 1 marks on either side."""
    padded = "\x02" * (q - 1) + text + "\x03" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def typo_jaccard(length: int, q: int = 3) -> float:
    """The least Jaccard likeness of the q-grams of a word of a length and itself with two neighbours swapped."""
    n = length + q - 1
    return max(0.0, (n - q - 1) / (n + q + 1))


def collision_probability(jaccard: float, rows: int, bands: int) -> float:
    """The collision curve of banding: the chance that two sets agree in all rows of some band."""
    return 1.0 - (1.0 - jaccard**rows) ** bands


def bands_for(recall: float, jaccard: float, rows: int) -> int:
    """The fewest bands whose collision curve reaches ``recall`` at a likeness."""
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - jaccard**rows)))


class MinHash:
    """MinHash signatures of q-gram sets, folded into one 64-bit key per band."""

    def __init__(self, rows: int, bands: int, q: int = 3, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.rows, self.bands, self.q = rows, bands, q
        n = rows * bands
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.fold = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def keys(self, text: str, salt: str = "", bands: int | None = None) -> np.ndarray:
        """int64 keys of the first ``bands`` bands; texts with different salts share none (but by chance of 64 bits)."""
        bands = self.bands if bands is None else min(bands, self.bands)
        n = bands * self.rows
        grams = np.array([zlib.crc32(g.encode()) for g in qgrams(text, self.q)], dtype=np.uint64)
        with np.errstate(over="ignore"):
            x = grams * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            low = (x[:, None] * self.a[:n] + self.b[:n]).min(axis=0).reshape(bands, self.rows)
            key = (((low ^ (low >> np.uint64(31))) * self.fold).sum(axis=1, dtype=np.uint64)) ^ self.band[:bands]
            key = (key + np.uint64(zlib.crc32(salt.encode()))) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)
