"""An FM-index over a sequence of small integers: suffix array, wavelet matrix, backward search, sampled positions.

Built with numpy for one shard of a corpus at a time. Many patterns are searched at once: every step of
the backward search is a few array operations over all patterns that are still alive.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``seq`` in order; a suffix that ends sorts before any longer one.

    Prefix doubling from groups of as many symbols as fit 64 bits; only suffixes that are not yet alone with
    their prefix are sorted again.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    bits = max(1, int(seq.max()) + 1).bit_length()
    h = 64 // bits
    s = np.zeros(n + h, dtype=np.uint64)
    s[:n] = seq.astype(np.uint64) + np.uint64(1)
    packed = s[:n].copy()
    for k in range(1, h):
        packed = (packed << np.uint64(bits)) | s[k : n + k]
    sa = np.argsort(packed, kind="stable").astype(np.int64)
    ordered = packed[sa]
    starts = np.ones(n, dtype=bool)
    starts[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    while True:
        nxt = np.ones(n + 1, dtype=bool)
        nxt[:n] = starts
        todo = np.flatnonzero(~(nxt[:-1] & nxt[1:]))  # places in groups of more than one
        if not len(todo):
            return sa
        at = sa[todo]
        second = rank[np.minimum(at + h, n)]
        first = rank[at]
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        sa[todo] = at
        new = np.ones(len(todo), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts[todo] = new
        rank[at] = np.maximum.accumulate(np.where(new, todo, 0))
        h *= 2


class WaveletMatrix:
    """Rank of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(seq)
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []  # number of set bits before each place
        cur = seq.astype(np.int32)
        for level in range(self.levels):
            bit = (cur >> (self.levels - 1 - level)) & 1
            counts = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(self.n - int(counts[-1]))
            mask = bit.astype(bool)
            cur = np.concatenate((cur[~mask], cur[mask]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            counts, zeros = self.ones[level], self.zeros[level]
            rl, rh = counts[lo].astype(np.int64), counts[hi].astype(np.int64)
            lo, hi = np.where(one, zeros + rl, lo - rl), np.where(one, zeros + rh, hi - rh)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        i, out = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        for level in range(self.levels):
            counts = self.ones[level]
            one = counts[i + 1] > counts[i]
            r = counts[i].astype(np.int64)
            out = (out << 1) | one
            i = np.where(one, self.zeros[level] + r, i - r)
        return out


class FMIndex:
    """Backward search and location in ``seq`` (symbols 0 to sigma - 1), with every ``sample``-th text position kept."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16) -> None:
        n = len(seq)
        text = np.empty(n + 1, dtype=np.int32)
        text[:n] = seq
        text[:n] += 1
        text[n] = 0  # the end sorts first
        sa = suffix_array(text)
        self.n, self.sample = n + 1, sample
        self.bwt = WaveletMatrix(text[sa - 1], sigma + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        kept = sa % sample == 0
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))
        self.positions = sa[kept].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of patterns of one length (one a row); empty where a pattern does not occur."""
        m = len(patterns)
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        alive = np.arange(m)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k].astype(np.int64) + 1
            base = self.before[c]
            l, h = base + self.bwt.rank(c, lo[alive]), base + self.bwt.rank(c, hi[alive])
            lo[alive], hi[alive] = l, h
            alive = alive[h > l]
            if not len(alive):
                break
        empty = np.ones(m, dtype=bool)
        empty[alive] = False
        hi[empty] = lo[empty]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back with the last-to-first mapping to the next sampled position."""
        out, row, steps = np.full(len(rows), -1, dtype=np.int64), rows.astype(np.int64), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = row[todo]
            hit = self.kept_rank[r + 1] > self.kept_rank[r]
            done = todo[hit]
            out[done] = (self.positions[self.kept_rank[r[hit]]] + steps[done]) % self.n
            todo, r = todo[~hit], r[~hit]
            c = self.bwt.access(r)
            row[todo] = self.before[c] + self.bwt.rank(c, r)
            steps[todo] += 1
        return out
