"""Bagged decision trees with numpy: fitted on a bounded sample on the driver, applied to batches anywhere."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Arrays of nodes; a leaf has feature -1 and its share of positives as value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            f = self.feature[node[todo]]
            todo = todo[f >= 0]
            if not len(todo):
                break
            at = node[todo]
            go_left = x[todo, self.feature[at]] <= self.threshold[at]
            node[todo] = np.where(go_left, self.left[at], self.right[at])
        return self.value[node]


def _grow(bins: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int, leaf: float, tried: int) -> Tree:
    """One CART tree on binned features, by weighted Gini impurity; each split tries a random part of the features."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        total, pos = w[rows].sum(), (w[rows] * y[rows]).sum()
        nodes.append([-1, 0.0, -1, -1, pos / total if total else 0.0])
        if level >= depth or total < 2 * leaf or pos in (0.0, total):
            return me
        best = (1e-9, -1, -1)
        parent = pos * (total - pos) / total
        for f in rng.permutation(bins.shape[1])[:tried]:
            n_cut = len(cuts[f])
            if not n_cut:
                continue
            t = np.bincount(bins[rows, f], weights=w[rows], minlength=n_cut + 1).cumsum()[:-1]
            p = np.bincount(bins[rows, f], weights=w[rows] * y[rows], minlength=n_cut + 1).cumsum()[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = parent - p * (t - p) / t - (pos - p) * ((total - t) - (pos - p)) / (total - t)
            gain[~((t >= leaf) & (total - t >= leaf))] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k)
        if best[1] < 0:
            return me
        _, f, k = best
        side = bins[rows, f] <= k
        nodes[me][:2] = [f, float(cuts[f][k])]
        nodes[me][2] = build(rows[side], level + 1)
        nodes[me][3] = build(rows[~side], level + 1)
        return me

    build(np.flatnonzero(w > 0), 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


class BaggedTrees:
    """The mean of trees grown on bootstrap samples; positives weigh at least the share ``balance`` of all."""

    def __init__(self, trees: list[Tree]) -> None:
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = 15, depth: int = 7, leaf: float = 3.0, seed: int = 1, share: float = 0.6, balance: float = 0.5) -> BaggedTrees:
        rng = np.random.default_rng(seed)
        y = y.astype(float)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 34)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        positive = y.mean() if len(y) else 0.0
        weight = np.where(y > 0, max(balance, positive) / max(positive, 1e-9), min(1 - balance, 1 - positive) / max(1 - positive, 1e-9))
        tried = max(1, int(round(x.shape[1] * share)))
        trees = []
        for _ in range(n_trees):
            times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
            trees.append(_grow(bins, cuts, y, times * weight, rng, depth, leaf, tried))
        return cls(trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives in the leaves a row falls into."""
        if not len(x):
            return np.zeros(0)
        return np.mean([t.predict(x) for t in self.trees], axis=0)
