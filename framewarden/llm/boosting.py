"""Gradient boosted trees over small whole-number features, fitted on counts.

Rows with equal features are one row with a weight, so the table to fit on is
as large as the feature space and not as the data.  The fitted model is a
column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at_most: int
    low: Leaf | Split
    high: Leaf | Split


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Leaf | Split, ...]

    def margin(self, features: list[Column]) -> Column:
        def grow(node: Leaf | Split) -> Column:
            if isinstance(node, Leaf):
                return F.lit(node.value)
            return F.when(features[node.feature] <= node.at_most, grow(node.low)).otherwise(grow(node.high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + grow(tree)
        return total

    def margins(self, x: np.ndarray) -> np.ndarray:
        def grow(node: Leaf | Split) -> np.ndarray:
            if isinstance(node, Leaf):
                return np.full(len(x), node.value)
            return np.where(x[:, node.feature] <= node.at_most, grow(node.low), grow(node.high))

        return self.start + sum((grow(t) for t in self.trees), np.zeros(len(x)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> Leaf | Split:
    gain = lambda a, b: a * a / (b + ridge)
    best = None
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= cut
                gl, hl = g[low].sum(), h[low].sum()
                gr, hr = g.sum() - gl, h.sum() - hl
                if hl < 0.05 or hr < 0.05:
                    continue
                better = gain(gl, hl) + gain(gr, hr) - gain(g.sum(), h.sum())
                if better > 1e-6 and (best is None or better > best[0] + 1e-9):
                    best = (better, f, int(cut), low)
    if best is None:
        return Leaf(float(rate * g.sum() / (h.sum() + ridge)))
    _, f, cut, low = best
    return Split(
        f, cut, _grow(x[low], g[low], h[low], depth - 1, rate, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, rate, ridge)
    )


def boost(
    x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0
) -> Boosted:
    """Logistic loss; ``positive`` of ``total`` rows with the features ``x[i]`` are positive."""
    share = (positive.sum() + 1) / (total.sum() + 2)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(x), start)
    trees = []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, positive - total * p, total * p * (1 - p), depth, rate, ridge)
        trees.append(tree)
        margin = margin + Boosted(0.0, (tree,)).margins(x)
    return Boosted(start, tuple(trees))
