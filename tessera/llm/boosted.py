"""Gradient-boosted trees for binary labels, grown on binned features and scored from flat node arrays.

Monotonic constraints: for a feature marked +1 (or -1) the score never falls (or
rises) as the feature grows. Splits whose child values break the order are
refused, and both sides inherit the middle of the two values as a bound.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    """Nodes of all trees in a row. A leaf points to itself; value is 0 at inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Forest:
    """Newton boosting of the logistic loss. Without rows, or with one label only, the forest is a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            leaf = np.zeros(len(y))
            _grow(nodes, binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, (-np.inf, np.inf), monotone, rate, l2, least, leaf)
            margin += leaf
    a = np.array(nodes, dtype=float).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), depth, base)


def _grow(nodes, binned, cuts, g, h, rows, depth, bound, monotone, rate, l2, least, leaf) -> int:
    here = len(nodes)
    value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), *bound))
    nodes.append([0, 0.0, here, here, rate * value])
    best = (1e-9, -1, -1, 0.0, 0.0)
    if depth and len(rows) >= 2 * least:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            vl, vr = np.clip(-gl / (hl + l2), *bound), np.clip(-(total_g - gl) / (total_h - hl + l2), *bound)
            gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
            gain[(n < least) | (len(rows) - n < least) | (monotone[f] * (vr - vl) < 0)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (gain[k], f, k, float(vl[k]), float(vr[k]))
    if best[1] < 0:
        leaf[rows] = rate * value
        return here
    _, f, k, vl, vr = best
    low, high, middle = *bound, (vl + vr) / 2
    sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: (bound, bound)}[int(monotone[f])]
    goes_left = binned[rows, f] <= k
    nodes[here] = [f, float(cuts[f][k]), 0, 0, 0.0]
    nodes[here][2] = _grow(nodes, binned, cuts, g, h, rows[goes_left], depth - 1, sides[0], monotone, rate, l2, least, leaf)
    nodes[here][3] = _grow(nodes, binned, cuts, g, h, rows[~goes_left], depth - 1, sides[1], monotone, rate, l2, least, leaf)
    return here
