"""Gradient-boosted trees of depth two in numpy, and the same trees as DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """trees: (feature, cut, left, right) with a tree or a value on each side; left is taken where feature <= cut."""

    base: float
    trees: list

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + _column(t, features)
        return total


def _apply(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _apply(left, x), _apply(right, x))


def _column(tree, features) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, left, right = tree
    return F.when(features[f] <= F.lit(float(cut)), _column(left, features)).otherwise(_column(right, features))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 25, rate: float = 0.3, depth: int = 2, least: float = 2.0) -> Boosted:
    """Logistic loss, Newton steps; a split needs `least` of summed curvature on either side."""
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    raw, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, y - p, p * (1 - p) + 1e-6, np.arange(len(y)), depth, rate, least)
        trees.append(tree)
        raw = raw + _apply(tree, x)
    return Boosted(base, trees)


def _grow(x, g, h, rows, depth, rate, least):
    value = rate * float(g[rows].sum() / (h[rows].sum() + 1))
    if not depth:
        return value
    best = (1e-9, None, None)
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v, sg, sh = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(sh[at] >= least / 10) & (sh[-1] - sh[at] >= least / 10)]
        if len(at):
            gain = sg[at] ** 2 / (sh[at] + 1) + (sg[-1] - sg[at]) ** 2 / (sh[-1] - sh[at] + 1) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] is None:
        return value
    side = x[rows, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, g, h, rows[side], depth - 1, rate, least), _grow(x, g, h, rows[~side], depth - 1, rate, least))
