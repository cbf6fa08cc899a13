"""Connected components within a task."""

from __future__ import annotations

import numpy as np


def forest(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by the edges i, j."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Components:
    """Components of numbered nodes whose edges come in parts; the smallest node names a component."""

    def __init__(self, nodes: int) -> None:
        self.parent = np.arange(nodes)

    def find(self, nodes: np.ndarray) -> np.ndarray:
        root = self.parent[nodes]
        while True:
            up = self.parent[root]
            if (up == root).all():
                self.parent[nodes] = root
                return root
            root = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        names, local = np.unique(np.concatenate([self.find(i), self.find(j)]), return_inverse=True)
        self.parent[names] = names[forest(len(names), local[: len(i)], local[len(i) :])]
