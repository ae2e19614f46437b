"""A union-find over arrays, for tasks that keep only the links that join components."""

from __future__ import annotations

import numpy as np


class Forest:
    """Components of what has been added so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tops(self, nodes: np.ndarray) -> np.ndarray:
        """The root of each node; the whole forest is flattened on the way."""
        root = self.root
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        return root[nodes]

    def add(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indices of links that are needed; links within a component are dropped in bulk, the others joined one by one."""
        kept, index = [], np.arange(len(left))
        root = self.root
        while len(index):
            index = index[self.tops(left[index]) != self.tops(right[index])]
            for k in index[:2048].tolist():
                u, v = left[k], right[k]
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                if u != v:
                    root[max(u, v)] = min(u, v)
                    kept.append(k)
        return np.array(kept, np.int64)
