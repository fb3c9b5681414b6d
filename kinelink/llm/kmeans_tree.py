"""A hierarchical k-means tree over a sample of vectors, and its leaves in best-bin-first order."""

from __future__ import annotations

import heapq

import numpy as np

BRANCHES = 16
ROUNDS = 8


class Tree:
    """Nodes in breadth-first order: centres[v], children first[v] to last[v] (none at a leaf), and leaf[v], a leaf's number or -1."""

    def __init__(self, sample: np.ndarray, leaf_size: int, branches: int = BRANCHES, rounds: int = ROUNDS):
        self.branches, self.leaves = branches, 0
        centres, first, last, leaf = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [], [], []
        held = [np.arange(len(sample))]
        v = 0
        while v < len(held):
            groups = _split(sample[held[v]], min(branches, -(-len(held[v]) // max(1, leaf_size))), rounds) if len(held[v]) > leaf_size else []
            first.append(len(held))
            for rows, centre in groups:
                held.append(held[v][rows])
                centres.append(centre)
            last.append(len(held))
            leaf.append(-1 if groups else self.leaves)
            self.leaves += not groups
            v += 1
        self.centres, self.first, self.last, self.leaf = np.array(centres), np.array(first), np.array(last), np.array(leaf)

    def locate(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector: from the root down to the nearest centre each time."""
        node, going = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        while len(going := going[self.leaf[node[going]] < 0]):
            order = going[np.argsort(node[going], kind="stable")]
            cuts = np.flatnonzero(np.diff(node[order])) + 1
            for rows in np.split(order, cuts):
                a, b = self.first[node[rows[0]]], self.last[node[rows[0]]]
                node[rows] = a + _nearest(vectors[rows], self.centres[a:b])
        return self.leaf[node]

    def visits(self, vectors: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """For every vector the first `most` leaves (all, if fewer) in best-bin-first order, and more until they hold `least` rows by `sizes`.

        A priority queue holds the nodes seen and not yet opened, the one whose centre has the largest inner product with
        the query first; opening a node puts its children in, opening a leaf is a visit.
        """
        out = []
        first, last, leaf = self.first.tolist(), self.last.tolist(), self.leaf.tolist()
        held = [least] * self.leaves if sizes is None else sizes.tolist()
        for near in -(vectors @ self.centres.T):
            near, queue, seen, rows = near.tolist(), [(0.0, 0)], [], 0
            while queue and (len(seen) < most or rows < least):
                _, v = heapq.heappop(queue)
                if leaf[v] >= 0:
                    seen.append(leaf[v])
                    rows += held[leaf[v]]
                for child in range(first[v], last[v]):
                    heapq.heappush(queue, (near[child], child))
            out.append(seen)
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (vectors @ centres.T), axis=1)


def _split(vectors: np.ndarray, k: int, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, centre) of up to k groups by Lloyd's rounds from evenly spaced starts; none if the vectors don't part."""
    centres = np.unique(vectors[:: max(1, len(vectors) // k)][:k], axis=0)
    for _ in range(rounds):
        group = _nearest(vectors, centres)
        filled = np.unique(group)
        centres = np.stack([vectors[group == g].mean(axis=0) for g in filled])
    group = _nearest(vectors, centres)
    groups = [(np.flatnonzero(group == g), vectors[group == g].mean(axis=0)) for g in np.unique(group)]
    return groups if len(groups) > 1 else []
