"""A ball tree over the rows of one chunk, searched best-first for blocks of queries."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Functions and classes of this module travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 64
QUERY_ROWS = 64
# Leaves are visited in batches that double up to this many.
MOST_LEAVES = 16
# Relative allowance for rounding in bounds, and in squared distances from scalar products.
SLACK = 1e-9
PRODUCT_SLACK = 1e-11


def pair_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of rows one to one; sums run column by column, so they do not depend on what else is computed."""
    difference = left.T - right.T
    return np.sqrt(np.add.reduce(difference * difference, axis=0))


class BallTree:
    """Leaves are balls: rows `starts[i]` to `starts[i + 1]` of `x` around `centers[i]` within `radii[i]`."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, starts, todo = [], [0], [np.arange(len(x))] if len(x) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF_ROWS:
                order.append(rows)
                starts.append(starts[-1] + len(rows))
                continue
            # Two rows that are far apart give the direction along which the median cuts.
            part = x[rows]
            one = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            along = part @ (other - one)
            cut = np.argpartition(along, len(rows) // 2)
            todo += [rows[cut[len(rows) // 2 :]], rows[cut[: len(rows) // 2]]]
        order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        self.ids, self.x, self.starts = ids[order], np.ascontiguousarray(x[order]), np.array(starts)
        self.squares = (self.x * self.x).sum(axis=1)
        leaves = [self.x[a:b] for a, b in zip(starts[:-1], starts[1:])]
        self.centers = np.array([leaf.mean(axis=0) for leaf in leaves]).reshape(len(leaves), x.shape[1])
        self.radii = np.array([pair_distances(leaf, np.broadcast_to(c, leaf.shape)).max() for leaf, c in zip(leaves, self.centers)])
        self.distances_made = 0

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance) of the up to k rows nearest to each query by (distance, id), none beyond its bound.

        A row with the query's own id is left out. Rows at exactly the bound are found.
        """
        found = []
        if len(self.x):
            near = self._products(q, self.centers, (self.centers * self.centers).sum(axis=1))
            by_leaf = np.argsort(near.argmin(axis=1), kind="stable")
            for start in range(0, len(q), QUERY_ROWS):
                rows = by_leaf[start : start + QUERY_ROWS]
                found.append(self._block(rows, q_ids[rows], q[rows], k, bounds[rows].astype(float), near[rows]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        return tuple(np.concatenate(part) for part in zip(*found))

    def _products(self, q: np.ndarray, y: np.ndarray, y_squares: np.ndarray) -> np.ndarray:
        """Squared distances, never above the true ones by rounding."""
        self.distances_made += len(q) * len(y)
        sizes = (q * q).sum(axis=1)[:, None] + y_squares[None, :]
        return np.maximum(sizes * (1 - PRODUCT_SLACK) - 2 * (q @ y.T), 0)

    def _block(self, rows, q_ids, q, k, limits, near):
        lower = np.sqrt(near) - self.radii[None, :] * (1 + SLACK)
        first = lower.min(axis=0)
        leaves = np.argsort(first, kind="stable")
        # Best so far: (row, distance, id), sorted, at most k of a row.
        row, apart, other = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        at, batch = 0, 1
        while at < len(leaves) and first[leaves[at]] <= limits.max():
            now = leaves[at : at + batch]
            at, batch = at + batch, min(2 * batch, MOST_LEAVES)
            now = now[(lower[:, now] <= limits[:, None]).any(axis=0)]
            if not len(now):
                continue
            places = np.concatenate([np.arange(self.starts[leaf], self.starts[leaf + 1]) for leaf in now])
            active = np.flatnonzero((lower[:, now] <= limits[:, None]).any(axis=1))
            squares = self._products(q[active], self.x[places], self.squares[places])
            some, place = np.nonzero(squares <= (limits[active] * (1 + SLACK))[:, None] ** 2)
            some, place = active[some], places[place]
            distance = pair_distances(q[some], self.x[place])
            kept = (distance <= limits[some]) & (self.ids[place] != q_ids[some])
            row = np.concatenate([row, some[kept]])
            apart = np.concatenate([apart, distance[kept]])
            other = np.concatenate([other, self.ids[place][kept]])
            order = np.lexsort((other, apart, row))
            row, apart, other = row[order], apart[order], other[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            full = rank == k - 1
            limits[row[full]] = apart[full]
            row, apart, other = row[rank < k], apart[rank < k], other[rank < k]
        return rows[row], other, apart
