"""A forest of randomized k-d trees over the centers of a vocabulary, searched best bin first."""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 5


def top_axes(points: np.ndarray, dims: int) -> np.ndarray:
    """The axes along which the points scatter most: sum of squares less n times the squared mean; the first axis wins ties."""
    scatter = (points * points).sum(axis=0) - len(points) * points.mean(axis=0) ** 2
    return np.argsort(-scatter, kind="stable")[:dims]


class Forest:
    """Trees as flat lists: an inner node is (axis, split, left, right), a leaf an array of points."""

    def __init__(self, points: np.ndarray, trees: int = 8, dims: int = 5, seed: int = 7):
        self.points = points
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(np.arange(len(points)), dims, rng) for _ in range(trees)]

    def _grow(self, members: np.ndarray, dims: int, rng: np.random.Generator):
        """Split at the median of an axis drawn from the node's own top axes; the lower half (the larger one) goes left."""
        if len(members) <= LEAF:
            return members
        axis = int(rng.choice(top_axes(self.points[members], dims)))
        order = members[np.argsort(self.points[members, axis], kind="stable")]
        half = (len(order) + 1) // 2
        split = float(np.median(self.points[order, axis]))
        return axis, split, self._grow(order[:half], dims, rng), self._grow(order[half:], dims, rng)

    def nearest(self, query: np.ndarray, budget: float = 0.05) -> int:
        """Position of the nearest point found before more than ``budget`` of all points are compared.

        One queue serves all trees. A child that is not entered waits at its distance from the splitting plane, which no
        point beyond the plane can undercut; so once the best distance is at most the next bound the search is over.
        """
        best, least = 0, float(np.linalg.norm(query - self.points[0]))
        seen = np.zeros(len(self.points), bool)
        limit, compared, tick = budget * len(self.points), 0, 0
        queue = [(0.0, k, tree) for k, tree in enumerate(self.trees)]
        tick = len(queue)
        heapq.heapify(queue)
        while queue:
            bound, _, node = heapq.heappop(queue)
            if least <= bound:
                break
            while isinstance(node, tuple):
                axis, split, left, right = node
                near, far = (left, right) if query[axis] <= split else (right, left)
                heapq.heappush(queue, (abs(split - float(query[axis])), tick, far))
                tick, node = tick + 1, near
            new = node[~seen[node]]
            seen[new] = True
            if len(new):
                apart = np.linalg.norm(self.points[new] - query, axis=1)
                k = int(apart.argmin())
                if (apart[k], new[k]) < (least, best):
                    best, least = int(new[k]), float(apart[k])
            compared += len(new)
            if compared > limit:
                break
        return best
