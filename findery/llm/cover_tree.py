"""Cover trees over unit vectors and their dual traversal, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Points of a node that is not split further.
LEAF = 32
#: Points on either side that one comparison of leaves takes, and children of a node on either side of one of nodes.
BLOCK = 1024
#: Centres whose distances are taken at once as a level is built.
HEADS = 128
#: Slack of pruning, above the rounding of distances near the threshold.
SLACK = 1e-7


class Tree:
    """Levels of balls, each level's radius half of the last; every child centre lies in its parent's ball.

    ``center`` are rows of the points, ``cover`` the exact largest distance from
    the centre to a point below, ``children`` node numbers, ``points`` the rows of a leaf.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center: list[int] = []
        self.cover: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray | None] = []
        self.below: list[np.ndarray] = []
        if len(x):
            self._grow(0, np.arange(len(x)), 2.0)

    def _grow(self, center: int, rows: np.ndarray, radius: float) -> int:
        away = distances(self.x[center : center + 1], self.x[rows])[0]
        return self._node(center, rows, away, radius)

    def _node(self, center: int, rows: np.ndarray, away: np.ndarray, radius: float) -> int:
        number = len(self.center)
        self.center.append(center)
        self.cover.append(float(away.max()))
        self.children.append([])
        self.points.append(None)
        self.below.append(rows)
        if len(rows) <= LEAF or self.cover[number] < 1e-6:
            self.points[number] = rows
            return number
        # below the cover, so that the farthest point falls outside the first child and every level shrinks
        while radius >= self.cover[number]:
            radius /= 2
        # nested: the first ball of the next level keeps the centre; others are opened where no ball reaches
        inside = away <= radius
        self.children[number].append(self._node(center, rows[inside], away[inside], radius))
        rows = rows[~inside]
        while len(rows):
            gaps = distances(self.x[rows[:HEADS]], self.x[rows])
            reached, open_ = gaps <= radius, np.ones(len(rows), dtype=bool)
            for k in range(len(gaps)):
                if open_[k]:
                    inside = open_ & reached[k]
                    inside[k] = True
                    open_ &= ~inside
                    self.children[number].append(self._node(int(rows[k]), rows[inside], gaps[k, inside], radius))
            rows = rows[open_]
        return number


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def dual(a: Tree, b: Tree, reach: float, visit: Callable[[np.ndarray, np.ndarray], None], same: bool) -> None:
    """Calls ``visit(rows of a, rows of b)`` for every pair of leaf sets that may hold a pair within ``reach``.

    Pairs of nodes whose balls lie further apart than ``reach`` are pruned. With
    ``same`` the trees are one and each unordered pair of nodes is met once.
    """
    if not len(a.center) or not len(b.center):
        return
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        pi, pj = a.points[i], b.points[j]
        if pi is not None and pj is not None:
            visit(pi, pj)
            continue
        if same and i == j:
            ci = cj = a.children[i]
        elif pi is None and (pj is not None or a.cover[i] >= b.cover[j]):
            ci, cj = a.children[i], [j]
        else:
            ci, cj = [i], b.children[j]
        for p in range(0, len(ci), BLOCK):
            for q in range(p if same and i == j else 0, len(cj), BLOCK):
                _children(a, b, ci[p : p + BLOCK], cj[q : q + BLOCK], reach, visit, same and i == j and p == q, stack)


def _children(
    a: Tree,
    b: Tree,
    ci: list[int],
    cj: list[int],
    reach: float,
    visit: Callable[[np.ndarray, np.ndarray], None],
    same: bool,
    stack: list[tuple[int, int]],
) -> None:
    """Visits the pairs of leaves among two lists of children (one list, with ``same``) and stacks the other pairs."""
    gap = distances(a.x[[a.center[k] for k in ci]], b.x[[b.center[k] for k in cj]])
    bound = np.array([a.cover[k] for k in ci])[:, None] + np.array([b.cover[k] for k in cj]) + reach + SLACK
    near = gap <= bound
    leaf_i = np.array([a.points[k] is not None for k in ci])
    leaf_j = np.array([b.points[k] is not None for k in cj])
    if same:
        # a single point is no pair with itself
        alone = np.array([a.points[k] is not None and len(a.points[k]) == 1 for k in ci])
        near[alone, alone.nonzero()[0]] = False
    both = near & leaf_i[:, None] & leaf_j
    if both.any():
        # leaves near some leaf of the other side are compared as one block: many are single points
        _blocks(
            np.concatenate([a.points[ci[k]] for k in np.flatnonzero(both.any(axis=1))]),
            np.concatenate([b.points[cj[k]] for k in np.flatnonzero(both.any(axis=0))]),
            visit,
            same,
        )
    for p, q in np.argwhere(near & ~both).tolist():
        if not (same and q < p):
            stack.append((ci[p], cj[q]))


def _blocks(rows: np.ndarray, cols: np.ndarray, visit: Callable[[np.ndarray, np.ndarray], None], same: bool) -> None:
    """Visits ``rows`` against ``cols`` in blocks; with ``same`` (equal sets) each unordered pair of blocks once."""
    for p in range(0, len(rows), BLOCK):
        for q in range(p if same else 0, len(cols), BLOCK):
            visit(rows[p : p + BLOCK], cols[q : q + BLOCK])
