"""Cover trees over rows of a matrix, and inner-product bounds from their covering radii."""

from __future__ import annotations

import numpy as np

#: Points of a leaf at most, where they are not all equal.
LEAF = 16
#: A child covers its parent's radius divided by this. Below 2, so that there are levels in many dimensions, where most points are equally far apart.
BASE = 1.3


class CoverTree:
    """A cover tree, built from the top, level by level.

    A node is centred on one of its points and covers them within its radius. Its children are
    centred on its points, the first on its own centre; each covers its points within the power
    of ``BASE`` below the node's radius, and the centres lie farther apart than that. A node is
    split until it holds at most ``leaf`` points or equal ones; there is no limit on children.
    Nodes stand level by level, the children of one next to each other; ``order`` has the points
    of a node, ``first`` to ``end``, next to each other.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.order = points, np.arange(len(points))
        squares = np.einsum("ij,ij->i", points, points)
        first, end, centre, radius, kids, kid_count = [], [], [], [], [], []
        todo = [(0, len(points), 0)] if len(points) else []
        at = 0
        while at < len(todo):
            a, b, c = todo[at]
            own = self.order[a:b]
            gap = points[own] - points[c]
            far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            reach = float(far.max())
            parts = self._cover(own, far, BASE ** (np.ceil(np.log(reach) / np.log(BASE) - 1e-9) - 1), squares, c) if b - a > leaf and reach > 0 else []
            first.append(a)
            end.append(b)
            centre.append(c)
            radius.append(reach * (1 + 1e-12))
            kids.append(len(todo) if parts else 0)
            kid_count.append(len(parts))
            if parts:
                self.order[a:b] = np.concatenate([p for _, p in parts])
                for pick, p in parts:
                    todo.append((a, a + len(p), pick))
                    a += len(p)
            at += 1
        self.first, self.end, self.centre, self.kids, self.kid_count = (np.array(x, np.int64) for x in (first, end, centre, kids, kid_count))
        self.radius = np.array(radius)
        self.centres = points[self.centre]

    def _cover(self, own: np.ndarray, far: np.ndarray, reach: float, squares: np.ndarray, centre: int) -> list[tuple[int, np.ndarray]]:
        """(centre, its points) of children that cover all points within ``reach``, centres farther apart than that."""
        near = far <= reach
        out = [(centre, own[near])]
        rest = own[~near][np.argsort(-far[~near], kind="stable")]  # the farthest first
        held, size, free = self.points[rest], squares[rest], np.ones(len(rest), bool)
        some = 1
        # Distances of some candidates at once, more of them as long as none is covered by another.
        while free.any():
            now = np.flatnonzero(free)[:some]
            square = size[None] + size[now][:, None] - 2 * (held[now] @ held.T)
            apart = True
            for pick, row in zip(now, square, strict=True):
                if not free[pick]:
                    apart = False
                    continue
                near = free & (row <= reach * reach)
                near[pick] = True
                out.append((int(rest[pick]), rest[near]))
                free[near] = False
            some = min(2 * some, 64) if apart else 1
            if free.sum() <= 3 * len(rest) // 4:
                rest, held, size = rest[free], held[free], size[free]
                free = np.ones(len(rest), bool)
        return out

    def children(self, nodes: np.ndarray) -> np.ndarray:
        return _ranges(self.kids[nodes], self.kid_count[nodes])

    def members(self, nodes: np.ndarray) -> np.ndarray:
        return self.order[_ranges(self.first[nodes], self.end[nodes] - self.first[nodes])]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more component, so that each has the squared norm ``square``: nearer to a query is then the same as a larger inner product with it."""
    rest = np.sqrt(np.maximum(0.0, square - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], axis=1)


def product_bounds(dots: np.ndarray, q_square: float, square: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No inner product of a query with a point of an augmented node is above the first or below the second.

    ``dots`` are the query's inner products with the centres. On the sphere of the augmented
    points a distance d from the query is an inner product of (|q|^2 + square - d^2) / 2.
    """
    length, both = np.sqrt(q_square), q_square + square
    gap = np.sqrt(np.maximum(0.0, both - 2 * dots))
    high = np.minimum(dots + length * radius, (both - np.maximum(0.0, gap - radius) ** 2) / 2)
    low = np.maximum(dots - length * radius, (both - (gap + radius) ** 2) / 2)
    slack = 1e-9 * (1 + both)
    return high + slack, low - slack


def best_in_windows(
    tree: CoverTree, ids: np.ndarray, square: float, query: np.ndarray, own_id: int, low: np.ndarray, high: np.ndarray, k: int, at_once: int = 48
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window of scores the k best (ids, scores) within it, ties to the smaller id, and how many points were scored.

    Best-first: the open nodes with the highest bounds are opened first, some at once. A node is
    open while it may hold a score between a window's floor, or its k-th score so far, and its
    ceiling. Points of ``own_id`` are left out.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in low]
    need, scored = low.astype(float).copy(), 0
    if not len(tree.centre):
        return found, 0
    q_square, width = float(query @ query), len(query)
    nodes, top, bottom = np.zeros(1, np.int64), np.array([np.inf]), np.array([-np.inf])
    while len(nodes):
        open_ = ((top[:, None] >= need[None]) & (bottom[:, None] <= high[None])).any(axis=1)
        nodes, top, bottom = nodes[open_], top[open_], bottom[open_]
        if not len(nodes):
            break
        now = np.arange(len(nodes)) if len(nodes) <= at_once else np.argpartition(-top, at_once - 1)[:at_once]
        picked = nodes[now]
        stay = np.ones(len(nodes), bool)
        stay[now] = False
        leaf = tree.kid_count[picked] == 0
        if leaf.any():
            rows = tree.members(picked[leaf])
            scores, names = tree.points[rows, :width] @ query, ids[rows]
            scored += len(rows)
            others = names != own_id
            for j in range(len(low)):
                fit = others & (scores >= need[j]) & (scores <= high[j])
                if fit.any():
                    name, score = np.concatenate([found[j][0], names[fit]]), np.concatenate([found[j][1], scores[fit]])
                    by = np.lexsort((name, -score))[:k]
                    found[j] = (name[by], score[by])
                    if len(by) == k:
                        need[j] = max(need[j], score[by[-1]])
        fresh = tree.children(picked[~leaf])
        h, l_ = product_bounds(tree.centres[fresh, :width] @ query, q_square, square, tree.radius[fresh])
        nodes, top, bottom = np.concatenate([nodes[stay], fresh]), np.concatenate([top[stay], h]), np.concatenate([bottom[stay], l_])
    return found, scored
