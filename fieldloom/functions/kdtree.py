"""A k-d tree over points in numpy, for pairs within a chord length and for nearest points."""

from __future__ import annotations

import numpy as np

LEAF = 48


class KDTree:
    """Points sorted into leaves of at most ``LEAF`` by median cuts of the widest axis."""

    def __init__(self, xyz: np.ndarray, leaf: int = LEAF) -> None:
        n = len(xyz)
        self.order = np.arange(n)
        self.low, self.high, self.left, self.right, self.span = [], [], [], [], []
        if n:
            self._build(xyz, 0, n, leaf)
        self.xyz = xyz[self.order] if n else xyz
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, xyz: np.ndarray, start: int, end: int, leaf: int) -> int:
        todo, root = [(start, end, -1, False)], 0
        while todo:
            a, b, parent, is_right = todo.pop()
            part = xyz[self.order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            node = len(self.span)
            for kept, value in ((self.low, low), (self.high, high), (self.left, -1), (self.right, -1), (self.span, (a, b))):
                kept.append(value)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if b - a > leaf and (high > low).any():
                axis, half = int(np.argmax(high - low)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], half)]
                todo += [(a, a + half, node, False), (a + half, b, node, True)]
        return root

    def leaves(self):
        return (k for k, child in enumerate(self.left) if child < 0)

    def near(self, low: np.ndarray, high: np.ndarray, radius: float) -> list[int]:
        """Leaves whose boxes come within ``radius`` of a box."""
        out, todo, limit = [], [0] if self.span else [], radius * radius
        while todo:
            k = todo.pop()
            gap = np.maximum(0.0, np.maximum(self.low[k] - high, low - self.high[k]))
            if gap @ gap > limit:
                continue
            if self.left[k] < 0:
                out.append(k)
            else:
                todo += (self.left[k], self.right[k])
        return out

    def pairs_with(self, other: KDTree, radius: float, block: int = 2048):
        """Yields arrays (i, j): positions in this tree's and in the other's original order of points within ``radius``."""
        limit = radius * radius
        for k in self.leaves():
            a, b = self.span[k]
            near = other.near(self.low[k], self.high[k], radius)
            for a0 in range(a, b, block):  # a leaf of equal points may be long
                a1 = min(b, a0 + block)
                mine = self.xyz[a0:a1]
                for leaf in near:
                    c, d = other.span[leaf]
                    for c0 in range(c, d, block):
                        c1 = min(d, c0 + block)
                        gap = mine[:, None, :] - other.xyz[None, c0:c1, :]
                        i, j = np.nonzero(np.einsum("ijk,ijk->ij", gap, gap) <= limit)
                        if len(i):
                            yield self.order[i + a0], other.order[j + c0]


def nearest_rows(points: np.ndarray, queries: np.ndarray, within: float = 1e-14) -> np.ndarray:
    """The row of the point nearest to each query (in two or three dimensions), the first of those equally near up to rounding.

    Queries that find nothing within a radius go on with twice of it; each leaf of queries meets only leaves near it.
    """
    points, queries = np.asarray(points, float), np.asarray(queries, float)
    out = np.full(len(queries), -1, dtype=np.int64)
    if not len(points) or not len(queries):
        return out
    tree = KDTree(points)
    width = float(np.linalg.norm(points.max(axis=0) - points.min(axis=0)))
    reach = float(np.linalg.norm(np.maximum(points.max(axis=0), queries.max(axis=0)) - np.minimum(points.min(axis=0), queries.min(axis=0)))) * 1.01 + 1e-300
    radius = min(reach, max(width / max(1.0, np.sqrt(len(points))), reach * 1e-6))
    left = np.arange(len(queries))
    while len(left):
        best, row = np.full(len(left), np.inf), np.full(len(left), -1, dtype=np.int64)
        for i, j in KDTree(queries[left]).pairs_with(tree, radius):
            gap = ((queries[left[i]] - points[j]) ** 2).sum(axis=1)
            order = np.lexsort((j, gap, i))
            i, j, gap = i[order], j[order], gap[order]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            least = np.repeat(gap[first], np.diff(np.append(first, len(i))))
            level = gap <= least + within
            i, j, gap = i[level], j[level], gap[level]
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            keep = np.concatenate([[True], i[1:] != i[:-1]])
            for q, p, g in zip(i[keep], j[keep], least[level][order][keep]):
                if g < best[q] - within or (g <= best[q] + within and p < row[q]):
                    row[q] = p
                best[q] = min(best[q], g)
        found = row >= 0
        out[left[found]] = row[found]
        left, radius = left[~found], min(reach, radius * 2)
    return out


class Splits:
    """k-d cuts of space made from a bounded sample; every leaf is one group of work, ``leaf_size`` its part of the sample."""

    def __init__(self, sample: np.ndarray, leaves: int, least_width: float) -> None:
        self.axis, self.cut, self.child = [], [], []  # child: (left, right), negative = leaf id
        self.leaf_count, self.leaf_size = 0, []
        self._grow(sample, max(1, leaves), least_width)

    def _grow(self, sample: np.ndarray, leaves: int, least_width: float) -> None:
        todo = [(sample, leaves, -1, 0)]
        self.root_is_leaf = False
        while todo:
            part, wanted, parent, side = todo.pop()
            width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(3)
            axis = int(np.argmax(width))
            if wanted > 1 and len(part) > 1 and width[axis] > least_width:
                cut = float(np.median(part[:, axis]))
                left = part[:, axis] < cut
                if left.any() and not left.all():
                    node = len(self.axis)
                    self.axis.append(axis), self.cut.append(cut), self.child.append([0, 0])
                    if parent >= 0:
                        self.child[parent][side] = node
                    todo += [(part[left], wanted // 2, node, 0), (part[~left], wanted - wanted // 2, node, 1)]
                    continue
            leaf = self.leaf_count
            self.leaf_count += 1
            self.leaf_size.append(len(part))
            if parent >= 0:
                self.child[parent][side] = -1 - leaf
            else:
                self.root_is_leaf = True

    def assign(self, xyz: np.ndarray, halo: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each row once at home and once in every other leaf within ``halo``."""
        rows, leaves, homes = [], [], []
        if self.root_is_leaf:
            n = len(xyz)
            return np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        todo = [(0, np.arange(len(xyz)), np.ones(len(xyz), dtype=bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at), homes.append(home)
                leaves.append(np.full(len(at), -1 - node, dtype=np.int64))
                continue
            gap = xyz[at, self.axis[node]] - self.cut[node]
            left, right = gap <= halo, gap >= -halo
            todo.append((self.child[node][0], at[left], home[left] & (gap[left] < 0)))
            todo.append((self.child[node][1], at[right], home[right] & (gap[right] >= 0)))
        if not rows:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)
