"""Balanced k-d trees of one bounded block of rows, for the distance kernels.

The kernels of ``mirage.operators.distance`` and ``mirage.operators.pivots`` see one
bounded block of B at a time. Instead of measuring every row of it they go down a tree
of its distinct points:

* ``NearTree`` - least distance (and lowest id there): a row first visits the leaf it
  falls into, then the leaves whose box is not farther than what it found. Box
  distances add up the same differences in the same order as point distances, so
  rounding can't rule out a closer point: the result is the exact one.
* ``MeanTree`` - sum of distances: a box at least ``APART`` half-widths away is
  replaced by Chebyshev points that carry its rows' weights (barycentric
  interpolation of the distance, as many points per column as 1e-12 of it needs);
  near boxes are summed row by row. Equal rows visit the same boxes and get equal
  sums.

In many columns boxes rule nothing out; then rows are measured directly as before.
"""

from __future__ import annotations

import math

import numpy as np

NEAR_LEAF = 32
MEAN_LEAF = 512
APART = 4.0  # gap between a row and a box it sees as Chebyshev points, in half-widths
DIGITS = 28.0  # -log of the interpolation's error
_PAIRS = 1 << 20
_NONE = np.iinfo(np.int64).max


def distinct(points: np.ndarray, ids: np.ndarray):
    """(points, copies, lowest id, next id) of the distinct points; _NONE: no other id."""
    order = np.lexsort((ids, *points.T[::-1]))
    p, i = points[order], ids[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    copies = np.diff(np.append(first, len(p)))
    group = np.cumsum(new) - 1
    other = np.where(i != i[first][group], i, _NONE)
    return p[first], copies, i[first], np.minimum.reduceat(other, first)


def _halves(points: np.ndarray, leaf: int):
    """(row numbers in leaf order, padding flags, depth): every node is halved at the
    median of its widest column; leaves have equal sizes, padded by repeated rows."""
    n = len(points)
    depth = max(0, math.ceil(math.log2(n / leaf)))
    total = math.ceil(n / (1 << depth)) << depth
    order = np.arange(total) % n
    pad = np.arange(total) >= n
    for level in range(depth):
        m = total >> level
        v = points[order].reshape(1 << level, m, -1)
        axis = (v.max(axis=1) - v.min(axis=1)).argmax(axis=1)
        key = np.take_along_axis(v, axis[:, None, None], axis=2)[:, :, 0]
        at = np.argpartition(key, m // 2, axis=1)
        order = np.take_along_axis(order.reshape(-1, m), at, axis=1).ravel()
        pad = np.take_along_axis(pad.reshape(-1, m), at, axis=1).ravel()
    return order, pad, depth


def _boxes(points: np.ndarray, depth: int):
    """Lower and upper corners of all nodes, in heap order."""
    leaves = points.reshape(1 << depth, -1, points.shape[1])
    lo, hi = [leaves.min(axis=1)], [leaves.max(axis=1)]
    for _ in range(depth):
        lo.append(np.minimum(lo[-1][::2], lo[-1][1::2]))
        hi.append(np.maximum(hi[-1][::2], hi[-1][1::2]))
    return np.concatenate(lo[::-1]), np.concatenate(hi[::-1])


def _outside(X, lo, hi):
    """Squared distance from rows to boxes (0 inside)."""
    out = np.zeros(len(X))
    for k in range(X.shape[1]):
        gap = np.maximum(np.maximum(lo[:, k] - X[:, k], X[:, k] - hi[:, k]), 0.0)
        out += gap * gap
    return out


class NearTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.n = len(points)
        if not self.n:
            return
        p, _, one, two = distinct(points, ids)
        order, _, self.depth = _halves(p, NEAR_LEAF)
        p = p[order]
        self.lo, self.hi = _boxes(p, self.depth)
        leaves = 1 << self.depth
        self.size = len(p) // leaves
        self.columns = [np.ascontiguousarray(c.reshape(leaves, -1)) for c in p.T]
        self.one, self.two = one[order].reshape(leaves, -1), two[order].reshape(leaves, -1)

    def query(self, A, ida, exclude_self: bool, want_id: bool):
        """(least squared distance, its lowest id or _NONE) per row of A; inf without one."""
        best, arg = np.full(len(A), np.inf), np.full(len(A), _NONE)
        if self.n:
            whole = np.flatnonzero(np.isfinite(A).all(axis=1))
            for i in range(0, len(whole), 4096):
                rows = whole[i:i + 4096]
                self._chunk(A[rows], ida[rows], exclude_self, want_id, rows, best, arg)
        return best, arg

    def _chunk(self, X, idx, exclude_self, want_id, rows, best, arg):
        first = (1 << self.depth) - 1
        home = np.zeros(len(X), np.int64)
        for _ in range(self.depth):
            left = 2 * home + 1
            home = left + (_outside(X, self.lo[left + 1], self.hi[left + 1]) < _outside(X, self.lo[left], self.hi[left]))
        bd, ba = np.full(len(X), np.inf), np.full(len(X), _NONE)
        self._visit(X, idx, exclude_self, want_id, np.arange(len(X)), home - first, bd, ba)
        q, node = np.arange(len(X)), np.zeros(len(X), np.int64)
        for _ in range(self.depth):
            q = np.repeat(q, 2)
            node = np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
            gap = _outside(X[q], self.lo[node], self.hi[node])
            keep = (gap <= bd[q]) if want_id else (gap < bd[q])
            q, node = q[keep], node[keep]
            if len(q) > _PAIRS and len(X) > 64:  # many boxes in reach: fewer rows at once
                half = len(X) // 2
                self._chunk(X[:half], idx[:half], exclude_self, want_id, rows[:half], best, arg)
                self._chunk(X[half:], idx[half:], exclude_self, want_id, rows[half:], best, arg)
                return
        other = node != home[q]
        self._visit(X, idx, exclude_self, want_id, q[other], node[other] - first, bd, ba)
        best[rows], arg[rows] = bd, ba

    def _visit(self, X, idx, exclude_self, want_id, q, leaf, bd, ba):
        """Measure rows ``q`` (ascending) against leaves."""
        step = max(1, _PAIRS // self.size)
        for i in range(0, len(q), step):
            r, at = q[i:i + step], leaf[i:i + step]
            d2 = np.zeros((len(r), self.size))
            for k, c in enumerate(self.columns):
                diff = c[at]
                diff -= X[r, k][:, None]
                diff *= diff
                d2 += diff
            ids = self.one[at] if exclude_self or want_id else None
            if exclude_self:
                ids = np.where(ids == idx[r][:, None], self.two[at], ids)
                d2[ids == _NONE] = np.inf
            m = d2.min(axis=1)
            new = np.ones(len(r), dtype=bool)
            new[1:] = r[1:] != r[:-1]
            start = np.flatnonzero(new)
            least, rows = np.minimum.reduceat(m, start), r[start]
            if want_id:
                low = np.where(d2 <= m[:, None], ids, _NONE).min(axis=1)
                low = np.minimum.reduceat(np.where(m <= np.repeat(least, np.diff(np.append(start, len(r)))), low, _NONE), start)
                better = (least < bd[rows]) | ((least == bd[rows]) & (low < ba[rows]))
                ba[rows[better]] = low[better]
            bd[rows] = np.minimum(bd[rows], least)


class MeanTree:
    def __init__(self, points: np.ndarray):
        self.n = len(points)
        if not self.n:
            return
        p, copies, _, _ = distinct(points, np.zeros(len(points), np.int64))
        order, pad, self.depth = _halves(p, MEAN_LEAF)
        p, w = p[order], np.where(pad, 0.0, copies[order].astype(np.float64))
        self.lo, self.hi = _boxes(p, self.depth)
        leaves = 1 << self.depth
        self.rows = [(x.T.copy(), v) for x, v in zip(p.reshape(leaves, -1, p.shape[1]), w.reshape(leaves, -1), strict=True)]
        self.stand_ins = []
        for level in range(self.depth + 1):
            m = len(p) >> level
            self.stand_ins += [_stand_in(p[j:j + m], w[j:j + m], self.lo[len(self.stand_ins) + j // m], self.hi[len(self.stand_ins) + j // m])
                               for j in range(0, len(p), m)]
        far = (APART * (self.hi - self.lo).max(axis=1) / 2.0) ** 2
        self.far = np.where([x is None for x in self.stand_ins], np.inf, far)

    def sums(self, A):
        """Sum of the distances from every row of A to all rows (NaN for a row with one)."""
        out = np.full(len(A), np.nan if self.n else 0.0)
        if self.n:
            whole = np.flatnonzero(np.isfinite(A).all(axis=1))
            for i in range(0, len(whole), 4096):
                rows = whole[i:i + 4096]
                out[rows] = self._chunk(A[rows])
        return out

    def _chunk(self, X):
        out, last = np.zeros(len(X)), (1 << self.depth) - 1
        q, node = np.arange(len(X)), np.zeros(len(X), np.int64)
        for level in range(self.depth + 1):
            apart = _outside(X[q], self.lo[node], self.hi[node]) >= self.far[node]
            self._add(X, out, q[apart], node[apart], self.stand_ins, 0)
            q, node = q[~apart], node[~apart]
            if level < self.depth:
                q = np.repeat(q, 2)
                node = np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
        self._add(X, out, q, node, self.rows, last)
        return out

    @staticmethod
    def _add(X, out, q, node, table, offset):
        order = np.argsort(node, kind="stable")
        q, node = q[order], node[order]
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(q) else []
        for i, j in zip(start, np.append(start[1:], len(q)), strict=True) if len(q) else ():
            points, weights = table[node[i] - offset]
            step = max(1, (1 << 17) // len(weights))
            for a in range(i, j, step):
                rows = q[a:min(a + step, j)]
                d = np.zeros((len(rows), len(weights)))
                for k, c in enumerate(points):
                    diff = X[rows, k][:, None] - c
                    diff *= diff
                    d += diff
                np.sqrt(d, out=d)
                d *= weights
                out[rows] += d.sum(axis=1)


def _stand_in(p, w, lo, hi):
    """(Chebyshev points of a box, the weights its rows give them); None if these are
    not fewer than half the rows."""
    half = (hi - lo) / 2.0
    widest = half.max()
    sizes = [1 if h == 0 else max(3, math.ceil(DIGITS / math.log(2.0 * APART * widest / h))) for h in half]
    if math.prod(sizes) * 2 > len(p):
        return None
    grid, signs = [], []
    for n, a, h in zip(sizes, lo, half, strict=True):
        angle = (2 * np.arange(n) + 1) * math.pi / (2 * n)
        grid.append(a + h + h * np.cos(angle) if n > 1 else np.array([a]))
        signs.append(np.where(np.arange(n) % 2 == 0, 1.0, -1.0) * np.sin(angle))
    total = np.zeros((math.prod(sizes[:-1]), sizes[-1]))
    for i in range(0, len(p), 4096):
        left = w[i:i + 4096, None]
        for k, (g, s) in enumerate(zip(grid, signs, strict=True)):
            diff = p[i:i + 4096, k][:, None] - g
            hit = diff == 0.0
            part = s / np.where(hit, 1.0, diff)
            on = hit.any(axis=1)
            part[on] = hit[on]
            part /= part.sum(axis=1, keepdims=True)
            if k == len(grid) - 1:
                total += left.T @ part
            else:
                left = (left[:, :, None] * part[:, None, :]).reshape(len(left), -1)
    mesh = np.stack([m.ravel() for m in np.meshgrid(*grid, indexing="ij")])
    return mesh, total.ravel()
