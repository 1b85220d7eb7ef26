"""Exact spanning trees of mutual reachability by joining the trees of two sets of rows.

A tree is held as a ``Chain``: its rows in an order in which the largest gap
between two rows is the largest edge on the path between them.  A pair of rows
of two sets is needed only if it is smaller than every path that is known, so
one product over all pairs leaves little more than the edges themselves:
everything else is ruled out by the gaps, however many rows there are and
whatever the number of dimensions.  Edges are ordered by (w, u, v) with u < v
row numbers; w is the largest of both rows' core distances and their distance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from gleaner.operators import tiles

LEAF = 64  # rows whose pairs are all measured
_SEEDS = 128  # rows of each side whose nearest row on the other is measured first
_PRODUCT = 1 << 19  # values of one product


class Chain(NamedTuple):
    """``rows`` in order and the edge (w, u, v) at the gap after each; the last gap has no edge (inf, -1, -1)."""

    rows: np.ndarray
    w: np.ndarray
    u: np.ndarray
    v: np.ndarray

    def edges(self) -> tuple[np.ndarray, ...]:
        """(row before, row after, w, u, v) of the gaps."""
        at = np.flatnonzero(self.u >= 0)
        return self.rows[at], self.rows[at + 1], self.w[at], self.u[at], self.v[at]


def of_edges(rows: np.ndarray, s: np.ndarray, t: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> Chain:
    """The chain of the spanning forest of the edges s - t, smallest (w, u, v) first."""
    by, place = np.lexsort((v, u, w)), np.argsort(rows)
    number = lambda at: place[np.searchsorted(rows, at[by], sorter=place)].tolist()
    n = len(rows)
    root, size, first, last, after, gap, left = list(range(n)), [1] * n, list(range(n)), list(range(n)), [-1] * n, [-1] * n, n - 1
    for e, a, b in zip(by.tolist(), number(s), number(t)):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            if size[a] < size[b]:
                a, b = b, a
            end = last[a]
            after[end], gap[end], last[a], root[b] = first[b], e, last[b], a
            size[a] += size[b]
            left -= 1
            if not left:
                break
    order, gaps = [], []
    for x in (x for x in range(n) if root[x] == x):
        at = first[x]
        while at >= 0:
            order.append(at), gaps.append(gap[at])
            at = after[at]
    gaps = np.array(gaps, np.int64)
    edge = lambda of, none: np.where(gaps >= 0, of[gaps], none) if len(of) else np.full(n, none)
    return Chain(rows[order], edge(w, np.inf), edge(u, -1), edge(v, -1))


class _Paths:
    """The largest gap between two rows of a chain."""

    def __init__(self, chain: Chain, places: np.ndarray):
        self.chain, self.at = chain, places
        places[chain.rows] = np.arange(len(chain.rows))
        by = np.lexsort((chain.v[:-1], chain.u[:-1], chain.w[:-1]))
        self.w, self.u, self.v = chain.w[by], chain.u[by], chain.v[by]
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by))
        self._most = [rank]
        while (span := 1 << len(self._most)) <= len(rank):
            below = self._most[-1]
            self._most.append(np.maximum(below[:-span // 2], below[span // 2:]))
        self._most = np.array([np.pad(m, (0, len(rank) - len(m))) for m in self._most])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place by (w, u, v) of the largest gap between two places, not the same."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.maximum(self._most[k, a], self._most[k, b - (1 << k)])


def _weights(x: np.ndarray, core: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    d = [tiles.exact(x.take(s[i:i + tiles._PAIRS], axis=0), x.take(t[i:i + tiles._PAIRS], axis=0)) for i in range(0, len(s), tiles._PAIRS)]
    return np.maximum(np.maximum(core[s], core[t]), np.concatenate(d) if d else np.empty(0))


def _sides(x: np.ndarray, core: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    return s, t, _weights(x, core, s, t), np.minimum(s, t), np.maximum(s, t)


def _seeds(x: np.ndarray, core: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some pairs of short edges: of a few rows of a and all of b, the nearest of each."""
    a = a[np.unique(np.linspace(0, len(a) - 1, _SEEDS).astype(np.int64))]
    sq = np.maximum(tiles.squares(x.take(a, axis=0), x.take(b, axis=0))[0], np.maximum(core[a, None], core[b]) ** 2)
    return np.concatenate([a, a[sq.argmin(axis=0)]]), np.concatenate([b[sq.argmin(axis=1)], b])


def joined(x: np.ndarray, core: np.ndarray, a: Chain, b: Chain) -> Chain:
    """The chain of both sets of rows, of the pairs of one with the other and the edges that each has."""
    if not len(a.rows) or not len(b.rows):
        return a if len(a.rows) else b
    if len(a.rows) > len(b.rows):
        a, b = b, a
    rows, places = np.concatenate([a.rows, b.rows]), np.empty(len(x), np.int64)
    pairs = [np.concatenate(p) for p in zip(_seeds(x, core, a.rows, b.rows), _seeds(x, core, b.rows, a.rows)[::-1])]
    found, held = [a.edges(), b.edges(), _sides(x, core, *pairs)], 0
    norm, step = (x * x).sum(axis=1) if x.shape[1] else np.zeros(len(x)), max(1, _PRODUCT // len(b.rows))
    error = norm[rows].max(initial=0.0) * (16e-16 * (x.shape[1] + 8))
    known, renew = None, 0
    for chunk, at in enumerate(range(0, len(a.rows), step)):
        if known is None or chunk >= renew or held > 2 * len(rows):
            chain = of_edges(rows, *(np.concatenate(f) for f in zip(*found)))
            found, held, renew = [chain.edges()], 0, 2 * chunk + 1
            known = _Paths(chain, places)
            half = known.w * known.w * (0.5 + 1e-12)
            other = chain.rows[np.isin(chain.rows, b.rows)]
            spots = places[other]
            gaps = half[known.between(spots[:-1], spots[1:])]
            right = np.hstack([x.take(other, axis=0), norm[other, None] / -2]).T
        here = a.rows[at:at + step]
        spot = places[here]
        near = np.searchsorted(spots, spot)
        ahead = half[known.between(spot, spots[np.minimum(near, len(spots) - 1)])]
        behind = half[known.between(spots[np.maximum(near - 1, 0)], spot)]
        far = np.empty((len(here), len(other)))
        for row, q, up, down in zip(far, near.tolist(), ahead.tolist(), behind.tolist()):
            if q < len(other):
                row[q], row[q + 1:] = up, gaps[q:]
                np.maximum.accumulate(row[q:], out=row[q:])
            if q:
                before = row[q - 1::-1]
                before[0], before[1:] = down, gaps[:q - 1][::-1]
                np.maximum.accumulate(before, out=before)
        # |s - t|^2 <= far^2, with the half of |s|^2 on one side
        far += np.hstack([x.take(here, axis=0), np.ones((len(here), 1))]) @ right
        met = np.flatnonzero(far >= ((norm[here] - error) / 2)[:, None])
        s, t = here[met // len(other)], other[met % len(other)]
        for i in range(0, len(s), tiles._PAIRS):
            edge = _sides(x, core, s[i:i + tiles._PAIRS], t[i:i + tiles._PAIRS])
            top = known.between(places[edge[0]], places[edge[1]])
            w, u, v = known.w[top], known.u[top], known.v[top]
            less = (edge[2] < w) | (edge[2] == w) & ((edge[3] < u) | (edge[3] == u) & (edge[4] < v))
            found.append(tuple(c[less] for c in edge))
            held += int(less.sum())
    return of_edges(rows, *(np.concatenate(f) for f in zip(*found)))


def whole(x: np.ndarray, core: np.ndarray, rows: np.ndarray) -> Chain:
    """The chain of the rows: of halves along the widest axis, joined."""
    if len(rows) <= LEAF or not x.shape[1]:
        i, j = np.triu_indices(len(rows), 1)
        return of_edges(rows, *_sides(x, core, rows[i], rows[j]))
    here, half = x.take(rows, axis=0), len(rows) // 2
    rows = rows[np.argpartition(here[:, np.ptp(here, axis=0).argmax()], half)]
    return joined(x, core, whole(x, core, rows[:half]), whole(x, core, rows[half:]))
