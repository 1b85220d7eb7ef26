"""Blocks of points around pivots, and exact distances tile by tile.

* ``Blocks`` picks up to ``MAX_PIVOTS`` points as pivots (their vectors are the
  only ones on the driver), puts each point into the cell of its nearest pivot
  and packs cells that are near each other into about ``GROUPS`` blocks; large
  cells are cut.
* By the triangle inequality two points of different cells are at least
  ``d(pivot, pivot) - radius - radius`` apart, so only cell pairs whose bound
  reaches the wanted distance meet.  Every pair of blocks with such cells is one
  tile: the task holds both blocks as matrices and compares the cells that meet
  by products of a bounded number of rows.
* Inside a tile, rows lie in leaves of near rows with the box that holds them: a
  leaf meets only rows whose distance from its box reaches the wanted one, near
  leaves first, and stops where nothing can change any more (all neighbours
  bounded, rows dense enough, rows in one component already).
* The product only proposes: it is off by rounding, so every candidate within
  the rounding error is measured again coordinate by coordinate.

A point is copied once for each block it meets: the number of blocks does not
grow with the points, so what is shuffled grows as they do.  Only where a block
of a ``GROUPS``-th of the points would exceed ``BLOCK_BYTES`` are there more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIVOTS = 512
BLOCK_ROWS = 2048
#: Blocks that the points are dealt to, about; fewer where they would hold under a quarter of the rows asked for.
GROUPS = 16
#: Largest matrix of a block.
BLOCK_BYTES = 1 << 26
_PRODUCT = 1 << 22  # values of one product
_PAIRS = 1 << 16  # pairs measured again at once
LEAF_ROWS = 128
_LEAF_PRODUCT = 1 << 16  # values of one product of a leaf


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(rows) and len(flat) % len(rows):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(rows), -1).astype(np.float64, copy=False) if len(rows) else np.empty((0, 0))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and b, summed coordinate by coordinate."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by one product, bound of their rounding error)."""
    x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
    size = x[:, None] + y[None, :]
    return size - 2 * (a @ b.T), size * (4e-16 * (a.shape[1] + 4))


class Blocks:
    """``points(id, x)`` dealt to blocks: a stored table (id, x, cell, block, ...)."""

    def __init__(self, points: DataFrame, rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS):
        n = points.count()
        self.columns = points.columns
        m = max(1, min(max_pivots, 4 * n // max(1, rows)))
        pivots = points.select("x").orderBy(F.xxhash64("id"), "id").limit(m).collect()
        self.pivots = np.array([r["x"] for r in pivots], np.float64).reshape(len(pivots), -1 if pivots else 0)
        pivots_here = self.pivots
        schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes) + ", cell int, r double"

        def assign(batches):
            for batch in batches:
                x = matrix(batch["x"])
                cell, r = np.zeros(len(x), np.int32), np.zeros(len(x))
                for i in range(0, len(x), 1024):
                    cell[i:i + 1024] = squares(x[i:i + 1024], pivots_here)[0].argmin(axis=1)
                if len(x):
                    r = exact(x, pivots_here[cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], names=[*batch.schema.names, "cell", "r"])

        placed = points.mapInArrow(assign, schema).checkpoint(eager=True)
        cells = placed.groupBy("cell").agg(F.count("*").alias("c"), F.max("r").alias("r")).collect()  # one row a pivot
        self.rows = max(1, min(max(rows // 4, -(-n // GROUPS)), BLOCK_BYTES // (8 * max(1, self.pivots.shape[1]))))
        piece = max(1, self.rows // 4)
        self.radius, count = np.zeros(len(self.pivots)), np.zeros(len(self.pivots), np.int64)
        for c in cells:
            self.radius[c["cell"]], count[c["cell"]] = c["r"], c["c"]
        self.parts = -(-count // piece)
        dealt, self.groups, free = [], 0, 0
        self._holds = [set() for _ in self.pivots]  # the blocks of each cell
        for cell in _near_order(self.pivots):
            for part in range(int(self.parts[cell])):
                size = -(-int(count[cell]) // int(self.parts[cell]))
                if size > free:
                    self.groups, free = self.groups + 1, self.rows
                free -= size
                dealt.append((cell, part, self.groups - 1))
                self._holds[cell].add(self.groups - 1)
        spark = points.sparkSession
        parts = spark.createDataFrame([(i, [g for c, _, g in dealt if c == i]) for i in range(len(self.pivots))], "cell int, parts array<long>")
        block = F.expr("parts[cast(pmod(xxhash64(id), size(parts)) as int)]").alias("block")
        self.table = placed.join(F.broadcast(parts), "cell").select(*points.columns, "cell", block)
        self._apart = np.stack([exact(np.broadcast_to(p, self.pivots.shape), self.pivots) for p in self.pivots]) if len(self.pivots) else np.zeros((0, 0))

    def near(self, reach: np.ndarray | float) -> np.ndarray:
        """Whether two cells may hold points within ``reach`` (a number, or one for each cell) of each other."""
        reach = np.broadcast_to(np.asarray(reach, np.float64), len(self.pivots))
        low = (self._apart - self.radius[:, None] - self.radius) * (1 - 1e-9) - 1e-9
        return (low <= np.maximum(reach[:, None], reach)) & (self.parts > 0) & (self.parts > 0)[:, None]

    def partners(self, reach: np.ndarray | float) -> DataFrame:
        """(cell, other): cells that may hold points within ``reach`` of a cell's points."""
        return self.table.sparkSession.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(self.near(reach))], "cell int, other int")

    def tiles(self, reach: np.ndarray | float, own: bool = True, table: DataFrame | None = None, whole: bool = False) -> DataFrame:
        """Rows with ``lo``, ``hi`` (the two blocks) and ``side``; a block's own tile has lo = hi and side 0.

        With ``whole`` blocks of which any cells meet have all their rows in the tile.
        """
        table = self.table if table is None else table
        met = [set().union(*(self._holds[j] for j in np.flatnonzero(row))) for row in self.near(reach)]
        key = "cell"
        if whole:
            key, cells = "block", met
            met = [set() for _ in range(self.groups)]
            for cell, blocks in enumerate(cells):
                for block in self._holds[cell]:
                    met[block] |= blocks
        met = [(i, sorted(blocks)) for i, blocks in enumerate(met)]
        met = self.table.sparkSession.createDataFrame(met, f"`{key}` {dict(table.dtypes)[key]}, mets array<long>")  # at most MAX_PIVOTS rows, or one a block
        near = table.join(F.broadcast(met), key).select(*table.columns, F.explode("mets").alias("met"))
        near = near.where("met <> block").select(*table.columns, F.least("block", "met").alias("lo"),
                                                 F.greatest("block", "met").alias("hi"), F.expr("if(block < met, 0, 1)").alias("side"))
        if not own:
            return near
        return near.unionByName(self.own_tiles(table))

    def own_tiles(self, table: DataFrame | None = None) -> DataFrame:
        """Each block with itself."""
        return (self.table if table is None else table).select("*", F.col("block").alias("lo"), F.col("block").alias("hi"), F.lit(0).alias("side"))


def _near_order(x: np.ndarray) -> list[int]:
    """Row numbers, near rows mostly next to each other: halves along the widest axis."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) < 2:
            out += rows.tolist()
            continue
        axis = np.ptp(x[rows], axis=0).argmax() if x.shape[1] else 0
        rows = rows[np.argsort(x[rows, axis], kind="stable")] if x.shape[1] else rows
        open_ += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
    return out


def pieces(cell: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray | None):
    """Pieces (rows of a, rows of b) of a tile that may be near each other; without ``near`` all."""
    if near is None:
        yield a, b
        return
    for c in np.unique(cell[a]):
        met = b[near[c][cell[b]]]
        if len(met):
            yield a[cell[a] == c], met


def split(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of both sides of a tile (the same rows twice for a block's own tile)."""
    side = table["side"].to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = bool(len(side)) and table["lo"][0].as_py() == table["hi"][0].as_py()
    return a, (a if own else b), own


def close_pairs(a: np.ndarray, b: np.ndarray, eps: float, step: int = 512):
    """Pieces (rows of a, rows of b, distance) of all pairs within eps."""
    step = max(1, min(step, _PRODUCT // max(1, len(b))))
    for i in range(0, len(a), step):
        sq, error = squares(a[i:i + step], b)
        x, y = np.nonzero(sq <= eps * eps * (1 + 1e-12) + error)
        for at in range(0, len(x), _PAIRS):
            p, q = i + x[at:at + _PAIRS], y[at:at + _PAIRS]
            d = exact(a[p], b[q])
            ok = d <= eps
            yield p[ok], q[ok], d[ok]


def _apart(low: np.ndarray, high: np.ndarray, from_low: np.ndarray, from_high: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (columns of low and high) from one box, low by the rounding error."""
    total = np.zeros(low.shape[1])
    for a, b, c, d in zip(low, high, from_low, from_high):
        gap = np.maximum(np.maximum(c - b, a - d), 0)
        total += gap * gap
    return total * (1 - 1e-9)


def _may_reach(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b): all pairs whose squared distance may be at most ``far`` of a's row, by one product."""
    x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = (x + y.max(initial=0.0)) * (8e-16 * (a.shape[1] + 8))
    # |a - b|^2 <= far, with |a|^2 and half of it on one side
    product = np.hstack([-a, np.ones((len(a), 1))]) @ np.hstack([b, y[:, None] / 2]).T
    met = product <= ((far * (1 + 1e-12) + error - x) / 2)[:, None]
    at = np.flatnonzero(met | np.isinf(far)[:, None] if np.isinf(far).any() else met)
    return at // max(1, len(b)), at % max(1, len(b))


class Leaves:
    """``rows`` of a matrix in leaves of near rows, each with the box that holds it."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.columns = np.ascontiguousarray(x.T)
        self.rows, open_ = [], [rows] if len(rows) else []
        while open_:
            at = open_.pop()
            if len(at) <= LEAF_ROWS or not x.shape[1]:
                self.rows.append(at)
                continue
            here, half = x.take(at, axis=0), len(at) // 2
            at = at[np.argpartition(here[:, np.ptp(here, axis=0).argmax()], half)]
            open_ += [at[half:], at[:half]]
        self.low, self.high = (np.array([f(x[at], axis=0) for at in self.rows]).reshape(len(self.rows), x.shape[1]).T for f in (np.min, np.max))

    def __iter__(self):
        return zip(self.rows, self.low.T, self.high.T)

    def around(self, low: np.ndarray, high: np.ndarray, far: float, leaves: int | None = None) -> np.ndarray:
        """Rows whose squared distance from a box may reach ``far``, near leaves first; of the nearest ``leaves`` only."""
        gap = _apart(self.low, self.high, low, high)
        near = np.flatnonzero(~(gap > far))
        near = near[np.argsort(gap[near], kind="stable")][:leaves]
        rows = np.concatenate([self.rows[i] for i in near]) if len(near) else np.empty(0, np.int64)
        points = self.columns.take(rows, axis=1)
        return rows[~(_apart(points, points, low, high) > far)]


def nearest(x: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray, k: int, bound: np.ndarray | None = None):
    """Pieces (rows of a, rows of b, distance) of the k nearest rows of b, ties by ``order``.

    ``bound``: distances within which each row already has k neighbours; what is farther may be left out.
    """
    there = Leaves(x, b)
    for here, low, high in Leaves(x, a):
        far = np.full(len(here), np.inf) if bound is None else bound[here] ** 2 * (1 + 1e-12)
        if not np.isfinite(far).all():
            some = there.around(low, high, np.inf, 4 + k // LEAF_ROWS * 2)
            if len(some) >= k:
                sq, error = squares(x.take(here, axis=0), x.take(some, axis=0))
                far = np.fmin(far, np.partition(sq + error, k - 1, axis=1)[:, k - 1] * (1 + 1e-12))
        met = there.around(low, high, far.max())
        step, found = max(1, _LEAF_PRODUCT // len(here)), []
        for at in range(0, len(met), step):
            some = met[at:at + step]
            i, j = _may_reach(x.take(here, axis=0), x.take(some, axis=0), far)
            found.append((i, some[j], exact(x[here[i]], x[some[j]])))
        if found:
            i, j, d = (np.concatenate(v) for v in zip(*found))
            by = np.lexsort((order[j], d, i))
            i, j, d = i[by], j[by], d[by]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield here[i[kept]], j[kept], d[kept]


def add_close(x: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, eps: float, need: int, held: np.ndarray) -> None:
    """Adds to ``held`` of the rows of a the weights of the rows of b within eps, all or until ``need`` is reached."""
    there, limit = Leaves(x, b), eps * eps
    for here, low, high in Leaves(x, a):
        met, at, step = there.around(low, high, limit * (1 + 1e-9)), 0, 4 * LEAF_ROWS
        while at < len(met) and len(here := here[held[here] < need]):
            some = met[at:at + step]
            at, step = at + step, min(2 * step, _LEAF_PRODUCT // LEAF_ROWS)
            sq, error = squares(x.take(here, axis=0), x.take(some, axis=0))
            sure = sq + error <= limit * (1 - 1e-12)
            held[here] += (sure @ weight[some].astype(np.float64)).astype(np.int64)
            i, j = np.nonzero(~sure & (sq <= limit * (1 + 1e-12) + error))
            ok = exact(x[here[i]], x[some[j]]) <= eps
            np.add.at(held, here[i[ok]], weight[some[j[ok]]])


def _roots(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    while (root[at] != at).any():
        at = root[at]
    return at


def linked(x: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray, eps: float) -> np.ndarray:
    """The smallest label that each label hangs together with by rows of a and b within eps.

    Rows that hang together already are not measured, so a dense region costs no more than its rows.
    """
    root, there, limit = np.arange(label.max(initial=-1) + 1), Leaves(x, b), eps * eps
    leaves = list(Leaves(x, a))
    for most in (4, None):  # the nearest first
        for here, low, high in leaves:
            met = there.around(low, high, limit * (1 + 1e-9), most)
            step = _LEAF_PRODUCT // LEAF_ROWS
            for some in (met[at:at + step] for at in range(0, len(met), step)):
                p, q = _roots(root, label[here]), _roots(root, label[some])
                names, count = np.unique(p, return_counts=True)
                main = names[count.argmax()]
                for u, v in ((here, some[q != main]), (here[p != main], some[q == main])):
                    if not len(u) or not len(v):
                        continue
                    i, j = _may_reach(x.take(u, axis=0), x.take(v, axis=0), np.full(len(u), limit))
                    s, t = _roots(root, label[u])[i], _roots(root, label[v])[j]
                    ok = s != t
                    ok[ok] = exact(x[u[i[ok]]], x[v[j[ok]]]) <= eps
                    s, t = s[ok], t[ok]
                    while len(s):
                        np.minimum.at(root, np.maximum(s, t), np.minimum(s, t))
                        s, t = _roots(root, s), _roots(root, t)
                        s, t = s[s != t], t[s != t]
                        root[:] = root[root]
    return _roots(root, root)
