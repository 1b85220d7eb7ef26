"""Vector codes: integer product codebooks, nearest entries found with a GNAT over each codebook.

Vectors are scaled to integers and cut into equal parts; every part position
has a codebook that a fixed number of Lloyd rounds refines.  All distances
that decide are exact 64-bit integers, so results do not depend on how the
rows are partitioned.

* GNAT (geometric near-neighbour access tree): an inner node picks split
  points far from each other, gives every other entry to its nearest split
  point and keeps, for each split point and each child, the range of the
  distances from that point to the child's entries.
* A query takes the split points in turn.  The distance to one of them rules
  out every child whose range lies further than the best distance so far from
  it (triangle inequality).  Bounds are floating square roots of exact
  integers, widened by more than their rounding error, and must hold strictly;
  entries that stay are compared as integers, ties going to the lower index.
* A round is one pass over the stored integer vectors: every task sums the
  parts of each entry before anything is shuffled, so a round shuffles and
  collects parts x entries sums whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType

from gleaner.llm import common as C
from gleaner.llm.common import Stages, session

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
ARITY = 4
#: Largest scaled component: squared distances of a part and sums over rows stay exact below 2**63.
LARGEST = 1 << 27
_SALTS = 64


# -------------------------------------------------------------------- tree
def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Gnat:
    """Exact nearest entry (squared Euclidean, lowest index first) of integer points.

    ``compared`` counts the distances computed, for tests and reports.
    """

    def __init__(self, entries: np.ndarray, arity: int = ARITY):
        self.entries = np.asarray(entries, np.int64)
        self.arity = max(2, arity)
        self.compared = 0
        self.root = self._build(np.arange(len(self.entries)))

    def _build(self, ids: np.ndarray):
        if len(ids) <= self.arity:
            return ids, None
        splits = [int(ids[0])]
        near = squared(self.entries[ids], self.entries[splits[0]])
        while len(splits) < self.arity and near.max() > 0:
            far = int(ids[int(np.argmax(near))])
            splits.append(far)
            near = np.minimum(near, squared(self.entries[ids], self.entries[far]))
        if len(splits) == 1:  # equal entries: only the lowest index can win
            return ids[:1], None
        rest = ids[~np.isin(ids, splits)]
        to = np.stack([squared(self.entries[rest], self.entries[s]) for s in splits]) if len(rest) else np.empty((len(splits), 0), np.int64)
        owner = np.argmin(to, axis=0)
        children, low, high = [], np.zeros((len(splits),) * 2), np.zeros((len(splits),) * 2)
        for j, s in enumerate(splits):
            mine = owner == j
            for i, p in enumerate(splits):
                d = np.sqrt(np.append(to[i][mine], squared(self.entries[s], self.entries[p])).astype(np.float64))
                low[i, j], high[i, j] = _down(d.min()), _up(d.max())
            children.append(self._build(rest[mine]) if mine.any() else None)
        return np.array(splits), (children, low, high)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of ``points``."""
        points = np.asarray(points, np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries), np.int64)
        if len(points) and len(self.entries):
            self._search(self.root, points, np.arange(len(points)), best, index)
        return index, best

    def _offer(self, entry: int, points, rows, best, index) -> np.ndarray:
        d = squared(points[rows], self.entries[entry])
        self.compared += len(rows)
        wins = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[wins]], index[rows[wins]] = d[wins], entry
        return d

    def _search(self, node, points, rows, best, index) -> None:
        ids, inner = node
        if inner is None:
            for e in ids.tolist():
                self._offer(e, points, rows, best, index)
            return
        children, low, high = inner
        alive = np.ones((len(ids), len(rows)), bool)
        for i, e in enumerate(ids.tolist()):
            take = np.flatnonzero(alive[i])
            if not len(take):
                continue
            d = np.sqrt(self._offer(e, points, rows[take], best, index).astype(np.float64))
            r = _up(np.sqrt(best[rows[take]].astype(np.float64)))
            for j in range(len(ids)):
                if j != i:
                    gone = (low[i, j] - _up(d) > r) | (_down(d) - high[i, j] > r)
                    alive[j, take[gone]] = False
        for j, child in enumerate(children):
            if child is not None and alive[j].any():
                self._search(child, points, rows[alive[j]], best, index)


def _up(x):
    return x * (1 + 1e-12) + 1e-9


def _down(x):
    return x * (1 - 1e-12) - 1e-9


# -------------------------------------------------------------------- rows
def _scaled(scale: int):
    """mapInArrow body: (id, label, x) -> (id, label, q) of the rows whose vector can be coded."""
    def body(batches):
        for batch in batches:
            keep, q = [], []
            lists = batch["x"]
            at = lists.offsets.to_numpy()
            flat = lists.values.cast(pa.float64())
            bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False))  # nulls become NaN
            value = np.where(bad, 0.0, flat.to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore"):
                value = np.floor(value * scale)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                lo, hi = int(at[i]), int(at[i + 1])
                if not valid[i] or hi == lo or wrong[hi] > wrong[lo]:
                    continue
                if np.abs(value[lo:hi]).max() >= LARGEST:
                    raise ValueError(f"scaled components must stay below {LARGEST}")
                keep.append(i)
                q.append(value[lo:hi].astype("<i4").tobytes())
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked["id"], picked["label"], pa.array(q, pa.binary())], names=["id", "label", "q"])

    return body


def _points(column, parts: int) -> np.ndarray:
    """(rows, parts, components) of a batch's integer vectors."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").astype(np.int64).reshape(len(rows), parts, -1)


def _part_sums(books: list[np.ndarray]):
    """mapInArrow body: integer vectors -> (part, entry, position, n, total) summed over the task's rows."""
    def body(batches):
        parts, (k, width) = len(books), books[0].shape
        trees = [Gnat(b) for b in books]
        n = np.zeros((parts, k), np.int64)
        total = np.zeros((parts, k, width), np.int64)
        for batch in batches:
            x = _points(batch["q"], parts)
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(x[:, p])
                n[p] += np.bincount(index, minlength=k)
                np.add.at(total[p], index, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()),
             pa.array(np.tile(np.arange(width), len(p)), pa.int32()), pa.array(np.repeat(n[p, e], width)),
             pa.array(total[p, e].reshape(-1))], names=["part", "entry", "position", "n", "total"])

    return body


def _coded(books: list[np.ndarray]):
    """mapInArrow body: (id, label, q) -> (id, label, code, error)."""
    def body(batches):
        trees = [Gnat(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            x = _points(batch["q"], len(books))
            code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
            for p, tree in enumerate(trees):
                index, d = tree.nearest(x[:, p])
                code = code + digits[index].astype(object)
                error += d
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(code.tolist(), pa.string()), pa.array(error)],
                                             names=["id", "label", "code", "error"])

    return body


def seeds(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the ``entries`` smallest ids: one (entries, width) array a part.

    Null ids come last; of rows that repeat an id, the smallest vector counts.
    At most ``entries`` vectors reach the driver.
    """
    ids = rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries)
    first = rows.join(F.broadcast(ids.withColumnRenamed("id", "first")), F.col("id").eqNullSafe(F.col("first")))
    found = first.groupBy("id").agg(F.min("q").alias("q")).orderBy(F.col("id").asc_nulls_last()).collect()
    x = _points(pa.array([bytes(r["q"]) for r in found], pa.binary()), parts) if found else np.empty((0, parts, 0), np.int64)
    return [np.ascontiguousarray(x[:, p]) for p in range(parts)]


def train_codebooks(rows: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """``books`` after the rounds: each used entry becomes the floored mean of its parts."""
    for _ in range(rounds):
        sums = rows.select("q").mapInArrow(_part_sums(books), "part int, entry int, position int, n long, total long")
        books = [b.copy() for b in books]
        # parts x entries x positions numbers, whatever the number of rows
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect():
            books[r["part"]][r["entry"], r["position"]] = r["t"] // r["n"]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def _with_label_error(rows: DataFrame, stages: Stages) -> DataFrame:
    """Add ``label_error``, the error summed over the rows of equal label (nulls together)."""
    same = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("lk"), F.col("label").isNull().alias("ln")]
    sums = stages.put("label-errors", rows.groupBy(*same).agg(F.sum("error").alias("label_error")))
    keyed = rows.select("*", *same)
    if sums.limit(C.BROADCAST_ROWS + 1).count() <= C.BROADCAST_ROWS:
        return keyed.join(F.broadcast(sums), ["lk", "ln"]).drop("lk", "ln")
    # many labels: a common one is spread over the salts
    salt = F.pmod(F.xxhash64("code", "error", "id"), F.lit(_SALTS)).cast("int")
    spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return keyed.withColumn("salt", salt).join(spread, ["lk", "ln", "salt"]).drop("lk", "ln", "salt")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Dropped are null and empty vectors and vectors with a null or non-finite
    component.  A component x becomes floor(scale * x).  The rest must have
    one length, a multiple of ``parts``; other tables raise ValueError, as do
    scaled components of ``LARGEST`` or more.  Repeated rows are rows of their
    own (each counts in means and sums); null ids and null labels are kept.
    With fewer ids than ``entries`` the codebooks are that much smaller.  An
    empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    stages = Stages(session(vectors), "codes")
    types = {f.name: f.dataType for f in vectors.schema.fields}
    numeric = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)
    if not isinstance(types[vector_col].elementType, numeric):
        raise ValueError(f"{vector_col} is not an array of numbers")
    id_type, label_type = types[id_col].simpleString(), types[label_col].simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("x"))
    rows = stages.put("scaled", rows.mapInArrow(_scaled(scale), f"id {id_type}, label {label_type}, q binary"))
    size = rows.agg(F.min(F.length("q")).alias("lo"), F.max(F.length("q")).alias("hi")).first()
    schema = f"id {id_type}, label {label_type}, code string, error long"
    if size["lo"] is None:
        coded, digest = session(vectors).createDataFrame([], schema), hashlib.sha256(b"").hexdigest()
    else:
        if size["lo"] != size["hi"] or size["lo"] // 4 % parts:
            raise ValueError(f"vectors must have one length, a multiple of {parts}")
        books = train_codebooks(rows, seeds(rows, parts, entries), rounds)
        digest = books_digest(books)
        coded = stages.put("coded", rows.mapInArrow(_coded(books), schema))
        stages.drop("scaled")
    out = _with_label_error(coded, stages)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integer vector that a code stands for."""
    index = [int(code[i:i + 2], 16) for i in range(0, len(code), 2)]
    return reduce(lambda a, b: np.concatenate([a, b]), [b[i] for b, i in zip(books, index)])
