"""Exact nearest neighbours by a block matrix join with int8 tiles.

Query and candidate vectors are dealt to blocks; every pair of blocks is one
tile.  A tile scales its unit vectors to int8, multiplies them (integer sums,
exact in float32 as long as dim * 127 ** 2 < 2 ** 24, in float64 beyond), and
turns each product into a cosine with an error bound from the measured
quantisation errors of the two vectors.  Pairs whose upper bound reaches the
query's k-th best lower bound are computed again in double precision, and the
tile's best k go on; the best k of all tiles are the result.  The bounds lose
nothing, so recall is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, session

K = 5
QUERY_EVERY = 50
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, error): unit ~ rows / scale, error its Euclidean norm."""
    scale = 127.0 / np.abs(unit).max(axis=1)
    rows = np.rint(unit * scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - rows / scale[:, None], axis=1)
    return rows, scale, error


def cosine_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of a @ b.T for unit rows, from their int8 product."""
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    kind = np.float32 if a.shape[1] * 127 ** 2 < 1 << 24 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) / sa[:, None] / sb[None, :]
    # |a.b - a'.b'| <= |a - a'| |b| + |a'| |b - b'|, with |b| = 1 and |a'| <= 1 + |a - a'|
    slack = ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-12
    return near - slack, near + slack


def tile_best(ids_a, a, ids_b, b, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine): each query row's k best candidate ids of this tile, ties to the smaller id.

    An id with several vectors counts once, with its best.
    """
    by_id = np.argsort(ids_b, kind="stable")
    ids_b, b = ids_b[by_id], b[by_id]
    heads = np.flatnonzero(np.append(True, ids_b[1:] != ids_b[:-1]))
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    low, high = cosine_bounds(a / norm_a[:, None], b / norm_b[:, None])
    out = []
    for r in range(len(a)):
        own = ids_b == ids_a[r]
        lower = np.where(own, -np.inf, low[r])
        best = lower if len(heads) == len(lower) else np.maximum.reduceat(lower, heads)
        kth = np.partition(best, -k)[-k] if len(best) >= k else -np.inf
        at = np.flatnonzero((high[r] >= kth) & ~own)
        score = (b[at] * a[r]).sum(axis=1) / (norm_a[r] * norm_b[at])
        order = np.lexsort((ids_b[at], -score))
        if len(heads) < len(ids_b):
            order = order[np.sort(np.unique(ids_b[at[order]], return_index=True)[1])]
        order = order[:k]
        out.extend((int(ids_a[r]), int(ids_b[at[i]]), float(score[i])) for i in order)
    return out


def _tile(k: int):
    def body(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list = []
        if left.num_rows and right.num_rows:
            x = [np.array(t["v"].combine_chunks().values, dtype=np.float64).reshape(t.num_rows, -1) for t in (left, right)]
            ids = [t["id"].to_numpy() for t in (left, right)]
            for i in range(0, len(ids[0]), 256):  # 256 queries against the block at a time
                rows += tile_best(ids[0][i:i + 256], x[0][i:i + 256], ids[1], x[1], k)
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()),
                         "score": pa.array([r[2] for r in rows], pa.float64())})

    return body


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            query_every: int = QUERY_EVERY, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines of each query, ties to the smaller id.

    Queries are the vectors whose id is divisible by ``query_every``;
    candidates are all others of the same dimension.  Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, nor do
    rows without an id.  Rows equal in id and vector count once; different
    vectors of one id are all queries and candidates (not of each other), and
    the best cosine of two ids counts.  An empty table gives an empty table.
    """
    stages = Stages(session(vectors), "nearest")
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(finite, v).alias("v")).where("id is not null and v is not null")
    rows = stages.put("vectors", sound.distinct().withColumn("dim", F.size("v")))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % query_every == 0).alias("q"))
    stages.put("blocks", counts.where("q > 0").select(
        "dim", F.ceil(F.col("q") / query_block).cast("int").alias("nq"), F.ceil(F.col("n") / candidate_block).cast("int").alias("nc")))
    dealt = lambda: stages.get("vectors").join(stages.get("blocks"), "dim")  # noqa: E731  (a plan of its own for each side)
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    left = dealt().where(F.col("id") % query_every == 0).select("id", "v", "dim", block("nq").alias("qb"), F.explode(F.expr("sequence(0, nc - 1)")).alias("cb"))
    right = dealt().select("id", "v", "dim", F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"), block("nc").alias("cb"))
    key = ["dim", "qb", "cb"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
