"""Cluster-label operators: attach, align, rank, central phrase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.words import top_k_clusters as _top_k


def attach_clusters(units: DataFrame, labels: DataFrame, key: Sequence[str] | str = "vec_id") -> DataFrame:
    """Add cluster label / outlier columns to units by an equi-join on the key
    (replaces the reference's positional zip)."""
    return units.join(labels, key if isinstance(key, str) else list(key))


def check_alignment(left: DataFrame, right: DataFrame, key: Sequence[str] | str = "vec_id") -> DataFrame:
    """Keys present on one side only, or more than once on a side.

    One row ``(left_only, right_only, left_dups, right_dups)``; all zero means
    aligned.  Stronger than a length test: equal lengths with different keys
    are caught.
    """
    k = [key] if isinstance(key, str) else list(key)
    lc = left.groupBy(*k).agg(F.count(F.lit(1)).alias("_nl"))
    rc = right.groupBy(*k).agg(F.count(F.lit(1)).alias("_nr"))
    j = lc.join(rc, k, "full_outer")
    return j.agg(
        F.sum(F.when(F.col("_nr").isNull(), 1).otherwise(0)).cast("long").alias("left_only"),
        F.sum(F.when(F.col("_nl").isNull(), 1).otherwise(0)).cast("long").alias("right_only"),
        F.sum(F.when(F.col("_nl") > 1, 1).otherwise(0)).cast("long").alias("left_dups"),
        F.sum(F.when(F.col("_nr") > 1, 1).otherwise(0)).cast("long").alias("right_dups"))


def assert_aligned(left: DataFrame, right: DataFrame, key="vec_id") -> None:
    r = check_alignment(left, right, key).first()
    if any(r):
        raise ValueError(f"inputs not aligned on {key}: {r.asDict()}")


def top_k_clusters(labels: DataFrame, k: int | None = 10, dim_col: str = "dim",
                   cluster_col: str = "cluster_id") -> DataFrame:
    """``(dim, cluster_id, size, size_rank)`` of the k largest non-noise clusters."""
    return _top_k(labels, k, [dim_col], cluster_col)


def central_phrase(units: DataFrame, dim_col: str = "dim", cluster_col: str = "cluster_id",
                   phrase_col: str = "phrase", outlier_col: str = "outlier", id_col: str = "vec_id") -> DataFrame:
    """Phrase with the lowest outlier score per cluster (ties: smallest id).

    A grouped ``min_by`` aggregates partially, so a huge cluster is reduced
    map-side before the shuffle.
    """
    return (units.filter(F.col(cluster_col) != -1)
                 .groupBy(dim_col, cluster_col)
                 .agg(F.min_by(F.col(phrase_col), F.struct(outlier_col, id_col)).alias("representative_phrase")))
