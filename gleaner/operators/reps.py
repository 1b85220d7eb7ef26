"""Weighted centroids, representatives and sample sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import cosine_similarity
from gleaner.operators.clusters import top_k_clusters

# Centroids are broadcast to the unit rows only below this many
# (clusters x dimensions) values; beyond it a shuffled join is used.
BROADCAST_CENTROID_VALUES = 20_000_000


def weighted_centroid(units: DataFrame, alpha: float = 1.0, dim_col: str = "dim",
                      cluster_col: str = "cluster_id", vec_col: str = "vec",
                      outlier_col: str = "outlier") -> DataFrame:
    """``(dim, cluster_id, centroid ARRAY<DOUBLE>)``.

    w = max(0, 1 - alpha * outlier); centroid = sum(w x) / sum(w), or the
    plain mean when sum(w) = 0.  Vectors are exploded by coordinate and
    summed with partial aggregation, so a cluster holding a third of all rows
    is combined map-side; only clusters x d partial sums are shuffled.
    """
    w = F.greatest(F.lit(0.0), 1 - F.lit(float(alpha)) * F.col(outlier_col).cast("double"))
    coords = units.select(dim_col, cluster_col, w.alias("_w"), F.posexplode(vec_col).alias("_pos", "_x"))
    per = (coords.groupBy(dim_col, cluster_col, "_pos")
                 .agg(F.sum(F.col("_w") * F.col("_x").cast("double")).alias("_swx"),
                      F.sum("_w").alias("_sw"), F.avg(F.col("_x").cast("double")).alias("_mean")))
    val = F.when(F.col("_sw") == 0, F.col("_mean")).otherwise(F.col("_swx") / F.col("_sw"))
    return (per.groupBy(dim_col, cluster_col)
               .agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), val.alias("v")))).alias("_cv"))
               .select(dim_col, cluster_col, F.transform("_cv", lambda s: s["v"]).alias("centroid")))


def representative_phrase(units: DataFrame, centroids: DataFrame, dim_col: str = "dim",
                          cluster_col: str = "cluster_id", vec_col: str = "vec", phrase_col: str = "phrase",
                          id_col: str = "vec_id") -> DataFrame:
    """Unit with the highest cosine to its cluster's centroid (ties: smallest id).

    Returns ``(dim, cluster_id, weighted_centroid_phrase, rep_cosine_sim, rep_id)``.
    """
    n_vals = centroids.select(F.sum(F.size("centroid"))).first()[0] or 0
    c = F.broadcast(centroids) if n_vals <= BROADCAST_CENTROID_VALUES else centroids
    sims = units.join(c, [dim_col, cluster_col]).select(
        dim_col, cluster_col, id_col, phrase_col, cosine_similarity(vec_col, "centroid").alias("_sim"))
    best = F.max_by(F.struct(F.col(phrase_col).alias("p"), F.col("_sim").alias("s"), F.col(id_col).alias("i")),
                    F.struct(F.round("_sim", 9), -F.col(id_col)))
    return (sims.groupBy(dim_col, cluster_col).agg(best.alias("_b"))
                .select(dim_col, cluster_col, F.col("_b.p").alias("weighted_centroid_phrase"),
                        F.col("_b.s").alias("rep_cosine_sim"), F.col("_b.i").alias("rep_id")))


def weighted_reps(units: DataFrame, top_k: int = 10, alpha: float = 1.0, dim_col: str = "dim",
                  cluster_col: str = "cluster_id") -> DataFrame:
    """Per dim, the top-k clusters with size, representative phrase and its cosine.

    ``units``: ``(dim, cluster_id, vec_id, phrase, vec, outlier)``; dims are a
    column, so all dims run in one plan.
    """
    top = top_k_clusters(units, top_k, dim_col, cluster_col)
    # top has at most dims x k rows
    chosen = units.join(F.broadcast(top.select(dim_col, cluster_col)), [dim_col, cluster_col], "left_semi")
    cents = weighted_centroid(chosen, alpha, dim_col, cluster_col)
    reps = representative_phrase(chosen, cents, dim_col, cluster_col)
    return top.join(reps, [dim_col, cluster_col]).select(
        dim_col, cluster_col, "size", "size_rank", "weighted_centroid_phrase", "rep_cosine_sim", "rep_id")


def cluster_samples(units: DataFrame, reps: DataFrame, n: int = 8, dim_col: str = "dim",
                    cluster_col: str = "cluster_id", phrase_col: str = "phrase",
                    outlier_col: str = "outlier", id_col: str = "vec_id", sep: str = " | ") -> DataFrame:
    """Inspection sheet: the ``n`` most central phrases of each represented cluster.

    ``row_number() <= n`` is planned as a per-group limit before the shuffle
    (WindowGroupLimit), so a huge cluster sends only n rows per map task.
    Returns ``(dim, cluster_id, size, rep_phrase, sample_phrases, aspect_label)``.
    """
    chosen = units.join(F.broadcast(reps.select(dim_col, cluster_col)), [dim_col, cluster_col], "left_semi")
    w = Window.partitionBy(dim_col, cluster_col).orderBy(F.col(outlier_col), F.col(id_col))
    ranked = chosen.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    samples = (ranked.groupBy(dim_col, cluster_col)
                     .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", phrase_col))),
                                                   lambda s: s[phrase_col]), sep).alias("sample_phrases")))
    return (reps.join(samples, [dim_col, cluster_col])
                .select(dim_col, cluster_col, "size", F.col("weighted_centroid_phrase").alias("rep_phrase"),
                        "sample_phrases", F.lit("").alias("aspect_label")))
