"""From vectors to the ranked representatives in one chain.

units with vectors -> reduced vectors -> density clusters and outlier scores
for each reduced dimension -> clusters attached to the units by key ->
weighted representatives, samples and the ranked sheet.  Each step is the
operator of that name; every dimension is a value of the ``dim`` column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import clusters, density, embed, reps, table


def clustered_units(units: DataFrame, eps: Mapping[int, float], min_samples: int = 5, min_cluster_size: int = 5,
                    method: str = "random", seed: int = 42, id_col: str = "vec_id", vec: str = "vec") -> DataFrame:
    """The rows of ``units`` once for each dimension of ``eps``: ``dim, cluster_id, outlier`` and the reduced ``vec`` added.

    ``eps`` gives the neighbourhood radius of each reduced dimension.  Units
    without a vector are noise (-1) with outlier 1.
    """
    reduced = embed.reduce_dims(units.filter(F.col(vec).isNotNull()).select(id_col, vec), sorted(eps), method, seed, vec, [id_col])
    out = None
    for dim, radius in sorted(eps.items()):
        points = reduced.filter(F.col("dim_label") == f"{dim}d").select(id_col, F.col("vec").alias("x")).checkpoint(eager=True)
        labels = density.density_cluster(points, radius, min_samples, min_cluster_size, id_col)
        near = density.knn(points, min_samples, id_col, include_self=True)
        scored = density.outlier_score(labels, near, min_samples, id_col).drop("core_dist").checkpoint(eager=True)
        known = clusters.attach_clusters(units.drop(vec), scored.join(points.withColumnRenamed("x", vec), id_col), id_col)
        lost = (units.filter(F.col(vec).isNull()).drop(vec).withColumn("cluster_id", F.lit(-1)).withColumn("outlier", F.lit(1.0))
                .withColumn(vec, F.lit(None).cast("array<double>")))
        one = known.unionByName(lost).withColumn("dim", F.lit(dim))
        out = one if out is None else out.unionByName(one)
    return out


def ranked_sheet(clustered: DataFrame, top_k: int = 10, alpha: float = 1.0, samples: int = 8,
                 label_col: str = "source", id_col: str = "vec_id") -> DataFrame:
    """``(dim, top_n, cluster_id, size, rep_phrase, rep_cosine_sim, sample_phrases, aspect_label)``.

    The aspect label of a cluster is ``label_col`` of its representative;
    clusters without one are left out before ranking.
    """
    best = reps.weighted_reps(clustered, top_k, alpha).checkpoint(eager=True)  # dims x top_k rows
    sheet = reps.cluster_samples(clustered, best, samples).drop("aspect_label")
    named = clustered.select("dim", F.col(id_col).alias("rep_id"), F.col(label_col).alias("aspect_label"))
    cols = best.select("dim", "cluster_id", "rep_id", "rep_cosine_sim")
    full = sheet.join(cols, ["dim", "cluster_id"]).join(named, ["dim", "rep_id"])
    ranked = table.rank_in_group(table.drop_unlabelled(full), top_k)
    return ranked.select("dim", "top_n", "cluster_id", "size", "rep_phrase", "rep_cosine_sim", "sample_phrases", "aspect_label")
