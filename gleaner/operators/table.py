"""Ranked comparison table of two clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_unlabelled(sheet: DataFrame, label_col: str = "aspect_label") -> DataFrame:
    """Strip labels and drop blank or NULL ones."""
    lab = F.trim(F.col(label_col))
    return sheet.withColumn(label_col, lab).filter(F.coalesce(lab, F.lit("")) != "")


def rank_in_group(sheet: DataFrame, max_rank: int = 10, dim_col: str = "dim", size_col: str = "size",
                  tie_col: str = "cluster_id") -> DataFrame:
    """``top_n`` = rank by size desc within a dim (ties: ``tie_col``); keep <= max_rank."""
    w = Window.partitionBy(dim_col).orderBy(F.col(size_col).desc(), F.col(tie_col))
    return sheet.withColumn("top_n", F.row_number().over(w)).filter(F.col("top_n") <= max_rank)


def labels_in_all_dims(ranked: DataFrame, dims=(5, 10), dim_col: str = "dim",
                       label_col: str = "aspect_label") -> DataFrame:
    """Labels whose set of dims equals ``dims`` exactly."""
    want = F.array(*[F.lit(d) for d in sorted(dims)])
    return (ranked.groupBy(label_col).agg(F.array_sort(F.collect_set(dim_col)).alias("_dims"))
                  .filter(F.col("_dims") == want).select(label_col))


def _esc(c):
    return F.regexp_replace(c, r"\|", r"\\|")


def side_by_side(ranked: DataFrame, left_dim: int = 5, right_dim: int = 10, n_rows: int = 10,
                 dim_col: str = "dim", label_col: str = "aspect_label", phrase_col: str = "rep_phrase") -> DataFrame:
    """Rows 1..n: left dim and right dim phrase + label, blanks when missing,
    labels present in both dims in ``**...**``, ``|`` escaped; plus the
    rendered markdown row ``md_line``."""
    spark = ranked.sparkSession
    both = labels_in_all_dims(ranked, (left_dim, right_dim), dim_col, label_col).withColumn("_both", F.lit(True))
    lab = ranked.join(F.broadcast(both), label_col, "left")
    fmt = F.when(F.col("_both"), F.concat(F.lit("**"), F.col(label_col), F.lit("**"))).otherwise(F.col(label_col))
    lab = lab.select(dim_col, "top_n", F.col(phrase_col).alias("_p"), fmt.alias("_l"))
    rows = spark.range(1, n_rows + 1).select(F.col("id").cast("int").alias("top_n"))
    left = lab.filter(F.col(dim_col) == left_dim).select("top_n", F.col("_p").alias("left_phrase"),
                                                         F.col("_l").alias("left_label"))
    right = lab.filter(F.col(dim_col) == right_dim).select("top_n", F.col("_p").alias("right_phrase"),
                                                           F.col("_l").alias("right_label"))
    out = rows.join(left, "top_n", "left").join(right, "top_n", "left")
    cols = ["left_phrase", "left_label", "right_phrase", "right_label"]
    out = out.select("top_n", *[_esc(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in cols])
    md = F.concat(F.lit("| "), F.col("top_n").cast("string"), F.lit(" | "), F.col("left_phrase"), F.lit(" | "),
                  F.col("left_label"), F.lit(" | "), F.col("right_phrase"), F.lit(" | "), F.col("right_label"),
                  F.lit(" |"))
    return out.withColumn("md_line", md)


TABLE_HEADER = ("| top-n | 5-d Weighted centroid | 5-d Cluster label (interpreted) | "
                "10-d Weighted centroid | 10-d Cluster label (interpreted) |\n|---:|---|---|---|---|")


def label_membership(ranked: DataFrame, left_dim: int = 5, right_dim: int = 10, dim_col: str = "dim",
                     label_col: str = "aspect_label", phrase_col: str = "rep_phrase") -> DataFrame:
    """``(aspect_label, rep_phrase, appears_in)`` with appears_in in both/5D/10D.

    A label in both dims carries the right-dim phrase; a label repeated in
    one dim keeps its best rank.  ``order_key`` sorts both, left, right,
    then label.
    """
    g = ranked.groupBy(label_col).agg(
        F.max_by(F.col(phrase_col), F.struct(F.col(dim_col), -F.col("top_n"))).alias("rep_phrase"),
        F.max(F.when(F.col(dim_col) == left_dim, 1).otherwise(0)).alias("_l"),
        F.max(F.when(F.col(dim_col) == right_dim, 1).otherwise(0)).alias("_r"))
    appears = (F.when((F.col("_l") == 1) & (F.col("_r") == 1), F.lit("both"))
                .when(F.col("_l") == 1, F.lit(f"{left_dim}D")).otherwise(F.lit(f"{right_dim}D")))
    order = F.when(appears == "both", 0).when(appears == f"{left_dim}D", 1).otherwise(2)
    return g.select(label_col, "rep_phrase", appears.alias("appears_in"), order.alias("order_key"))
