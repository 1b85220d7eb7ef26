"""Views of the driver's test tables in the shapes the operators expect.

The mapping follows FIXTURES.md section 3.  Each function reads whole
tables from ``sf_dir``; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels -> (review_id, course_id, review, label, lang)."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("course_id"),
        F.col("text").alias("review"), "lang")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("review_id"), F.col("quality").alias("label"))
    return docs.join(labels, "review_id", "left").select(
        "review_id", "course_id", "review", "label", "lang")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (vec_id, vec ARRAY<FLOAT>, label)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vec"), "label")


# Cluster views of the vectors: two "dims" (like the 5-d and 10-d runs).
# dim 5: the label column, label 0 is noise, outlier = min(1, 4|e[0]|).
# dim 10: the sign pattern of e[1], e[3], e[4]; |e[2]| < 0.03 is noise,
#         outlier = min(1, 4|e[5]|).
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dim, vec_id, cluster_id, outlier) for both cluster views."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    d5 = e.select(
        F.lit(5).alias("dim"), "vec_id",
        F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).alias("cluster_id"),
        F.least(F.lit(1.0), F.abs(v[0].cast("double")) * 4).alias("outlier"))
    sign = lambda i: (v[i] > 0).cast("int")
    d10 = e.select(
        F.lit(10).alias("dim"), "vec_id",
        F.when(F.abs(v[2]) < 0.03, F.lit(-1))
         .otherwise(F.lit(1) + sign(1) + sign(3) * 2 + sign(4) * 4).alias("cluster_id"),
        F.least(F.lit(1.0), F.abs(v[5].cast("double")) * 4).alias("outlier"))
    return d5.unionByName(d10)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, phrase, source) for vectors that have a document."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("phrase"), "source")
    return docs


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> topic responses (doc_pos, response), one line per event.

    ``'[1] ' || initcap(event_type) || ': user ' || user_id``; every 7th event
    (event_id % 7 = 6) gives the invalid line ``None`` so the parser has
    rejects to route.
    """
    ev = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 7 == 6, F.lit("None")).otherwise(
        F.concat(F.lit("[1] "), F.initcap("event_type"), F.lit(": user "),
                 F.col("user_id").cast("string")))
    return ev.select(F.col("event_id").alias("doc_pos"), line.alias("response"))


def topic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> a two-level topic file as lines (line_no, line).

    Level 1 = p_type, level 2 = p_brand, count = rows, desc = smallest p_name.
    Lines are ordered type, then its brands; ``line_no`` is a dense 1-based
    key (node ids are line numbers, 0 is the root).
    """
    p = table(spark, sf_dir, "part")
    lvl1 = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("d"))
    lvl2 = p.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("d"))
    l1 = lvl1.select("p_type", F.lit("").alias("p_brand"),
                     F.format_string("[1] %s (Count: %d): %s", "p_type", "n", "d").alias("line"))
    l2 = lvl2.select("p_type", "p_brand",
                     F.format_string("    [2] %s (Count: %d): %s", "p_brand", "n", "d").alias("line"))
    lines = l1.unionByName(l2)
    from pyspark.sql import Window
    # A dense line number over a table with one row per (type, brand): its size
    # is bounded by the distinct type x brand pairs, not by the part table.
    w = Window.orderBy("p_type", "p_brand")
    return lines.select(F.row_number().over(w).cast("long").alias("line_no"), "line")
