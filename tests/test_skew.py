"""A key holding a third of all rows, and results independent of partitioning."""

import random

from pyspark.sql import functions as F

from gleaner.operators import reviews as R
from gleaner.operators import segment as SEG
from gleaner.operators import words as W


def _reviews(spark, n=3000, parts=7):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        if i % 3 == 0:  # one (course, text) pair holds a third of the rows
            rows.append((i, "hot", "Great course! The lectures were not easy.", 1))
        else:
            words = " ".join(rnd.choice(["math", "video", "the", "quiz", "hard", "of", "fun"]) for _ in range(8))
            rows.append((i, f"c{i % 5}", words + ".", 0))
    return spark.createDataFrame(rows, "review_id long, course_id string, review string, label int").repartition(parts)


def test_dedup_hot_key_keeps_first_and_aggregates_partially(spark):
    df = _reviews(spark)
    d = R.dedup_reviews(df)
    hot = d.filter(F.col("course_id") == "hot").collect()
    assert len(hot) == 1 and hot[0].review_id == 0
    exp = {}
    for r in df.collect():
        k = (r.course_id, r.review)
        exp[k] = min(exp.get(k, r.review_id), r.review_id)
    assert {(r.course_id, r.review): r.review_id for r in d.collect()} == exp
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan  # map-side combine before the shuffle


def test_term_counts_hot_cluster(spark):
    units = SEG.segment_units(_reviews(spark), "review", "mintoken", 6, 3,
                              keep=("review_id", "course_id"))
    tf = W.cluster_term_counts(units.withColumnRenamed("course_id", "cluster"), ["cluster"], "unit")
    got = {(r.cluster, r.term): r.tf for r in tf.collect()}
    assert got[("hot", "course")] == 1000 and got[("hot", "easy")] == 1000
    assert "partial_count" in tf._jdf.queryExecution().executedPlan().toString()


def test_results_do_not_depend_on_partitioning(spark):
    base = _reviews(spark, 600, 1)
    outs = []
    for parts in (1, 3, 11):
        df = base.repartition(parts)
        u = SEG.segment_units(R.dedup_reviews(df), "review", "mintoken", 6, 3, keep=("review_id",))
        outs.append(sorted(tuple(r) for r in u.collect()))
    assert outs[0] == outs[1] == outs[2]
