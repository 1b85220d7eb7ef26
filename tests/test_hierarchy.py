"""Variable-density clusters against a top-down brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import hierarchy as HI
from tests.test_density import _brute_tree, _points, _rand_pts


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These cases are many jobs over few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _brute(tree, n, least, allow_single=False):
    """(clusters {(rep, size): (parent, birth, stability, picked)}, labels) of tree [(w, i, j)]."""
    clusters, members = {}, {}

    def parts(points, edges):
        root = {p: p for p in points}
        for _, i, j in edges:
            a, b = root[i], root[j]
            root = {p: a if r == b else r for p, r in root.items()}
        return [sorted(p for p in points if root[p] == r) for r in sorted(set(root.values()))]

    def grow(points, parent, birth):
        me, stability, last = (points[0], len(points)), 0.0, birth
        members[me] = points
        while True:
            held = [e for e in tree if e[1] in points and e[2] in points]
            top = max(e[0] for e in held)
            density = 1 / max(top, HI.SHORTEST)
            stability += len(points) * (density - last)
            last = density
            large = [p for p in parts(points, [e for e in held if e[0] < top]) if len(p) >= least]
            if len(large) != 1:
                break
            points = large[0]
        below = [grow(p, me, last) for p in large]
        total, picks = sum(v for v, _ in below), [x for _, p in below for x in p]
        clusters[me] = (parent, birth, stability)
        if (parent or allow_single) and stability * (1 + 1e-9) >= total:
            return stability, [me]
        return total, picks

    picks = []
    if n >= least and tree:
        _, picks = grow(list(range(n)), None, 0.0)
    labels = dict.fromkeys(range(n), -1)
    for rank, me in enumerate(sorted(picks, key=lambda c: (-c[1], c[0]))):
        labels.update(dict.fromkeys(members[me], rank))
    return {c: (*v, c in picks) for c, v in clusters.items()}, labels


def _frame(spark, tree):
    return spark.createDataFrame([(i, j, float(w)) for w, i, j in tree], "u long, v long, w double")


def _check(spark, pts, tree, least, task_edges, allow_single=False):
    clusters, labels = _brute(tree, len(pts), least, allow_single)
    frame = _frame(spark, tree).checkpoint()
    got, _ = HI.condensed_tree(*HI.merge_tree(frame, least, task_edges), least, allow_single)
    got = {(r.rep, r.size): r for r in got.collect()}
    assert got.keys() == clusters.keys()
    for c, (parent, birth, stability, picked) in clusters.items():
        r = got[c]
        assert ((r.prep, r.psize) if r.prep is not None else None) == parent and r.picked == picked
        assert math.isclose(r.birth, birth, rel_tol=1e-9) and math.isclose(r.stability, stability, rel_tol=1e-9)
    df = _points(spark, pts)
    rows = HI.density_hierarchy(df, 4, least, tree=frame, allow_single=allow_single, task_edges=task_edges).collect()
    assert len(rows) == len(pts) and {r.vec_id: r.cluster_id for r in rows} == labels
    return clusters, labels


def test_blobs_of_unlike_density(spark, task_edges=40):
    rnd = random.Random(4)
    pts = _rand_pts(3, 90) + [(3 + rnd.gauss(0, 0.4), 3 + rnd.gauss(0, 0.4)) for _ in range(40)]
    clusters, labels = _check(spark, pts, _brute_tree(pts, 4), 5, task_edges)
    assert len(clusters) > 4 and max(labels.values()) >= 2 and -1 in labels.values()


def test_equal_weights_copies_and_far_points(spark, task_edges=12):
    grid = [(float(x), float(y)) for x in range(5) for y in range(5)]
    pts = grid + [(x + 40, y) for x, y in grid[:12]] + [(40.0, 0.0)] * 6 + [(500.0, 500.0)]
    _, labels = _check(spark, pts, _brute_tree(pts, 3), 4, task_edges)
    assert labels[len(pts) - 1] == -1


def test_all_points_equal(spark):
    pts = [(1.0, 1.0)] * 20
    assert {r.cluster_id for r in HI.density_hierarchy(_points(spark, pts), 3, 4, tree=_frame(spark, _brute_tree(pts, 3))).collect()} == {-1}
    _, labels = _check(spark, pts, _brute_tree(pts, 3), 4, 3, allow_single=True)
    assert set(labels.values()) == {0}


def test_from_points_with_nulls(spark):
    pts = _rand_pts(11, 60)
    df = _points(spark, pts).union(spark.createDataFrame([(777, None)], "vec_id long, x array<double>"))
    got = {r.vec_id: r.cluster_id for r in HI.density_hierarchy(df, 4, 5).collect()}
    want = _brute(_brute_tree(pts, 4), len(pts), 5)[1]
    assert got == {**want, 777: -1}


def test_without_enough_points(spark):
    few = _points(spark, [(0, 0), (1, 1)])
    assert [r.cluster_id for r in HI.density_hierarchy(few, 4, 5).collect()] == [-1, -1]
    assert HI.density_hierarchy(few.limit(0), 4, 5).count() == 0
    with pytest.raises(ValueError):
        HI.merge_tree(_frame(spark, [(1.0, 0, 1)]), 1)


def _deep(spark, n, seed):
    """A condensed tree as deep as it has clusters, and one with branches: (rep, size, prep, psize, birth, stability)."""
    rnd = random.Random(seed)
    up = {i: (i - 1 if seed % 2 else rnd.randrange(max(0, i - 6), i)) for i in range(1, n)}
    own = {i: rnd.choice([0.0, 1.0, 2.0, rnd.random() * 4, 0.01]) * (1 if rnd.random() < 0.8 else n) for i in range(n)}
    rows = [(i, n - i, up.get(i), n - up[i] if i else None, 0.0, own[i]) for i in range(n)]
    return up, own, spark.createDataFrame(rows, "rep long, size long, prep long, psize long, birth double, stability double").checkpoint()


def _brute_pick(up, own, allow_single):
    value, better = {}, {}
    for i in sorted(own, reverse=True):
        parts = sum(value[j] for j in own if up.get(j) == i)
        better[i] = (i > 0 or allow_single) and own[i] * (1 + 1e-9) >= parts
        value[i] = own[i] if better[i] else parts
    top = {}
    for i in sorted(own):
        top[i] = top.get(up.get(i)) if top.get(up.get(i)) is not None else (i if better[i] else None)
    return top


@pytest.mark.parametrize("seed, allow_single, task_edges", [(1, False, 0), (2, True, 0), (3, False, 1000)])
def test_picks_of_deep_trees_in_few_jobs(spark, seed, allow_single, task_edges):
    up, own, born = _deep(spark, 30, seed)
    spark.sparkContext.setJobGroup(f"deep-{seed}", "picks of a deep tree")
    try:
        got = {r.rep: (r.picked, r.in_rep) for r in HI._pick(born, allow_single, task_edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = _brute_pick(up, own, allow_single)
    assert got == {i: (want[i] == i, want[i]) for i in own}
    if task_edges:  # a round a level would be several jobs for each of 30 levels
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"deep-{seed}")) < 60


def _jobs(spark, group, what):
    spark.sparkContext.setJobGroup(group, group)
    try:
        what()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def _line(spark, n=120):
    """A tree of which every point drops off at a weight of its own, but for one split."""
    return _frame(spark, [(float(i + 1), i, i + 1) for i in range(n)] + [(n + 1.0, 0, n + 1)] + [(i + 0.5, n + i, n + i + 1) for i in range(1, n)]).checkpoint()


def test_condensed_tree_of_few_merges_in_few_jobs(spark):
    frame = _line(spark)
    got = {}

    def run(**rounds):
        clusters, nodes = HI.condensed_tree(*HI.merge_tree(frame, 5), 5, **rounds)
        got[bool(rounds)] = [sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str) for df in (clusters, nodes)]
    assert _jobs(spark, "condensed", run) < 60
    run(task_edges=0)
    assert got[False] == got[True] and len(got[False][0]) == 3 and len(got[False][1]) > 200


def test_rounds_keep_the_estimated_size(spark):
    """A join's estimated size is the product of its sides: carried on through rounds it would be a number of thousands of digits."""
    clusters, nodes = HI.condensed_tree(*HI.merge_tree(_line(spark), 5), 5, task_edges=0)
    for df in (clusters, nodes):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 256


def test_labels_of_few_points_in_few_jobs(spark):
    frame = _line(spark)
    points = spark.range(240).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0)).alias("x"))
    rows = []
    assert _jobs(spark, "labels", lambda: rows.extend(HI.density_hierarchy(points, 5, 5, tree=frame).collect())) < 100
    assert len(rows) == 240 and {r.cluster_id for r in rows} == {0, 1}
