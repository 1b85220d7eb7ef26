"""kNN, components and density clusters against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import density as DEN


def _points(spark, pts):
    return spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate(pts)],
                                 "vec_id long, x array<double>")


def _rand_pts(seed, n=150):
    rnd = random.Random(seed)
    centers = [(0.1, 0.1), (0.5, 0.5), (0.9, 0.2)]
    pts = []
    for i in range(n):
        if i % 5 == 0:
            pts.append((rnd.random(), rnd.random()))
        else:
            cx, cy = rnd.choice(centers)
            pts.append((cx + rnd.gauss(0, 0.03), cy + rnd.gauss(0, 0.03)))
    return pts


def test_knn_exact(spark):
    pts = _rand_pts(1)
    got = {(r.src, r.rank): r.dst for r in DEN.knn(_points(spark, pts), 4, slab_rows=16).collect()}
    for i, p in enumerate(pts):
        d = sorted((math.dist(p, q), j) for j, q in enumerate(pts) if j != i)
        for k in range(4):
            assert got[(i, k + 1)] == d[k][1]


def _brute_dbscan(pts, eps, min_samples, min_size):
    n = len(pts)
    nb = [[j for j in range(n) if j != i and math.dist(pts[i], pts[j]) <= eps] for i in range(n)]
    core = {i for i in range(n) if len(nb[i]) + 1 >= min_samples}
    comp = {}
    for c in sorted(core):
        if c in comp:
            continue
        stack, comp[c] = [c], c
        while stack:
            u = stack.pop()
            for v in nb[u]:
                if v in core and v not in comp:
                    comp[v] = c
                    stack.append(v)
    groups = {}
    for v, c in comp.items():
        groups.setdefault(c, []).append(v)
    big = sorted((g for g in groups.values() if len(g) >= min_size), key=lambda g: (-len(g), min(g)))
    label = {i: -1 for i in range(n)}
    for k, g in enumerate(big):
        for v in g:
            label[v] = k
    return label


def test_density_cluster_matches_brute_force(spark):
    pts = _rand_pts(2, 200)
    got = {r.vec_id: r.cluster_id for r in DEN.density_cluster(_points(spark, pts), 0.03, 5, 5).collect()}
    assert got == _brute_dbscan(pts, 0.03, 5, 5)


def test_components_chain(spark):
    # a long chain converges to one component labelled by its smallest id
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    comp = DEN.connected_components(edges)
    assert comp.select(F.countDistinct("component")).first()[0] == 1
    assert comp.agg(F.max("component")).first()[0] == 0


def _nearest(pts, i, k, dist=math.dist):
    return sorted((dist(pts[i], q), j) for j, q in enumerate(pts) if j != i)[:k]


def test_knn_many_dimensions_copies_and_outlier(spark):
    rnd = random.Random(9)
    pts = [tuple(rnd.gauss(0, 1) for _ in range(10)) for _ in range(60)]
    pts += [pts[0]] * 8 + [(1e6,) * 10]
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(pts)] + [(999, None)], "vec_id long, x array<double>")
    got = {(r.src, r.rank): (r.dst, r.dist) for r in DEN.knn(df, 4, slab_rows=8).collect()}
    assert len(got) == 4 * len(pts)
    for i in range(len(pts)):
        for rank, (d, j) in enumerate(_nearest(pts, i, 4), 1):
            assert got[i, rank][0] == j and abs(got[i, rank][1] - d) < 1e-6
    labels = {r.vec_id: r.cluster_id for r in DEN.density_cluster(df, 3.0, 4, 4).collect()}
    assert labels.pop(999) == -1 and labels == _brute_dbscan(pts, 3.0, 4, 4)


def test_knn_cosine(spark):
    rnd = random.Random(4)
    pts = [tuple(rnd.gauss(0, 1) for _ in range(5)) for _ in range(40)]
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(pts)] + [(99, [0.0] * 5)], "vec_id long, x array<double>")
    got = {(r.src, r.rank): r.dst for r in DEN.knn(df, 3, metric="cosine", slab_rows=8).collect()}
    assert got == {(i, n): j for i in range(40) for n, (_, j) in enumerate(_nearest(pts, i, 3, cos), 1)}


def test_few_and_equal_points(spark):
    few = _points(spark, [(0, 0), (1, 0), (0, 5), (9, 9)])
    assert DEN.knn(few, 5).count() == 12
    assert DEN.knn(few.limit(0), 5).count() == 0 and DEN.density_cluster(few.limit(0), 1.0).count() == 0
    equal = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    near = DEN.knn(equal, 3).groupBy("dst").count().collect()
    assert {r.dst: r["count"] for r in near} == {0: 3999, 1: 3999, 2: 3999, 3: 3}
    assert [tuple(r) for r in DEN.density_cluster(equal, 0.5).groupBy("cluster_id").count().collect()] == [(0, 4000)]


def test_dense_ball_gives_few_links(spark):
    """4,000 different points inside one eps ball: links grow with the points, not with their pairs."""
    pts = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.rand(3) / 100, F.rand(4) / 100, F.rand(5) / 100, F.rand(6) / 100).alias("x"))
    pts = pts.checkpoint()
    core, links = DEN._core_links(pts.select(F.col("vec_id").alias("id"), "x", F.lit(1).cast("long").alias("n")), 0.5, 5, 500)
    assert core.count() == 4000
    blocks = 4000 // 500 * 3  # cells are cut into blocks of at most 500 rows
    assert links.count() <= 4000 * blocks
    assert [tuple(r) for r in DEN.density_cluster(pts, 0.5).groupBy("cluster_id").count().collect()] == [(0, 4000)]


def test_blocks_skip_far_cells(spark):
    from gleaner.operators import tiles
    rnd = random.Random(2)
    rows = [(i, [c * 100.0 + rnd.random() for _ in range(6)]) for i, c in enumerate([0, 1, 2, 3] * 100)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    blocks = tiles.Blocks(df, 40)
    met = {(r.cell, r.other) for r in blocks.partners(5.0).collect()}
    group = [round(p[0] / 100 - 0.005) for p in blocks.pivots]
    assert met and all(group[a] == group[b] for a, b in met)
    pairs = {(r.src, r.dst) for r in DEN.eps_neighbors(df.withColumnRenamed("id", "vec_id"), 0.9).collect()}
    assert pairs == {(i, j) for i, p in rows for j, q in rows if i != j and math.dist(p, q) <= 0.9}


def test_many_copied_vectors_are_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(DEN, "COPIED_VECTORS", 0)
    pts = [(0.0, 0.0)] * 30 + [(1.0, 0.0)] * 3 + [(5.0, 5.0)]
    got = {r.vec_id: r.cluster_id for r in DEN.density_cluster(_points(spark, pts), 0.5, 3, 3).collect()}
    assert got == _brute_dbscan(pts, 0.5, 3, 3)


def _brute_tree(pts, min_samples):
    n = len(pts)
    core = [sorted(math.dist(p, q) for q in pts)[min_samples - 1] for p in pts]
    edges = sorted((max(core[i], core[j], math.dist(pts[i], pts[j])), i, j) for i in range(n) for j in range(i + 1, n))
    root, tree = list(range(n)), []
    for w, i, j in edges:
        a, b = root[i], root[j]
        if a != b:
            tree.append((w, i, j))
            root = [a if r == b else r for r in root]
    return tree


def _parts(edges, n, limit):
    root = list(range(n))
    for w, i, j in edges:
        if w <= limit and root[i] != root[j]:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_reachability_tree_matches_brute_force(spark):
    pts = _rand_pts(7, 120) + [(50.0, 50.0)]
    got = sorted((round(r.w, 9), r.u, r.v) for r in DEN.reachability_tree(_points(spark, pts), 4, rows=16).collect())
    assert got == sorted((round(w, 9), i, j) for w, i, j in _brute_tree(pts, 4))


def test_reachability_tree_ties_copies_nulls_and_few_points(spark):
    grid = [(float(x), float(y)) for x in range(6) for y in range(6)] + [(0.0, 0.0)] * 5 + [(20.0, 20.0)] * 3
    got = [(r.w, r.u, r.v) for r in DEN.reachability_tree(_points(spark, grid).union(
        spark.createDataFrame([(999, None)], "vec_id long, x array<double>")), 3, rows=8).collect()]
    want = _brute_tree(grid, 3)
    assert len(got) == len(grid) - 1 and sorted(w for w, *_ in got) == sorted(w for w, *_ in want)
    for limit in (0.0, 1.0, 2.0, 30.0):
        assert _parts(got, len(grid), limit) == _parts(want, len(grid), limit)
    assert DEN.reachability_tree(_points(spark, [(0, 0), (1, 1)]), 3).count() == 0
    assert DEN.reachability_tree(_points(spark, [(0, 0)]).limit(0), 3).count() == 0


def test_tree_cuts_are_density_clusters(spark):
    pts = _rand_pts(2, 120)
    df = _points(spark, pts)
    tree = DEN.reachability_tree(df, 4).checkpoint()
    for eps in (0.03, 0.06):
        got = {r.vec_id: r.cluster_id for r in DEN.tree_clusters(df, tree, eps, 5).collect()}
        assert got == _brute_dbscan(pts, eps, 4, 5) and max(got.values()) > 0
    assert {r.cluster_id for r in DEN.tree_clusters(df, tree.limit(0), 1.0).collect()} == {-1}


def test_few_edges_and_rounds_agree(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(60), rnd.randrange(60), float(rnd.randrange(9))) for _ in range(70)]
    edges = spark.createDataFrame(rows, "u long, v long, w double").checkpoint()
    sort = lambda df: sorted(tuple(r) for r in df.collect())
    assert sort(DEN.minimum_tree(edges)) == sort(DEN.minimum_tree(edges, task_edges=10)) == sort(DEN.minimum_tree(edges, task_edges=0))
    assert sort(DEN.connected_components(edges, src="u", dst="v")) == sort(DEN.connected_components(edges, src="u", dst="v", task_edges=0))


def test_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1, float(i % 7)) for i in range(100)], "u long, v long, w double").checkpoint()
    spark.sparkContext.setJobGroup("few-edges", "tree and components of few edges")
    try:
        assert DEN.minimum_tree(edges).count() == 100
        assert DEN.connected_components(edges, src="u", dst="v").count() == 101
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) < 20


def test_copies_of_a_point_do_not_grow_with_the_points(spark):
    from gleaner.operators import tiles
    copies = []
    for n in (2000, 16000):
        df = spark.range(n).select("id", F.array(*[F.rand(i).cast("float") for i in range(12)]).alias("x")).checkpoint()
        blocks = tiles.Blocks(df, 64)
        copies.append(blocks.tiles(1e9).count() / n)
        held = blocks.table.groupBy("block").count().agg(F.max("count")).first()[0]
        assert blocks.groups <= 2 * tiles.GROUPS and held <= 2 * n / tiles.GROUPS
        assert dict(blocks.table.dtypes)["x"] == "array<float>"
    assert copies[1] <= copies[0] * 1.2 and copies[1] <= 2 * tiles.GROUPS


def test_blocks_of_bounded_bytes(spark, monkeypatch):
    from gleaner.operators import tiles
    monkeypatch.setattr(tiles, "BLOCK_BYTES", 20 * 2 * 8)  # 20 rows
    pts = _rand_pts(5, 200)
    got = {(r.src, r.rank): r.dst for r in DEN.knn(_points(spark, pts), 3, slab_rows=500).collect()}
    assert got == {(i, n): j for i in range(200) for n, (_, j) in enumerate(_nearest(pts, i, 3), 1)}


def _measured(monkeypatch, n):
    """(pairs that a search, a count and a join of n points measure; whether all agree with brute force)."""
    import numpy as np

    from gleaner.operators import tiles
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3)) * np.where(rng.random(n) < 0.5, 0.3, 1.0)[:, None]
    pairs = [0]
    may, squares = tiles._may_reach, tiles.squares
    monkeypatch.setattr(tiles, "_may_reach", lambda a, b, far: (pairs.__setitem__(0, pairs[0] + len(a) * len(b)), may(a, b, far))[1])
    monkeypatch.setattr(tiles, "squares", lambda a, b: (pairs.__setitem__(0, pairs[0] + len(a) * len(b)), squares(a, b))[1])
    rows, eps, need = np.arange(n), 0.2, 5
    held = np.zeros(n, np.int64)
    tiles.add_close(x, rows, rows, np.ones(n, np.int64), eps, need, held)
    near = {}
    for i, j, d in tiles.nearest(x, rows, rows, rows, need):
        for a, b, c in zip(i.tolist(), j.tolist(), d.tolist()):
            near.setdefault(a, []).append((c, b))
    root = tiles.linked(x, rows, rows, rows, eps)
    monkeypatch.undo()
    apart = np.stack([tiles.exact(np.broadcast_to(p, x.shape), x) for p in x])
    best = np.argsort(apart, axis=1, kind="stable")[:, :need]
    right = near == {i: [(float(apart[i, j]), int(j)) for j in best[i]] for i in range(n)}
    right &= bool(((held >= need) == ((apart <= eps).sum(axis=1) >= need)).all())
    label, old = rows, None
    while old is None or (label != old).any():
        old, label = label, np.where(apart <= eps, label[None, :], n).min(axis=1)
    return pairs[0], right and bool((label == root).all())


def test_tiles_measure_few_of_all_pairs(monkeypatch):
    few, right = _measured(monkeypatch, 1000)
    many, also = _measured(monkeypatch, 4000)
    assert right and also
    assert many < 9 * few  # all pairs: 16 times


def test_links_do_not_grow_with_the_tiles(spark):
    """Dense points in many blocks: one link a point and one for each pair of blocks, not one for each tile of a point."""
    pts = spark.range(4000).select("id", F.array(*[F.rand(i) / 100 for i in range(4)]).alias("x"), F.lit(1).cast("long").alias("n")).checkpoint()
    core, links = DEN._core_links(pts, 0.5, 5, 500)
    assert core.count() == 4000 and links.count() <= 4000 + 32 * 32 / 2


def _estimate(df):
    return float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())


def test_rounds_keep_the_estimated_size(spark):
    """A join's estimated size is the product of its sides: carried on through rounds it would be a number of thousands of digits."""
    edges = spark.createDataFrame([(i, i + 1, float(i % 7)) for i in range(100)], "u long, v long, w double").checkpoint()
    assert _estimate(DEN.minimum_tree(edges, task_edges=0)) < 64
    assert _estimate(DEN.connected_components(edges, src="u", dst="v", task_edges=0)) < 256


@pytest.mark.parametrize("kind", ["blobs", "grid", "equal distances", "far from zero"])
def test_joined_trees_are_the_spanning_tree(kind, monkeypatch):
    """Trees of halves, joined over and over, give the same edges as Kruskal over all pairs, ties included, from few measured pairs."""
    import numpy as np

    from gleaner.operators import spanning, tiles
    rng = np.random.default_rng(3)
    x = {"blobs": lambda: np.concatenate([rng.normal(size=(150, 8)) * s + c for c, s in ((0, 1), (9, 0.1), (9.5, 0.5))]),
         "grid": lambda: np.array([(i, j) for i in range(18) for j in range(18)], float),
         "equal distances": lambda: np.eye(200), "far from zero": lambda: rng.random((300, 3)) * 1e5 + 1e8}[kind]()
    n = len(x)
    i, j = np.triu_indices(n, 1)
    d = tiles.exact(x[i], x[j])
    apart = np.zeros((n, n))
    apart[i, j] = apart[j, i] = d
    core = np.sort(apart, axis=1)[:, 4]
    w = np.maximum(np.maximum(core[i], core[j]), d)
    root, want = np.arange(n), []
    for e in np.lexsort((j, i, w)):
        if root[i[e]] != root[j[e]]:
            want.append((w[e], i[e], j[e]))
            root[root == root[j[e]]] = root[i[e]]
    measured = [0]
    exact = tiles.exact
    monkeypatch.setattr(tiles, "exact", lambda a, b: (measured.__setitem__(0, measured[0] + len(a)), exact(a, b))[1])
    _, _, w, u, v = spanning.whole(x, core, rng.permutation(n)).edges()
    assert sorted(zip(w, u, v)) == want
    if kind == "blobs":
        assert measured[0] < n * (n - 1) / 4


def test_tiles_have_whole_blocks(spark):
    """Blocks that meet in one pair of cells have all rows in their tile."""
    from gleaner.operators import tiles
    df = spark.range(2000).select("id", F.array(*[F.rand(i) for i in range(2)]).alias("x")).checkpoint()
    blocks = tiles.Blocks(df, 64)
    size = {r["block"]: r["count"] for r in blocks.table.groupBy("block").count().collect()}
    met = blocks.tiles(0.05, own=False, whole=True).groupBy("lo", "hi", "side").count().collect()
    assert 0 < len(met) < blocks.groups * (blocks.groups - 1)
    assert all(r["count"] == size[(r["lo"], r["hi"])[r["side"]]] for r in met)
