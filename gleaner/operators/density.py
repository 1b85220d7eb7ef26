"""Density clusters on vectors.

The reference calls a single-machine hierarchical density library.  Here
the pieces are distributed DataFrame jobs:

* ``eps_neighbors`` - exact pairs within ``eps``.  Up to three dimensions,
  points are hashed to grid cells of side ``eps`` and each probes the cells
  around it; beyond, blocks around pivots meet in tiles (``tiles``).
* ``knn`` - exact k nearest neighbours of whole vectors in any dimension,
  Euclidean or cosine.  Equal vectors count as one point until the end.  A
  block first searches itself; the k-th distance found there bounds how far
  the cell has to look, and only cells that the triangle inequality leaves are
  met.  With many dimensions and no structure every exact search compares most
  pairs; work per task stays bounded by two blocks.
* ``connected_components`` - large-star / small-star rounds (Kiveris et al.
  2014) on an edge table, each round stored in the shared folder.
* ``density_cluster`` - DBSCAN* on core points: a point with at least
  ``min_samples`` points (itself included) within ``eps`` is core, core
  points within ``eps`` are linked, components with fewer than
  ``min_cluster_size`` members and all border points are noise (-1).
  Cluster ids are size ranks (ties by smallest member).
* ``reachability_tree`` - the exact minimum spanning tree of mutual
  reachability: trees of blocks, joined two by two (``spanning``), then
  Boruvka rounds on the edge table.
* ``outlier_score`` - ``1 - d_min / d`` with d the core distance and d_min
  the smallest core distance in the cluster (GLOSH with lambda = 1/d).
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import spanning, tiles
from gleaner.session import checkpoint_dir, stored


def _offsets(d: int, r: int) -> F.Column:
    offs = [list(o) for o in itertools.product(range(-r, r + 1), repeat=d)]
    return F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])


def _cell(vec: str, h: float) -> F.Column:
    return F.transform(F.col(vec), lambda v: F.floor(v.cast("double") / F.lit(float(h))))


def _dist(a: str, b: str) -> F.Column:
    def sq_diff(x, y):
        dd = x.cast("double") - y.cast("double")
        return dd * dd
    sq = F.zip_with(F.col(a), F.col(b), sq_diff)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def _dims(points: DataFrame, vec: str) -> int:
    return points.select(F.max(F.size(vec))).first()[0] or 0


def eps_neighbors(points: DataFrame, eps: float, id_col: str = "vec_id", vec: str = "x",
                  dims: int | None = None) -> DataFrame:
    """``(src, dst, dist)`` for every ordered pair of distinct points within ``eps``."""
    d = dims or _dims(points, vec)
    if d > 3:
        return _eps_by_tiles(points, eps, id_col, vec)
    p = points.select(id_col, vec, _cell(vec, eps).alias("cell"))
    probe = p.select(F.col(id_col).alias("src"), F.col(vec).alias("xs"),
                     F.explode(_offsets(d, 1)).alias("off"), "cell") \
             .select("src", "xs", F.zip_with("cell", "off", lambda c, o: c + o).alias("cell"))
    cand = probe.join(p.select(F.col(id_col).alias("dst"), F.col(vec).alias("xd"), "cell"), "cell")
    return (cand.filter(F.col("src") != F.col("dst"))
                .select("src", "dst", _dist("xs", "xd").alias("dist"))
                .filter(F.col("dist") <= F.lit(float(eps))))


# ------------------------------------------------------------------- tiles
#: Vectors with copies are broadcast up to this many.
COPIED_VECTORS = 20_000
_SALTS = 32


def _vectors(points: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, x) with float or double vectors; null vectors and such with null or NaN parts are left out."""
    x = F.col(vec) if dict(points.dtypes)[vec] == "array<float>" else F.transform(vec, lambda v: v.cast("double"))
    p = points.select(F.col(id_col).alias("id"), x.alias("x"))
    return p.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _representatives(p: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, rep) of p(id, x): the point that stands for all equal vectors; groups(x, rep, n).

    Only vectors with copies are looked up: by broadcast where they are few,
    else spread over salts, so that a much copied vector is not one key.
    """
    copied = groups.filter("n > 1").select("x", "rep")
    if copied.limit(COPIED_VECTORS + 1).count() <= COPIED_VECTORS:
        joined = p.join(F.broadcast(copied), "x", "left")
    else:
        spread = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(spread, ["x", "salt"], "left")
    return joined.select("id", F.coalesce("rep", "id").alias("rep"))


def _eps_by_tiles(points: DataFrame, eps: float, id_col: str, vec: str) -> DataFrame:
    import pyarrow as pa

    checkpoint_dir(points.sparkSession)
    blocks = tiles.Blocks(_vectors(points, id_col, vec))
    id_type = dict(points.dtypes)[id_col]
    met = blocks.near(eps)

    def pairs(table):
        a, b, own = tiles.split(table)
        x, ids, cell = tiles.matrix(table["x"]), table["id"].combine_chunks(), table["cell"].to_numpy()
        src, dst, dist = [], [], []
        for one, two in tiles.pieces(cell, a, b, met):
            for i, j, d in tiles.close_pairs(x[one], x[two], float(eps)):
                src.append(one[i]), dst.append(two[j]), dist.append(d)
                if not own:
                    src.append(two[j]), dst.append(one[i]), dist.append(d)
        src, dst, dist = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (src, dst, dist))
        keep = src != dst
        return pa.table({"src": ids.take(pa.array(src[keep])), "dst": ids.take(pa.array(dst[keep])), "dist": pa.array(dist[keep].astype(float))})

    return blocks.tiles(eps).groupBy("lo", "hi").applyInArrow(pairs, f"src {id_type}, dst {id_type}, dist double")


def knn(points: DataFrame, k: int, id_col: str = "vec_id", vec: str = "x", include_self: bool = False,
        metric: str = "euclidean", slab_rows: int = tiles.BLOCK_ROWS) -> DataFrame:
    """Exact k nearest neighbours ``(src, dst, dist, rank)`` (ties by dst); all others where there are fewer.

    ``metric="cosine"`` gives 1 - cosine.  Null vectors, and zero vectors
    under cosine, take no part.  Ids are distinct.
    """
    checkpoint_dir(points.sparkSession)
    p = _vectors(points, id_col, vec)
    if metric == "cosine":
        p = p.withColumn("x", F.transform("x", lambda v: v.cast("double")))
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v))
        p = p.withColumn("n", norm).filter("n > 0").select("id", F.transform("x", lambda v: v / F.col("n")).alias("x"))
    elif metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    need = k if include_self else k + 1
    # equal vectors: one point, with its `need` smallest ids
    first = Window.partitionBy("x").orderBy("id")
    groups = (p.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= need)
               .groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("members"))
               .select(F.col("members")[0].alias("rep"), "x", "members").checkpoint(eager=True))
    if groups.isEmpty():
        t = dict(points.dtypes)[id_col]
        return points.sparkSession.createDataFrame([], f"src {t}, dst {t}, dist double, rank int")
    found = _nearest_by_tiles(groups.select(F.col("rep").alias("id"), "x"), need, slab_rows)
    nearest = Window.partitionBy("src").orderBy("dist", "dst")
    out = groups.select(F.col("rep").alias("dst"), "members")
    res = (found.join(out, "dst").select("src", F.explode("members").alias("dst"), "dist")
                .withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= need).drop("rank"))
    who = _representatives(p, groups.select("x", "rep", F.size("members").alias("n"))).withColumnRenamed("rep", "src")
    res = who.join(res, "src").select(F.col("id").alias("src"), "dst", "dist")
    if not include_self:
        res = res.filter(F.col("src") != F.col("dst"))
    res = res.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    dist = F.col("dist") * F.col("dist") / 2 if metric == "cosine" else F.col("dist")
    return res.select("src", "dst", dist.alias("dist"), F.col("rank").cast("int").alias("rank"))


def _nearest_by_tiles(points: DataFrame, k: int, rows: int) -> DataFrame:
    """(src, dst, dist): the k nearest points of each of points(id, x), itself included, ties by id."""
    import pyarrow as pa

    blocks = tiles.Blocks(points, rows)
    id_type = dict(points.dtypes)["id"]

    def search(table):
        a, b, own = tiles.split(table)
        x, ids = tiles.matrix(table["x"]), table["id"].combine_chunks()
        order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        bound = None if own else table["bound"].to_numpy()
        sides = ((a, b),) if own else ((a, b), (b, a))
        found = [piece for one, two in sides for piece in tiles.nearest(x, one, two, order, k, bound)]
        src, dst, dist = (np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        return pa.table({"src": ids.take(pa.array(src)), "dst": ids.take(pa.array(dst)), "dist": pa.array(dist.astype(float))})

    schema = f"src {id_type}, dst {id_type}, dist double"
    first = blocks.own_tiles().groupBy("lo", "hi").applyInArrow(search, schema).checkpoint(eager=True)
    if blocks.groups == 1:
        return first
    # how far each point has to look, and its cell: the k-th distance, unbounded where a block has fewer
    kth = first.groupBy(F.col("src").alias("id")).agg(
        F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    table = blocks.table.join(kth, "id").select(*blocks.table.columns, "bound").checkpoint(eager=True)
    reach = np.full(len(blocks.pivots), 0.0)
    for r in table.groupBy("cell").agg(F.max("bound").alias("d")).collect():  # one row a pivot
        reach[r["cell"]] = r["d"]
    more = blocks.tiles(reach, own=False, table=table).groupBy("lo", "hi").applyInArrow(search, schema)
    best = Window.partitionBy("src").orderBy("dist", "dst")
    return (first.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
            .checkpoint(eager=True))


#: Edges that one task takes; more take rounds of jobs.
TASK_EDGES = 131_072


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _numbers(u, v):
    """(sorted ids, place of u, place of v) of two Arrow columns of ids."""
    import pyarrow as pa
    import pyarrow.compute as pc

    u, v = u.combine_chunks(), v.combine_chunks()
    ids = pa.concat_arrays([u, v]).unique()
    ids = ids.take(pc.sort_indices(ids))
    return ids, pc.index_in(u, ids).to_pylist(), pc.index_in(v, ids).to_pylist()


def _task_components(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges(u, v), in one task."""
    import pyarrow as pa

    def body(table):
        ids, u, v = _numbers(table["u"], table["v"])
        root = list(range(len(ids)))
        for a, b in zip(u, v):
            a, b = _find(root, a), _find(root, b)
            root[max(a, b)] = min(a, b)
        return pa.table({"node": ids, "component": ids.take(pa.array([_find(root, x) for x in range(len(ids))], pa.int64()))})

    kind = dict(edges.dtypes)["u"]
    return edges.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(body, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src",
                         dst: str = "dst", max_rounds: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(node, component)`` with component = smallest node id of its component.

    Large-star then small-star until the edge set stops changing; each
    round's edges are stored (shared folder) so lineage stays short and a lost
    executor recomputes one round only.  ``max_rounds`` is a
    guard: reaching it unconverged raises, it never cuts the result.  Without
    it at most ``task_edges`` edges are joined in one task instead: their
    rounds are jobs over few rows, and every job costs the driver memory.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u") != F.col("v"))
    e = stored(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if max_rounds is None and not dict(e.dtypes)["u"].startswith("struct") and e.limit(task_edges + 1).count() <= task_edges:
        return _with_singles(stored(_task_components(e)), nodes)
    rounds = 0
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
        rounds += 1
        # large-star: each node links its larger neighbours to its smallest neighbour-or-self
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        ls = (sym.join(m, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("a"), F.col("m").alias("b")))
        ls = ls.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")) \
               .filter(F.col("u") != F.col("v")).distinct()
        # small-star: each node links itself and its smaller neighbours to the smallest of them
        down = ls.select(F.col("v").alias("u"), F.col("u").alias("v"))  # v < u
        m2 = down.groupBy("u").agg(F.min("v").alias("m"))
        ss = down.join(m2, "u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
                 .unionByName(m2.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = stored(ss.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
                   .filter(F.col("u") != F.col("v")).distinct())
        # converged when the edges form a star forest: no node is both a
        # centre (u) and a leaf (v), and every leaf hangs on one centre only
        centre_is_leaf = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() > 0
        if not centre_is_leaf:
            multi = e.groupBy("v").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > 1).limit(1).count() > 0
            if not multi:
                break
    comp = e.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    roots = e.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    comp = comp.unionByName(roots.join(comp.select("node"), "node", "left_anti"))
    return _with_singles(comp.groupBy("node").agg(F.min("component").alias("component")), nodes)


def _with_singles(comp: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is not None:
        singles = nodes.select(F.col(nodes.columns[0]).alias("node")).join(comp, "node", "left_anti") \
                       .withColumn("component", F.col("node"))
        comp = comp.unionByName(singles)
    return comp


def core_points(points: DataFrame, eps: float, min_samples: int, id_col: str = "vec_id",
                vec: str = "x", weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(core ids with neighbour counts, eps pairs).  The point itself counts; ``weight`` is a point's multiplicity."""
    pairs = eps_neighbors(points, eps, id_col, vec)
    n = points.select(F.col(id_col).alias("src"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    counts = pairs.join(n.withColumnsRenamed({"src": "dst"}), "dst").groupBy("src").agg(F.sum("_w").alias("_n"))
    nb = n.join(counts, "src", "left").select("src", (F.coalesce("_n", F.lit(0)) + F.col("_w")).alias("n_neighbors"))
    core = nb.filter(F.col("n_neighbors") >= min_samples)
    return core, pairs


def density_cluster(points: DataFrame, eps: float, min_samples: int = 5, min_cluster_size: int = 5,
                    id_col: str = "vec_id", vec: str = "x") -> DataFrame:
    """``(vec_id, cluster_id)`` for every point; -1 is noise (DBSCAN*), null vectors included.

    Equal vectors are one point with a multiplicity, so copies make no pairs.
    """
    checkpoint_dir(points.sparkSession)
    p = _vectors(points, id_col, vec)
    groups = p.groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("n")).checkpoint(eager=True)
    ids, edges = _core_links(groups.select(F.col("rep").alias("id"), "x", "n"), eps, min_samples)
    comp = connected_components(edges, ids)
    sizes = (comp.join(groups.select(F.col("rep").alias("node"), "n"), "node")
                 .groupBy("component").agg(F.sum("n").alias("size")))
    big = sizes.filter(F.col("size") >= min_cluster_size)
    # cluster ids = rank by size desc, smallest member (= component id) first.
    # The number of clusters grows with the data, so the rank is a global
    # sort plus distributed positional ids, not a single-partition window.
    from gleaner.operators.reviews import assign_row_id
    ranked = assign_row_id(big.orderBy(F.col("size").desc(), F.col("component")), "_rank") \
        .withColumn("cluster_id", F.col("_rank").cast("int"))
    labels = comp.join(ranked.select("component", "cluster_id"), "component").select(F.col("node").alias("rep"), "cluster_id")
    who = _representatives(p, groups).withColumnRenamed("id", id_col)
    return (points.select(id_col).join(who.join(labels, "rep").select(id_col, "cluster_id"), id_col, "left")
                  .select(id_col, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")))


def _core_links(points: DataFrame, eps: float, min_samples: int, rows: int = tiles.BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(core ids, links (src, dst) whose components are those of all core pairs within eps) of points(id, x, n).

    Blocks are counted alone first; only rows that lack neighbours there look
    further.  Core points get the smallest id they hang together with in their
    block; then tiles of two blocks link those ids, so there is at most one
    link a row besides the few that join blocks, however dense the region is.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    blocks = tiles.Blocks(points, rows)
    id_type = dict(points.dtypes)["id"]
    columns, schema = blocks.table.columns, ", ".join(f"`{c}` {t}" for c, t in blocks.table.dtypes)

    def count(table):
        a, b, own = tiles.split(table)
        x, n = tiles.matrix(table["x"]), table["n"].to_numpy()
        before = np.zeros(len(x), np.int64) if own else table["c"].to_numpy()
        held = before.copy()
        tiles.add_close(x, a, b, n, float(eps), min_samples, held)
        if own:
            return table.select(columns).append_column("c", pa.array(held))
        tiles.add_close(x, b, a, n, float(eps), min_samples, held)
        more = np.flatnonzero(held > before)
        return pa.table({"id": table["id"].combine_chunks().take(pa.array(more)), "c": pa.array((held - before)[more])})

    def hang(table):
        table = table.sort_by("id")
        x, ids = tiles.matrix(table["x"]), table["id"].combine_chunks()
        at = np.arange(len(x))
        return table.select(columns).append_column("label", ids.take(pa.array(tiles.linked(x, at, at, at, float(eps)))))

    def join(table):
        a, b, _ = tiles.split(table)
        labels = table["label"].combine_chunks()
        names = labels.unique()
        names = names.take(pc.sort_indices(names))
        root = tiles.linked(tiles.matrix(table["x"]), a, b, pc.index_in(labels, names).to_numpy().astype(np.int64), float(eps))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"src": names.take(pa.array(root[moved])), "dst": names.take(pa.array(moved))})

    held = blocks.own_tiles().groupBy("lo", "hi").applyInArrow(count, schema + ", c long").checkpoint(eager=True)
    core = held.filter(F.col("c") >= min_samples)
    if blocks.groups > 1:
        # only cells with rows that lack neighbours look into other blocks
        reach = np.full(len(blocks.pivots), -np.inf)
        for r in held.groupBy("cell").agg(F.min("c").alias("c")).collect():  # one row a pivot
            if r["c"] < min_samples:
                reach[r["cell"]] = eps
        more = blocks.tiles(reach, own=False, table=held).groupBy("lo", "hi").applyInArrow(count, f"id {id_type}, c long")
        few = held.filter(F.col("c") < min_samples)
        late = (few.select("id", "c").unionByName(more).groupBy("id").agg(F.sum("c").alias("c"))
                .filter(F.col("c") >= min_samples).select("id"))
        core = core.unionByName(few.join(late, "id", "left_semi").select(*held.columns))
    core = core.select(*columns).checkpoint(eager=True)
    known = blocks.own_tiles(core).groupBy("lo", "hi").applyInArrow(hang, f"{schema}, label {id_type}").checkpoint(eager=True)
    links = known.filter(F.col("label") != F.col("id")).select(F.col("label").alias("src"), F.col("id").alias("dst"))
    if blocks.groups > 1:
        links = links.unionByName(blocks.tiles(eps, own=False, table=known).groupBy("lo", "hi")
                                  .applyInArrow(join, f"src {id_type}, dst {id_type}"))
    return core.select("id"), links.checkpoint(eager=True)


def outlier_score(labels: DataFrame, neighbors: DataFrame, min_samples: int, id_col: str = "vec_id",
                  floor: float = 1e-12) -> DataFrame:
    """``(vec_id, cluster_id, core_dist, outlier)`` in [0, 1], 0 = most central.

    ``neighbors`` is ``knn(..., include_self=True)`` with k >= min_samples; the
    core distance is the distance to the ``min_samples``-th point (itself
    included).  Noise scores 1.  The cluster minimum is a grouped aggregate
    joined back, not a window over a possibly huge cluster.
    """
    cd = neighbors.filter(F.col("rank") == min_samples).select(F.col("src").alias(id_col),
                                                              F.col("dist").alias("core_dist"))
    lab = labels.join(cd, id_col, "left").select(id_col, "cluster_id", "core_dist")
    # noise needs no cluster minimum, and would be the hot key of that join
    noise = lab.filter(F.col("cluster_id") == -1).withColumn("outlier", F.lit(1.0))
    own = lab.filter(F.col("cluster_id") != -1)
    dmin = own.groupBy("cluster_id").agg(F.min("core_dist").alias("_dmin"))
    d = F.greatest(F.col("core_dist"), F.lit(floor))
    score = 1 - F.greatest(F.col("_dmin"), F.lit(floor)) / d
    scored = own.join(dmin, "cluster_id").select(id_col, "cluster_id", "core_dist", score.alias("outlier"))
    return scored.unionByName(noise)


def reachability_tree(points: DataFrame, min_samples: int = 5, id_col: str = "vec_id", vec: str = "x",
                      rows: int = tiles.BLOCK_ROWS) -> DataFrame:
    """``(u, v, w)``, u < v: the minimum spanning tree of mutual reachability, ties by (w, u, v).

    w is the largest of both core distances (to the ``min_samples``-th point,
    itself included) and the distance.  Null vectors take no part; equal
    vectors hang on the smallest id of their group.  With fewer than
    ``min_samples`` points there are no core distances and the tree is empty.

    Each block gives the spanning tree of its own pairs, kept with its rows as
    a chain; then each tile joins the trees of two blocks and gives the edges
    across, less than one a row: an edge of the whole tree is in the tree of
    any blocks that hold it.  The pivots and their cells span all points, so no
    edge of the tree is longer than the longest of those, and blocks of which
    all cells are further apart do not meet.  What the tiles leave is reduced
    by Boruvka rounds on the edge table.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    checkpoint_dir(points.sparkSession)
    p = _vectors(points, id_col, vec)
    id_type = dict(p.dtypes)["id"]
    schema = f"u {id_type}, v {id_type}, w double"
    groups = p.groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("n")).checkpoint(eager=True)
    near = knn(p.select(F.col("id").alias("vec_id"), "x"), min_samples, include_self=True)
    core = near.filter(F.col("rank") == min_samples).select(F.col("src").alias("id"), F.col("dist").alias("core"))
    core = core.checkpoint(eager=True)
    reps = groups.select(F.col("rep").alias("id"), "x").join(core, "id").checkpoint(eager=True)
    top = reps.agg(F.max("core").alias("core")).first()["core"]
    if top is None:
        return points.sparkSession.createDataFrame([], schema)
    blocks = tiles.Blocks(reps, rows)
    used = blocks.parts > 0
    reach = max(top, float(blocks.radius.max()), _longest_link(blocks.pivots[used]))

    columns = blocks.table.columns
    kept = schema.replace("u ", "gu ").replace(", v ", ", gv ").replace(", w ", ", gw ")

    def own_tree(table):
        table = table.sort_by("id")
        x, ids = tiles.matrix(table["x"]), table["id"].combine_chunks()
        chain = spanning.whole(x, table["core"].to_numpy(), np.arange(len(x)))
        ends = [ids.take(pa.array(end, mask=end < 0)) for end in (chain.u, chain.v)]
        held = table.select(columns).take(pa.array(chain.rows))
        for name, column in (("place", pa.array(np.arange(len(x)))), ("gu", ends[0]), ("gv", ends[1]), ("gw", pa.array(chain.w))):
            held = held.append_column(name, column)
        return held

    def across(table):
        table = table.sort_by("id")
        a, b, _ = tiles.split(table)
        x, ids, cores, places = tiles.matrix(table["x"]), table["id"].combine_chunks(), table["core"].to_numpy(), table["place"].to_numpy()
        u, v = (pc.fill_null(pc.index_in(table[end].combine_chunks(), ids, skip_nulls=True), -1).to_numpy().astype(np.int64) for end in ("gu", "gv"))
        w, sides = table["gw"].to_numpy(), []
        for side in (a, b):
            side = side[np.argsort(places[side])]
            sides.append(spanning.Chain(side, w[side], u[side], v[side]))
        chain = spanning.joined(x, cores, *sides)
        _, _, w, u, v = chain.edges()
        new = np.isin(u, a) != np.isin(v, a)
        return pa.table({"u": ids.take(pa.array(u[new])), "v": ids.take(pa.array(v[new])), "w": pa.array(w[new])})

    known = blocks.own_tiles().groupBy("lo", "hi").applyInArrow(
        own_tree, ", ".join(f"`{c}` {t}" for c, t in blocks.table.dtypes) + f", place long, {kept}").checkpoint(eager=True)
    local = known.filter(F.col("gu").isNotNull()).select(F.col("gu").alias("u"), F.col("gv").alias("v"), F.col("gw").alias("w"))
    if blocks.groups > 1:
        local = local.unionByName(blocks.tiles(reach, own=False, table=known, whole=True).groupBy("lo", "hi").applyInArrow(across, schema)).checkpoint(eager=True)
    copies = (_representatives(p, groups).filter(F.col("id") != F.col("rep"))
              .join(core.withColumnRenamed("id", "rep"), "rep").select(F.col("rep").alias("u"), F.col("id").alias("v"), F.col("core").alias("w")))
    return minimum_tree(local).unionByName(copies)


def tree_clusters(points: DataFrame, tree: DataFrame, eps: float, min_cluster_size: int = 5, id_col: str = "vec_id") -> DataFrame:
    """``(vec_id, cluster_id)``: the clusters of a ``reachability_tree`` cut at ``eps``; -1 is noise.

    The same as ``density_cluster`` with the tree's ``min_samples``, for any
    number of ``eps`` from one tree.  ``min_cluster_size`` is at least 2.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    comp = connected_components(tree.filter(F.col("w") <= eps), src="u", dst="v")
    big = comp.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= min_cluster_size)
    from gleaner.operators.reviews import assign_row_id
    ranked = assign_row_id(big.orderBy(F.col("size").desc(), F.col("component")), "_rank")
    labels = comp.join(ranked, "component").select(F.col("node").alias(id_col), F.col("_rank").cast("int").alias("cluster_id"))
    return (points.select(id_col).join(labels, id_col, "left")
                  .select(id_col, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")))


def _longest_link(x: np.ndarray) -> float:
    """Longest edge of the spanning tree of a few points."""
    return float(spanning.whole(x, np.zeros(len(x)), np.arange(len(x))).edges()[2].max(initial=0.0))


def _task_tree(live: DataFrame) -> DataFrame:
    """(u, v, w) of the spanning forest of few edges(u, v, w, a, b) between a and b, in one task."""
    import pyarrow as pa

    def body(table):
        table = table.sort_by([("w", "ascending"), ("u", "ascending"), ("v", "ascending")])
        ids, a, b = _numbers(table["a"], table["b"])
        root, kept = list(range(len(ids))), []
        for i, (x, y) in enumerate(zip(a, b)):
            x, y = _find(root, x), _find(root, y)
            if x != y:
                root[x] = y
                kept.append(i)
        return table.select(["u", "v", "w"]).take(pa.array(kept, pa.int64()))

    kind = dict(live.dtypes)
    return live.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(body, f"u {kind['u']}, v {kind['v']}, w {kind['w']}")


def minimum_tree(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Minimum spanning forest of ``edges(u, v, w)``, ties by (w, u, v), by Boruvka rounds.

    Each round every component takes its smallest edge.  Those edges hold one
    pair of components that chose each other for each new component; its
    smaller one is the root, the others find it by pointer doubling.  Rounds
    halve the components at least.  Once at most ``task_edges`` edges are left
    between components, one task takes the rest.
    """
    checkpoint_dir(edges.sparkSession)
    live = stored(edges.filter(F.col("u") != F.col("v")).select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")))
    found = live.select("u", "v", "w").limit(0)
    while left := live.limit(task_edges + 1).count():
        if left <= task_edges:
            return stored(found.unionByName(_task_tree(live)))
        both = live.unionByName(live.select("u", "v", "w", F.col("b").alias("a"), F.col("a").alias("b")))
        best = stored(both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("m")).select("a", "m.*"))
        found = stored(found.unionByName(best.select("u", "v", "w").distinct()))
        back = best.select(F.col("a").alias("b"), F.col("b").alias("c"))
        to = stored(best.join(back, "b").select(F.col("a").alias("node"), F.when((F.col("a") == F.col("c")) & (F.col("a") < F.col("b")), F.col("a"))
                                                .otherwise(F.col("b")).alias("root")))
        while True:
            step = stored(to.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", "root", "next"))
            to = step.select("node", F.col("next").alias("root"))
            if not step.filter("root <> next").limit(1).count():
                break
        moved = live.join(to.toDF("a", "ra"), "a").join(to.toDF("b", "rb"), "b").filter(F.col("ra") != F.col("rb"))
        # of the edges between two components only the smallest can be in the tree
        live = stored(moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                      .agg(F.min(F.struct("w", "u", "v")).alias("m")).select("m.u", "m.v", "m.w", "a", "b"))
    return found
