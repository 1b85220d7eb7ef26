"""Variable-density clusters from the spanning tree of mutual reachability (HDBSCAN*, Campello et al. 2013).

``merge_tree`` turns the edges of a spanning tree into its single-linkage
merges, ``condensed_tree`` keeps the splits into parts of at least
``min_cluster_size`` points and picks the clusters of largest stability, and
``density_hierarchy`` labels the points.  Merges of equal weight happen at
once, so the result does not depend on which spanning tree is given.

A merge is named by the smallest id among its points and their number: of the
merges that hold a point, no two have the same number of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.density import connected_components, reachability_tree
from gleaner.operators.reviews import assign_row_id
from gleaner.session import checkpoint_dir, stored

TASK_EDGES = 131_072
SHORTEST = 1e-12  # densities are 1 / distance; equal points have the distance SHORTEST
PART = ("path", "part")


def merge_tree(tree: DataFrame, min_cluster_size: int, task_edges: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(edges(u, v, rep, size, h), links(rep, size, prep, psize)) of a connected tree(u, v, w).

    Every edge comes with the merge that it belongs to; ``links`` leads from a
    merge of at least ``min_cluster_size`` (>= 2) points to the one it is part of.

    Parts of more than ``task_edges`` edges are halved by weight: every
    component of the lighter half is a part of its own, and one point of the
    heavier half.  All parts of a round take the same jobs, so there are
    log2(edges / task_edges) rounds.  A part of one weight is one merge,
    however large; all other small parts are merged in tasks of about
    ``task_edges`` edges.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    checkpoint_dir(tree.sparkSession)
    id_type = dict(tree.dtypes)["u"]
    # a, b: the contracted points that the edge joins in its part; sa, sb: their sizes
    live = stored(tree.select(F.lit(1).cast("long").alias("path"), F.lit(None).cast(id_type).alias("part"), "u", "v",
                              F.col("w").cast("double").alias("w"), F.col("u").alias("a"), F.col("v").alias("b"),
                              F.lit(1).cast("long").alias("sa"), F.lit(1).cast("long").alias("sb")))
    (total, least_u), columns = live.agg(F.count("*"), F.min("u")).first(), live.columns
    live = live.withColumn("part", F.coalesce("part", F.lit(least_u).cast(id_type)))
    if total <= task_edges:
        return _merge_small(live, id_type, min_cluster_size, total, task_edges)
    small, flat = live.limit(0), live.limit(0)
    while live.limit(1).count():
        shape = live.groupBy(*PART).agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"),
                                        F.percentile_approx("w", 0.5, 10_000).alias("mid"))
        known = stored(live.join(shape, list(PART)))
        small = small.unionByName(known.filter(F.col("n") <= task_edges).select(columns))
        flat = flat.unionByName(known.filter((F.col("n") > task_edges) & (F.col("lo") == F.col("hi"))).select(columns))
        both = known.filter((F.col("n") > task_edges) & (F.col("lo") < F.col("hi")))
        if not both.limit(1).count():
            break
        is_light = F.when(F.col("mid") < F.col("hi"), F.col("w") <= F.col("mid")).otherwise(F.col("w") < F.col("hi"))
        both = stored(both.withColumn("light", is_light).select(*columns, "light"))
        live = stored(_halve(both).select(columns))
    edges, links = _merge_small(small, id_type, min_cluster_size, total, task_edges)
    whole, parts = _merge_flat(flat, min_cluster_size)
    return stored(edges.unionByName(whole)), stored(links.unionByName(parts))


def _ends(edges: DataFrame) -> DataFrame:
    """(path, part, node, s): the contracted points of each part."""
    return (edges.select(*PART, F.col("a").alias("node"), F.col("sa").alias("s"))
            .unionByName(edges.select(*PART, F.col("b").alias("node"), F.col("sb").alias("s"))).distinct())


def _halve(both: DataFrame) -> DataFrame:
    at = lambda c: F.struct(*PART, F.col(c).alias("node"))
    light, heavy = both.filter("light"), both.filter(~F.col("light"))
    comp = connected_components(light.select(at("a").alias("src"), at("b").alias("dst")))
    comp = comp.select("node.*", F.col("component.node").alias("rep"))
    held = _ends(light).join(comp, [*PART, "node"])
    sizes = held.groupBy(*PART, "rep").agg(F.sum("s").alias("size"))
    place = stored(comp.join(sizes, [*PART, "rep"]))
    down = (light.join(place.select(*PART, F.col("node").alias("a"), "rep"), [*PART, "a"])
            .withColumn("part", F.col("rep")).withColumn("path", F.col("path") * 2))
    for end, s in (("a", "sa"), ("b", "sb")):
        heavy = (heavy.join(place.withColumnRenamed("node", end), [*PART, end], "left")
                 .withColumn(end, F.coalesce("rep", end)).withColumn(s, F.coalesce("size", s)).drop("rep", "size"))
    return down.drop("rep").unionByName(heavy.withColumn("path", F.col("path") * 2 + 1))


def _merge_flat(flat: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Parts of one weight: one merge each, of all points of the part."""
    ends = _ends(flat)
    merged = ends.groupBy(*PART).agg(F.min("node").alias("rep"), F.sum("s").alias("size"))
    edges = flat.join(merged, list(PART)).select("u", "v", "rep", "size", F.col("w").alias("h"))
    links = ends.filter(F.col("s") >= least).join(merged, list(PART)).select(
        F.col("node").alias("rep"), F.col("s").alias("size"), F.col("rep").alias("prep"), F.col("size").alias("psize"))
    return edges, links


def _merge_small(small: DataFrame, id_type: str, least: int, total: int, task_edges: int) -> tuple[DataFrame, DataFrame]:
    import pandas as pd

    schema = f"u {id_type}, v {id_type}, child {id_type}, child_size long, rep {id_type}, size long, h double"
    names = [f.split()[0] for f in schema.split(", ")]

    def merge(table: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, part in table.sort_values(["path", "part", "w"]).groupby(["path", "part"], sort=False):
            root, rep, size, edges = {}, {}, {}, list(part[["u", "v", "w", "a", "b", "sa", "sb"]].itertuples(index=False, name=None))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for _, _, _, a, b, sa, sb in edges:
                for x, s in ((a, sa), (b, sb)):
                    root[x], rep[x], size[x] = x, x, s
            start = 0
            while start < len(edges):
                stop = start
                while stop < len(edges) and edges[stop][2] == edges[start][2]:
                    stop += 1
                run, h = edges[start:stop], float(edges[start][2])
                parts = {find(x): None for e in run for x in e[3:5]}
                before = {x: (rep[x], size[x]) for x in parts}
                for e in run:
                    x, y = find(e[3]), find(e[4])
                    if size[x] < size[y]:
                        x, y = y, x
                    root[y], size[x], rep[x] = x, size[x] + size[y], min(rep[x], rep[y])
                for x, (r, s) in before.items():
                    if s >= least:
                        rows.append((None, None, r, s, rep[find(x)], size[find(x)], h))
                for e in run:
                    x = find(e[3])
                    rows.append((e[0], e[1], None, None, rep[x], size[x], h))
                start = stop
        return pd.DataFrame(rows, columns=names, dtype=object)

    tasks = max(1, -(-total // task_edges))
    out = stored(small.withColumn("task", F.pmod(F.xxhash64(*PART), F.lit(tasks))).groupBy("task")
                 .applyInPandas(lambda t: merge(t), schema))
    edges = out.filter(F.col("child_size").isNull()).select("u", "v", "rep", "size", "h")
    links = out.filter(F.col("child_size").isNotNull()).select(
        F.col("child").alias("rep"), F.col("child_size").alias("size"), F.col("rep").alias("prep"), F.col("size").alias("psize"))
    return edges, links


def _density(h: Column) -> Column:
    return 1 / F.greatest(h, F.lit(SHORTEST))


def condensed_tree(edges: DataFrame, links: DataFrame, min_cluster_size: int, allow_single: bool = False,
                   task_edges: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(clusters, nodes) of ``merge_tree``'s output.

    clusters(rep, size, prep, psize, birth, stability, picked, in_rep, in_size):
    every cluster with the merge it starts at, the cluster it is a part of
    (null for that of all points), the density it starts at, whether it is
    among those of largest total stability of which none holds another, and
    the one of those that holds it.  The cluster of all
    points is picked only with ``allow_single``.  Equal sums (to one part in
    10^9) go to the larger cluster.
    nodes(rep, size, crep, csize): the cluster of each merge of at least
    ``min_cluster_size`` points.

    A cluster goes on in a merge's only large part; two or more large parts
    are new clusters.  Its stability is the sum over its merges of their size
    times the densities that they last.
    """
    checkpoint_dir(edges.sparkSession)
    big = stored(edges.filter(F.col("size") >= min_cluster_size).groupBy("rep", "size").agg(F.max("h").alias("h")))
    up = stored(big.join(links, ["rep", "size"], "left"))
    above = up.filter(F.col("prep").isNotNull()).groupBy("prep", "psize").agg(F.count("*").alias("kids"))
    tall = big.select(F.col("rep").alias("prep"), F.col("size").alias("psize"), _density(F.col("h")).alias("birth"))
    up = stored(up.join(above, ["prep", "psize"], "left").join(tall, ["prep", "psize"], "left")
                .withColumn("first", F.col("prep").isNull() | (F.col("kids") > 1))
                .withColumn("birth", F.coalesce("birth", F.lit(0.0))))

    ref = lambda r, s: F.struct(F.col(r).alias("rep"), F.col(s).alias("size"))
    heads = up.filter("first").select(ref("rep", "size").alias("node"))
    goes_on = up.filter(~F.col("first")).select(ref("rep", "size").alias("node"), ref("prep", "psize").alias("to"))
    goes_on = goes_on.join(heads.select(F.col("node").alias("to"), F.lit(True).alias("at_end")), "to", "left")
    to = _follow(stored(goes_on.withColumn("at_end", F.coalesce("at_end", F.lit(False)))), task_edges)
    nodes = to.select("node", "to").unionByName(heads.withColumn("to", F.col("node")))
    nodes = stored(nodes.select("node.*", F.col("to.rep").alias("crep"), F.col("to.size").alias("csize")))
    lasting = (nodes.join(up, ["rep", "size"])
               .groupBy("crep", "csize").agg(F.sum(F.col("size") * (_density(F.col("h")) - F.col("birth"))).alias("stability")))
    parent = nodes.select(F.col("rep").alias("prep"), F.col("size").alias("psize"), F.col("crep").alias("up_rep"), F.col("csize").alias("up_size"))
    born = stored(up.filter("first").select("rep", "size", "prep", "psize", "birth").join(parent, ["prep", "psize"], "left")
                  .join(lasting.withColumnsRenamed({"crep": "rep", "csize": "size"}), ["rep", "size"])
                  .select("rep", "size", F.col("up_rep").alias("prep"), F.col("up_size").alias("psize"), "birth", "stability"))
    return _pick(born, allow_single, task_edges), nodes


def _follow(to: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Pointers (node, to, at_end) led to their ends: up to ``task_edges`` in one task, else by doubling.  No two nodes
    point at the same one that is no end, so no key of the joins is hot."""
    if to.limit(task_edges + 1).count() <= task_edges:
        return _task_follow(to)
    while to.filter(~F.col("at_end")).limit(1).count():
        onward = to.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("at_end").alias("end"))
        moved = to.filter(~F.col("at_end")).join(onward, "to").select("node", F.col("next").alias("to"), F.col("end").alias("at_end"))
        to = stored(to.filter("at_end").unionByName(moved))
    return to


def _task_follow(to: DataFrame) -> DataFrame:
    """The same as ``_follow`` for few pointers, in one task: larger nodes before those that lead to them."""
    import pyarrow as pa

    def body(table):
        table = table.sort_by([("size", "descending")])
        ends = {}
        for node in zip(*(table[c].to_pylist() for c in ("rep", "size", "to_rep", "to_size"))):
            ends[node[:2]] = ends.get(node[2:], node[2:])
        reps, sizes = zip(*ends.values()) if ends else ((), ())
        kinds = table.schema
        return table.select(["rep", "size"]).append_column("to_rep", pa.array(reps, kinds.field("to_rep").type)) \
            .append_column("to_size", pa.array(sizes, pa.int64()))

    kind = dict(to.select("node.rep").dtypes)["rep"]
    ends = stored(to.select("node.rep", "node.size", F.col("to.rep").alias("to_rep"), F.col("to.size").alias("to_size"), F.lit(0).alias("task"))
                  .groupBy("task").applyInArrow(body, f"rep {kind}, size long, to_rep {kind}, to_size long"))
    return ends.select(F.struct("rep", "size").alias("node"), F.struct(F.col("to_rep").alias("rep"), F.col("to_size").alias("size")).alias("to"),
                       F.lit(True).alias("at_end"))


# A rule is what a cluster's value is, by that of a cluster below it: ``flat`` where that is at most ``most``, else ``more`` added to it.
def _by(rule: Column, value: Column) -> Column:
    return F.when(value <= rule["most"], rule["flat"]).otherwise(value + rule["more"])


def _after(outer: Column, inner: Column) -> Column:
    """The rule of ``outer`` applied to what ``inner`` gives (``flat`` is at most ``most + more`` in every rule, so this is one, too)."""
    whole = outer["most"] - inner["more"] >= inner["most"]
    return F.struct(F.when(whole, outer["flat"]).otherwise(_by(outer, inner["flat"])).alias("flat"),
                    F.when(whole, outer["most"] - inner["more"]).otherwise(inner["most"]).alias("most"), (inner["more"] + outer["more"]).alias("more"))


def _task_picks(born: DataFrame, allow_single: bool) -> DataFrame:
    """(rep, size, in_rep, in_size): the topmost better cluster that holds each of few clusters, or null, in one task.

    Values go from the parts to the clusters that hold them, as in ``_values``; the topmost better ones the other way.
    """
    import pyarrow as pa

    def body(table):
        table = table.sort_by("size")
        rows = list(zip(*(table[c].to_pylist() for c in ("rep", "size", "prep", "psize", "stability"))))
        parts, better, top = {}, [], {}
        for rep, size, prep, psize, own in rows:
            below = parts.get((rep, size), 0.0)
            picks = prep is not None or allow_single
            best = own if picks and own * (1 + 1e-9) >= below else below
            parts[prep, psize] = parts.get((prep, psize), 0.0) + best
            better.append(picks and best == own)
        for (rep, size, prep, psize, _), good in zip(reversed(rows), reversed(better)):
            top[rep, size] = top.get((prep, psize)) or ((rep, size) if good else None)
        held = [top[r[:2]] or (None, None) for r in rows]
        return table.select(["rep", "size"]).append_column("in_rep", pa.array([h[0] for h in held], table.schema.field("rep").type)) \
            .append_column("in_size", pa.array([h[1] for h in held], pa.int64()))

    kind = dict(born.dtypes)["rep"]
    return stored(born.select("rep", "size", "prep", "psize", "stability").withColumn("task", F.lit(0)).groupBy("task")
                  .applyInArrow(body, f"rep {kind}, size long, in_rep {kind}, in_size long"))


def _values(born: DataFrame, allow_single: bool) -> DataFrame:
    """(node, value): the largest total stability of clusters in each of born(rep, size, prep, psize, stability), none within another.

    Each round takes the clusters without open parts, then puts the rule of a
    whole line of clusters with one open part each in place of that line, by
    doubling.  Of the rest each has two open parts at least, so that there are
    log2(clusters) rounds, however deep the tree is.  The clusters of the lines
    get their values afterwards, last round first.
    """
    up = F.when(F.col("prep").isNotNull(), F.struct(F.col("prep").alias("rep"), F.col("psize").alias("size")))
    picks = F.lit(True) if allow_single else F.col("prep").isNotNull()
    pass_on = F.struct(F.lit(0.0).alias("flat"), F.lit(float("-inf")).alias("most"), F.lit(0.0).alias("more"))
    live = born.select(F.struct("rep", "size").alias("node"), up.alias("up"), F.when(picks, F.col("stability")).alias("own"),
                       F.lit(0.0).alias("parts"), pass_on.alias("rule"))
    known, lines = None, []
    while live.limit(1).count():
        inner = live.filter(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
        value = F.when(F.col("own") * (1 + 1e-9) >= F.col("parts"), F.col("own")).otherwise(F.col("parts"))
        leaf = stored(live.join(inner, "node", "left_anti").select("node", "up", "rule", value.alias("value")))
        known = leaf.select("node", "value") if known is None else known.unionByName(leaf.select("node", "value"))
        gain = leaf.groupBy(F.col("up").alias("node")).agg(F.sum(_by(F.col("rule"), F.col("value"))).alias("gain"))
        live = stored(live.join(inner, "node", "left_semi").join(gain, "node", "left")
                      .withColumn("parts", F.col("parts") + F.coalesce("gain", F.lit(0.0))).drop("gain"))
        # lines: clusters with one open part
        one = live.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(
            F.count("*").alias("open"), F.min("node").alias("to"), F.min("rule").alias("below")).filter(F.col("open") == 1)
        at = F.struct(F.coalesce("own", F.lit(0.0)).alias("flat"),
                      F.coalesce(F.col("own") * (1 + 1e-9) - F.col("parts"), F.lit(float("-inf"))).alias("most"), F.col("parts").alias("more"))
        line = stored(live.join(one, "node").select("node", "to", "up", F.col("rule").alias("onto"), _after(at, F.col("below")).alias("rule")))
        ends = line.select(F.col("node").alias("to"), F.lit(False).alias("at_end"))
        line = stored(line.join(ends, "to", "left").withColumn("at_end", F.coalesce("at_end", F.lit(True))))
        while line.filter(~F.col("at_end")).limit(1).count():
            onward = line.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("at_end").alias("end"), F.col("rule").alias("below"))
            moved = line.filter(~F.col("at_end")).join(onward, "to").select(
                "node", F.col("next").alias("to"), "up", "onto", _after(F.col("rule"), F.col("below")).alias("rule"), F.col("end").alias("at_end"))
            line = stored(line.filter("at_end").unionByName(moved.select(*line.columns)))
        lines.append(line.select("node", "to", "rule"))
        held = line.select(F.col("node").alias("up"))
        top = line.join(held, "up", "left_anti").select(F.col("to").alias("node"), F.col("up").alias("new_up"),
                                                        _after(F.col("onto"), F.col("rule")).alias("new_rule"), F.lit(True).alias("moved"))
        live = stored(live.join(held.withColumnRenamed("up", "node"), "node", "left_anti").join(top, "node", "left")
                      .select("node", F.when(F.col("moved"), F.col("new_up")).otherwise(F.col("up")).alias("up"), "own", "parts",
                              F.when(F.col("moved"), F.col("new_rule")).otherwise(F.col("rule")).alias("rule")))
    for line in reversed(lines):
        given = line.join(known.select(F.col("node").alias("to"), F.col("value").alias("below")), "to")
        known = stored(known.unionByName(given.select("node", _by(F.col("rule"), F.col("below")).alias("value"))))
    return known


def _pick(born: DataFrame, allow_single: bool, task_edges: int = TASK_EDGES) -> DataFrame:
    """Add ``picked``: a cluster is better than its parts where its value is its own stability; of the better
    ones the topmost, by pointer doubling.  Up to ``task_edges`` clusters go to one task."""
    checkpoint_dir(born.sparkSession)
    key = ["rep", "size"]
    count = born.limit(task_edges + 1).count()
    if not count:
        return born.withColumn("picked", F.lit(False)).withColumn("in_rep", F.col("rep")).withColumn("in_size", F.col("size"))
    if count <= task_edges:
        found = F.coalesce((F.col("in_rep") == F.col("rep")) & (F.col("in_size") == F.col("size")), F.lit(False))
        return born.join(_task_picks(born, allow_single), key).select(*born.columns, found.alias("picked"), "in_rep", "in_size")
    better = F.col("value") == F.col("stability")
    if not allow_single:
        better = better & F.col("prep").isNotNull()
    values = _values(born, allow_single).select("node.*", "value")
    known = born.join(values, key).select(*key, "prep", "psize", better.alias("better"))
    # in_: the topmost better cluster known so far among this one and those that hold it
    own = F.when(F.col("better"), F.struct("rep", "size"))
    top = stored(known.select(*key, "prep", "psize", own.alias("in_")))
    while top.filter(F.col("prep").isNotNull()).limit(1).count():
        nxt = top.select(F.col("rep").alias("prep"), F.col("size").alias("psize"), F.col("in_").alias("higher"),
                         F.col("prep").alias("nrep"), F.col("psize").alias("nsize"))
        top = stored(top.join(nxt, ["prep", "psize"], "left").select(*key, F.col("nrep").alias("prep"), F.col("nsize").alias("psize"),
                                                                     F.coalesce("higher", "in_").alias("in_")))
    found = F.coalesce(F.col("in_") == F.struct("rep", "size"), F.lit(False))
    return born.join(top.select(*key, found.alias("picked"), "in_"), key).select(
        *born.columns, "picked", F.col("in_.rep").alias("in_rep"), F.col("in_.size").alias("in_size"))


def density_hierarchy(points: DataFrame, min_samples: int = 5, min_cluster_size: int = 5, id_col: str = "vec_id", vec: str = "x",
                      allow_single: bool = False, tree: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(vec_id, cluster_id)``: variable-density clusters of every point; -1 is noise, null vectors included.

    ``tree`` is a ``reachability_tree`` of the points, made here if absent.
    Ids are ranks by size, ties by the smallest point.
    """
    if tree is None:
        tree = reachability_tree(points, min_samples, id_col, vec)
    edges, links = merge_tree(tree, min_cluster_size, task_edges)
    clusters, nodes = condensed_tree(edges, links, min_cluster_size, allow_single, task_edges)
    clusters = stored(clusters)
    picked = assign_row_id(clusters.filter("picked").orderBy(F.col("size").desc(), "rep"), "_rank")

    picked = picked.select(F.col("rep").alias("in_rep"), F.col("size").alias("in_size"), F.col("_rank").cast("int").alias("cluster_id"))
    held = clusters.join(picked, ["in_rep", "in_size"]).select(F.col("rep").alias("crep"), F.col("size").alias("csize"), "cluster_id")
    named = nodes.join(held, ["crep", "csize"]).select("rep", "size", "cluster_id")

    # edges inside picked clusters, and those of small merges: their components are the clusters and what fell off
    inside = edges.join(named, ["rep", "size"], "left").filter(F.col("cluster_id").isNotNull() | (F.col("size") < min_cluster_size))
    inside = stored(inside.select("u", "v", "cluster_id"))
    comp = connected_components(inside, src="u", dst="v")
    name = (inside.filter(F.col("cluster_id").isNotNull()).select(F.col("u").alias("node"), "cluster_id").join(comp, "node")
            .groupBy("component").agg(F.min("cluster_id").alias("cluster_id")))
    labels = comp.join(name, "component").select(F.col("node").alias(id_col), "cluster_id")
    return (points.select(id_col).join(labels, id_col, "left")
                  .select(id_col, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")))
