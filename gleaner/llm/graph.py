"""Connected components of an undirected edge table, by randomised contraction.

Each round every vertex joins the neighbour (or itself) that has the smallest
random rank of that round, edges are rewritten to the joined vertices, and
the loop goes on until no edge is left: expected O(log n) rounds, no round
limit.  Nothing but one row count a round reaches the driver; every round is
written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages


def components(edges: DataFrame, stages: Stages, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` (long); equal root = same component.

    Self loops keep their node; nulls are dropped; repeated edges do no harm.
    An empty table gives an empty table.
    """
    edges = stages.put(f"{name}-edges0", edges.select("a", "b").where("a is not null and b is not null").distinct())
    label = stages.put(f"{name}-label0", edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                       .select("node", F.col("node").alias("root")))
    turn = 0
    live = edges.where("a <> b")
    while live.limit(1).count():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), c.alias("v"))
        both = live.select("a", "b").union(live.select("b", "a")).toDF("a", "b")
        to = (both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
              .select(F.col("a").alias("old"), F.least("m", rank(F.col("a"))).getField("v").alias("new")))
        to = stages.put(f"{name}-to{turn}", to)
        one = live.join(to.select(F.col("old").alias("a"), F.col("new").alias("na")), "a")
        two = one.join(to.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b")
        live = stages.put(f"{name}-edges{turn}", two.where("na <> nb")
                          .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        label = stages.put(f"{name}-label{turn}", label.join(to, label["root"] == to["old"], "left")
                           .select("node", F.coalesce("new", "root").alias("root")))
        stages.drop(f"{name}-edges{turn - 1}")
        stages.drop(f"{name}-label{turn - 1}")
        stages.drop(f"{name}-to{turn}")
    return label
