"""Rank-biased overlap and inverted RBO.

The reference RBO weights the running mean of the depth agreement:

    X_i = |S_i & T_i|,  overlap_i = sum_{j<=i} X_j / j,
    rbo = (1 - p) * sum_{i=1..m} p^(i-1) * overlap_i / i,   m = min(|S|, |T|)

A word shared by both lists enters ``S_i & T_i`` at depth
``d = max(rank_S, rank_T)`` and stays, so swapping the sums gives

    rbo = sum over shared words with d <= m of c(d, m),
    c(d, m) = (1 - p) * sum_{j=d..m} (1/j) * sum_{i=j..m} p^(i-1) / i.

So RBO needs only the (pair, shared word) rows from an equi-join on the
word; pairs of topics with no word in common contribute 0 and are never
formed.  IRBO = 1 - (sum of RBO) / (k (k - 1) / 2) over the k non-empty
topics of a setting, and 1.0 when k < 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rbo_weight(d: Column, m: Column, p: float = 0.9, variant: str = "reference") -> Column:
    """c(d, m) of one shared word arriving at depth d, lists cut at depth m.

    ``variant='standard'`` weights the agreement itself (Webber et al.):
    ``c = (1 - p) * sum_{i=d..m} p^(i-1) / i``.
    """
    pl = F.lit(float(p))
    if variant == "standard":
        inner = F.aggregate(F.sequence(d, m), F.lit(0.0), lambda acc, i: acc + F.pow(pl, i - 1) / i)
        return (1 - pl) * inner
    outer = F.aggregate(
        F.sequence(d, m), F.lit(0.0),
        lambda acc, j: acc + F.aggregate(F.sequence(j, m), F.lit(0.0),
                                         lambda a2, i: a2 + F.pow(pl, i - 1) / i) / j)
    return (1 - pl) * outer


def _lists(words: DataFrame, setting_cols, topic_col, top_n):
    s = list(setting_cols)
    w = words.filter(F.col("rank") <= top_n) if top_n is not None else words
    # a word listed twice counts once (sets), at its first rank
    first = w.groupBy(*s, topic_col, "word").agg(F.min("rank").alias("rank"))
    lens = w.groupBy(*s, topic_col).agg(F.max("rank").alias("len"))
    return first, lens


def rbo_pairs(words: DataFrame, p: float = 0.9, top_n: int | None = 10,
              setting_cols: Sequence[str] = ("setting",), topic_col: str = "topic",
              variant: str = "reference") -> DataFrame:
    """RBO of every unordered topic pair that shares at least one word.

    ``words`` is ``(*setting, topic, rank, word)`` with ranks from 1.
    Returns ``(*setting, topic_a, topic_b, rbo)``; absent pairs have RBO 0.
    The join is on ``(setting, word)``: its size is the number of
    (pair, shared word) rows, at most k^2 * top_n per setting.
    """
    s = list(setting_cols)
    first, lens = _lists(words, s, topic_col, top_n)
    a = first.join(lens, [*s, topic_col]).select(
        *s, "word", F.col(topic_col).alias("topic_a"), F.col("rank").alias("ra"), F.col("len").alias("la"))
    b = first.join(lens, [*s, topic_col]).select(
        *s, "word", F.col(topic_col).alias("topic_b"), F.col("rank").alias("rb"), F.col("len").alias("lb"))
    m = F.least("la", "lb")
    d = F.greatest("ra", "rb")
    shared = (a.join(b, [*s, "word"]).filter(F.col("topic_a") < F.col("topic_b"))
               .withColumn("_m", m).withColumn("_d", d).filter(F.col("_d") <= F.col("_m")))
    return (shared.groupBy(*s, "topic_a", "topic_b")
                  .agg(F.sum(rbo_weight(F.col("_d"), F.col("_m"), p, variant)).alias("rbo")))


def _rbo_total(words: DataFrame, p: float, top_n: int | None, s: list[str], topic_col: str, variant: str) -> DataFrame:
    """``(*setting, _sum)``: RBO summed over all topic pairs, without forming a pair.

    What a shared word adds to a pair depends only on its two ranks and the
    two list lengths, so topics are counted by (word, rank, length) and the
    classes of a word are paired, with the number of their topic pairs.
    """
    first, lens = _lists(words, s, topic_col, top_n)
    classes = first.join(lens, [*s, topic_col]).groupBy(*s, "word", "rank", "len").agg(F.count(F.lit(1)).alias("c"))
    a = classes.select(*s, "word", F.col("rank").alias("ra"), F.col("len").alias("la"), F.col("c").alias("ca"))
    b = classes.select(*s, "word", F.col("rank").alias("rb"), F.col("len").alias("lb"), F.col("c").alias("cb"))
    same = (F.col("ra") == F.col("rb")) & (F.col("la") == F.col("lb"))
    pairs = F.when(same, F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb"))
    met = (a.join(b, [*s, "word"]).filter(F.struct("ra", "la") <= F.struct("rb", "lb"))
            .select(*s, pairs.alias("n"), F.greatest("ra", "rb").alias("d"), F.least("la", "lb").alias("m"))
            .filter((F.col("d") <= F.col("m")) & (F.col("n") > 0)))
    by_depth = met.groupBy(*s, "d", "m").agg(F.sum("n").alias("n"))
    return by_depth.groupBy(*s).agg(F.sum(F.col("n") * rbo_weight(F.col("d"), F.col("m"), p, variant)).alias("_sum"))


def irbo(words: DataFrame, p: float = 0.9, top_n: int | None = 10,
         setting_cols: Sequence[str] = ("setting",), topic_col: str = "topic",
         variant: str = "reference", settings: DataFrame | None = None) -> DataFrame:
    """``(*setting, n_topics, irbo)``; 1.0 when fewer than two non-empty topics.

    ``settings`` names every setting: one without topics has 0 topics and 1.0.
    """
    s = list(setting_cols)
    _, lens = _lists(words, s, topic_col, top_n)
    k = lens.groupBy(*s).agg(F.count(F.lit(1)).alias("n_topics"))
    if settings is not None:
        k = settings.select(*s).distinct().join(k, s, "left").fillna(0, subset=["n_topics"])
    tot = _rbo_total(words, p, top_n, s, topic_col, variant)
    out = k.join(tot, s, "left").fillna(0.0, subset=["_sum"])
    pairs = F.col("n_topics") * (F.col("n_topics") - 1) / 2
    return out.select(*s, F.col("n_topics").cast("long").alias("n_topics"),
                      F.when(F.col("n_topics") < 2, F.lit(1.0))
                       .otherwise(1 - F.col("_sum") / pairs).alias("irbo"))
