"""Cluster term counts, class-based TF-IDF and top words.

A cluster's "super-document" is never concatenated: unigram counts are
additive, so ``groupBy(cluster, term).count()`` over exploded unit tokens is
the same term frequency and aggregates partially before the shuffle (a
cluster holding a third of all units is combined map-side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.stopwords import ENGLISH_STOPWORDS
from gleaner.functions.text import vectorizer_tokens
from gleaner.session import checkpoint_dir


def top_k_clusters(labels: DataFrame, k: int | None = 10, group_cols: Sequence[str] = ("setting",),
                   cluster_col: str = "cluster") -> DataFrame:
    """Sizes of the k largest non-noise clusters per group, ranked.

    Returns ``(*group_cols, cluster, size, size_rank)``; ties by cluster id.
    The ranking window runs over the per-cluster count table (one row per
    cluster), and ``rank <= k`` becomes a partial per-group limit.
    """
    g = list(group_cols)
    sizes = (labels.filter(F.col(cluster_col).isNotNull() & (F.col(cluster_col).cast("string") != "-1"))
                   .groupBy(*g, cluster_col).agg(F.count(F.lit(1)).alias("size")))
    w = Window.partitionBy(*g).orderBy(F.col("size").desc(), F.col(cluster_col))
    ranked = sizes.withColumn("size_rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.filter(F.col("size_rank") <= k)
    return ranked


def cluster_term_counts(units: DataFrame, group_cols: Sequence[str] = ("setting", "cluster"),
                        text_col: str = "unit", tokens=vectorizer_tokens) -> DataFrame:
    """``(*group_cols, term, tf)``: term frequency of each cluster's units."""
    g = list(group_cols)
    return (units.select(*g, F.explode(tokens(text_col)).alias("term"))
                 .groupBy(*g, "term").agg(F.count(F.lit(1)).alias("tf")))


#: Kept terms of all settings are broadcast up to this many.
BROADCAST_TERMS = 200_000

#: Parts of a setting's vocabulary that are cut to ``n`` terms each before the final cut.
_PARTS = 64


def _top_terms(terms: DataFrame, group: list[str], n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each group, in two steps: no task sorts more than a part of a vocabulary, or ``n`` terms a part."""
    part = F.pmod(F.xxhash64("term"), F.lit(_PARTS))
    first = Window.partitionBy(*group, "_part").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    some = terms.withColumn("_part", part).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_part")
    return some.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_r")


def _nth_largest(rows: DataFrame, group: list[str], value: str, n: int, out: str = "_nth") -> DataFrame:
    """``(*group, out)``: the n-th largest value of each group, the smallest where it has fewer rows.

    Only the distinct counts of a group are sorted, never its rows.
    """
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy(F.col(value).desc())
    above = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    return counts.withColumn("_above", above).filter(F.col("_above") < n).groupBy(*group).agg(F.min(value).alias(out))


def ctfidf(tf: DataFrame, clusters: DataFrame, setting_cols: Sequence[str] = ("setting",),
           cluster_col: str = "cluster", stopwords: Sequence[str] | None = None,
           max_features: int | None = None, norm: str | None = None, top: int | None = None) -> DataFrame:
    """Class-based TF-IDF weights ``(*setting, cluster, term, tf, weight)``.

    ``idf = ln((1 + n) / (1 + df)) + 1`` with n the number of clusters of the
    setting (every cluster in ``clusters`` counts, even one without terms)
    and df the clusters containing the term.  ``stopwords`` drops terms;
    ``max_features`` keeps the most frequent terms of the setting (ties by
    term); ``norm='l2'`` scales each cluster's row to unit length.

    ``top`` leaves out rows that cannot be among the ``top`` largest weights
    of their cluster; the weights of the others are the same.  A weight is at
    least ``tf`` and at most ``tf * (ln((1 + n) / 2) + 1)``, so counts alone
    tell most of them, before terms are sorted or joined.  Norms need every row.
    """
    s = list(setting_cols)
    if stopwords:
        tf = tf.filter(~F.col("term").isin(list(stopwords)))
    if max_features is not None:
        totals = tf.groupBy(*s, "term").agg(F.sum("tf").alias("_tot"))
        # terms below the last count that is kept are not sorted
        least = _nth_largest(totals, s, "_tot", max_features)
        likely = totals.join(least, s).filter(F.col("_tot") >= F.col("_nth")).drop("_nth")
        keep = _top_terms(likely, s, max_features, [F.col("_tot").desc(), F.col("term")])
        # at most max_features rows a setting: counted once, then met without a shuffle of the counts
        checkpoint_dir(tf.sparkSession)
        keep = keep.select(*s, "term").checkpoint(eager=True)
        few = F.broadcast(keep) if keep.count() <= BROADCAST_TERMS else keep
        tf = tf.join(few, [*s, "term"], "left_semi").checkpoint(eager=True)  # read for documents, norms and weights
    n = clusters.groupBy(*s).agg(F.countDistinct(cluster_col).alias("_n"))
    rows = tf
    if top is not None and norm is None:
        key = [*s, cluster_col]
        # the margin is far above what rounded weights differ by
        bounds = _nth_largest(tf, key, "tf", top).join(n, s).withColumn(
            "_least", F.col("_nth") / (F.log((1 + F.col("_n")) / 2) + 1) * (1 - 1e-6) - 1e-6).select(*key, "_least")
        rows = tf.join(bounds, key).filter(F.col("tf") >= F.col("_least")).drop("_least")
        tf = tf.join(rows.select(*s, "term").distinct(), [*s, "term"], "left_semi")
    df_ = tf.groupBy(*s, "term").agg(F.count(F.lit(1)).alias("_df"))
    out = (rows.join(df_, [*s, "term"]).join(n, s)
             .withColumn("weight", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)))
    if norm == "l2":
        norms = out.groupBy(*s, cluster_col).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_norm"))
        out = out.join(norms, [*s, cluster_col]).withColumn("weight", F.col("weight") / F.col("_norm"))
    elif norm is not None:
        raise ValueError(f"unsupported norm {norm!r}")
    return out.select(*s, cluster_col, "term", "tf", "weight")


def top_words(weights: DataFrame, n: int = 10, group_cols: Sequence[str] = ("setting", "cluster"),
              positive_only: bool = True, pad_zero: Sequence[str] | None = None) -> DataFrame:
    """Top ``n`` terms per cluster by weight (desc), ties by term desc.

    Returns ``(*group_cols, rank, word, weight)``.  Zero-weight words are not
    padded in (``positive_only``).  With ``pad_zero`` (the columns that name a
    setting) a cluster of fewer words is filled up to ``n`` with words of its
    setting that it lacks, at weight 0, in the same tie order.
    ``row_number() <= n`` is planned as a per-group limit before the shuffle.
    """
    g = list(group_cols)
    if pad_zero is not None:
        s = list(pad_zero)
        # a cluster of fewer than n words lacks at least n of the last 2n words of its setting
        last = _top_terms(weights.select(*s, "term").distinct(), s, 2 * n, [F.col("term").desc()])
        few = weights.groupBy(*g).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") < n).drop("_c")
        extra = few.join(last, s).join(weights.select(*g, "term"), [*g, "term"], "left_anti").withColumn("weight", F.lit(0.0))
        weights = weights.select(*g, "term", "weight").unionByName(extra.select(*g, "term", "weight"))
        positive_only = False
    if positive_only:
        weights = weights.filter(F.col("weight") > 0)
    w = Window.partitionBy(*g).orderBy(F.round("weight", 9).desc(), F.col("term").desc())
    return (weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
                   .select(*g, F.col("rank").cast("int").alias("rank"), F.col("term").alias("word"), "weight"))


def ctfidf_top_words(units: DataFrame, clusters: DataFrame, variant: str = "raw", n: int = 10,
                     setting_cols: Sequence[str] = ("setting",), cluster_col: str = "cluster",
                     text_col: str = "unit", stopwords: Sequence[str] | None = None,
                     max_features: int = 5000) -> DataFrame:
    """Units of the chosen clusters -> top words per cluster.

    ``variant='raw'``: no stoplist, no norm (the diversity fit).
    ``variant='l2'``: English stoplist, ``max_features`` terms, L2 rows
    (the coherence fit).  ``clusters`` lists ``(*setting, cluster)``; units are
    restricted to them by a semi join.
    """
    s = list(setting_cols)
    chosen = units.join(clusters.select(*s, cluster_col), [*s, cluster_col], "left_semi")
    tf = cluster_term_counts(chosen, [*s, cluster_col], text_col)
    if variant == "raw":
        weights = ctfidf(tf, clusters, s, cluster_col, top=n)
    elif variant == "l2":
        sw = list(ENGLISH_STOPWORDS) if stopwords is None else list(stopwords)
        weights = ctfidf(tf, clusters, s, cluster_col, stopwords=sw, max_features=max_features, norm="l2")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return top_words(weights, n, [*s, cluster_col])


def normalise_topic_words(raw: DataFrame, text_col: str = "value",
                          key_cols: Sequence[str] = ()) -> DataFrame:
    """Topic-word JSON in any of four shapes -> ``(*keys, topic_id, rank, word)``.

    Shapes: ``{"1": [...], "2": "w w"}`` (digit keys, numeric order),
    ``{"topics": [{"top_words"|"words"|"terms": ...}]}``, a list of such
    objects, or a list of lists.  Words are stripped; empty topics dropped;
    ``topic_id`` counts the surviving topics from 0.  One JSON document per
    row (``key_cols`` identify it), so many files parse in parallel.  A document
    that is not JSON, or an object with any other key, has no topics.
    """
    keys = list(key_cols)
    with_j = raw.select(*keys, F.try_parse_json(F.col(text_col)).alias("j"))

    def words_of(v):
        arr = F.try_variant_get(v, "$", "array<string>")
        s = F.try_variant_get(v, "$", "string")
        from_str = F.split(F.trim(s), r"\s+")
        return F.coalesce(arr, F.when(s.isNotNull(), from_str))

    as_map = F.try_variant_get("j", "$", "map<string,variant>")
    topics_arr = F.try_variant_get("j", "$.topics", "array<variant>")
    top_arr = F.try_variant_get("j", "$", "array<variant>")
    # dict with digit keys (and no "topics" key), numeric key order
    digits = F.forall(F.map_keys(as_map), lambda k: F.rlike(k, F.lit(r"^\d+$")))
    keyed = (with_j.filter(as_map.isNotNull() & ~F.map_contains_key(as_map, "topics") & digits)
             .select(*keys, F.explode(as_map).alias("key", "value"))
             .filter(F.col("key").rlike(r"^\d+$"))
             .select(*keys, F.col("key").cast("decimal(38,0)").alias("_order"), words_of(F.col("value")).alias("words")))
    # list-based: top-level array, or the array under "topics"
    lst = F.when(as_map.isNotNull() & F.map_contains_key(as_map, "topics"), topics_arr).otherwise(top_arr)
    items = (with_j.select(*keys, lst.alias("_l")).filter(F.col("_l").isNotNull())
             .select(*keys, F.posexplode("_l").alias("pos", "value")))
    def non_empty(c):  # the reference's ``a or b or c`` skips empty lists too
        return F.when(F.size(c) > 0, c)
    obj_words = F.coalesce(*[non_empty(words_of(F.try_variant_get("value", f"$.{k}", "variant")))
                             for k in ("top_words", "words", "terms")])
    is_dict = F.try_variant_get("value", "$", "map<string,variant>").isNotNull()
    item_words = F.when(is_dict, obj_words).otherwise(F.try_variant_get("value", "$", "array<string>"))
    listed = items.select(*keys, F.col("pos").cast("decimal(38,0)").alias("_order"), item_words.alias("words"))
    allw = keyed.unionByName(listed)
    cleaned = allw.select(*keys, "_order", F.filter(F.transform("words", lambda w: F.trim(w)),
                                                    lambda w: w != F.lit("")).alias("words"))
    cleaned = cleaned.filter(F.size("words") > 0)
    w = Window.partitionBy(*keys).orderBy("_order") if keys else Window.orderBy("_order")
    return (cleaned.withColumn("topic_id", F.row_number().over(w) - 1)
                   .select(*keys, "topic_id", F.posexplode("words").alias("rank0", "word"))
                   .select(*keys, F.col("topic_id").cast("int").alias("topic_id"),
                           (F.col("rank0") + 1).cast("int").alias("rank"), "word"))
