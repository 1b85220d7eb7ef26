"""Query catalogue: each query takes ``(spark, sf_dir)`` and returns a DataFrame.

Queries read whole tables from ``sf_dir``; every computed column is aliased
to the same name as in the matching oracle SQL (``gleaner.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import reviews as R
from gleaner.operators import segment as SEG
from gleaner.plans import fixtures as FX
from gleaner.plans.stages import stage

# Published segmentation setting of the phrase run.
MIN_TOKENS = 6
DROP_IF_SHORT = 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------------- text
def deduped_reviews(spark, sf_dir):
    return R.dedup_reviews(FX.reviews(spark, sf_dir), keys=("course_id", "review"))


def build_mintoken_units(spark, sf_dir):
    return SEG.segment_units(deduped_reviews(spark, sf_dir), "review", "mintoken",
                             MIN_TOKENS, DROP_IF_SHORT, keep=("review_id", "course_id", "label", "lang"))


def mintoken_units(spark, sf_dir):
    """The phrase-unit table, written once per session and input folder."""
    return stage(spark, sf_dir, "mintoken_units", lambda: build_mintoken_units(spark, sf_dir))


@query
def filter_dedup_stats(spark, sf_dir):
    raw = FX.reviews(spark, sf_dir)
    return R.review_stats(raw, R.dedup_reviews(raw, keys=("course_id", "review")))


@query
def token_count(spark, sf_dir):
    return R.with_token_count(deduped_reviews(spark, sf_dir)).select("review_id", "course_id", "n_tokens")


@query
def segment_base(spark, sf_dir):
    return SEG.segment_units(deduped_reviews(spark, sf_dir), "review", "base",
                             keep=("review_id",)).select("review_id", "unit_pos", "unit")


@query
def segment_mintoken(spark, sf_dir):
    return build_mintoken_units(spark, sf_dir).select("review_id", "unit_pos", "unit")


@query
def group_units(spark, sf_dir):
    g = SEG.group_units(deduped_reviews(spark, sf_dir), "review", "units", "mintoken",
                        MIN_TOKENS, DROP_IF_SHORT)
    return g.select("review_id", "course_id", F.size("units").alias("n_units"),
                    F.array_join("units", "\n").alias("units_text"))


@query
def corpus_ids(spark, sf_dir):
    units = mintoken_units(spark, sf_dir)
    return R.to_corpus(units, label_col="label").select("id", "text", "label")


# ------------------------------------------------ words, diversity, coherence
from gleaner.operators import coherence as COH  # noqa: E402
from gleaner.operators import diversity as DIV  # noqa: E402
from gleaner.operators import words as W  # noqa: E402

# Two cluster views of the phrase units (like the 5-d and 10-d runs) and two
# top-k cuts give four settings, each a separate fit.
VIEWS = {"source": "course_id", "lang": "lang"}
TOPKS = (5, 10)
TOP_N_WORDS = 10


def unit_labels(spark, sf_dir):
    """(view, cluster, review_id, unit_pos, unit): each unit once per view."""
    units = mintoken_units(spark, sf_dir)
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.col(c).cast("string").alias("cluster"))
                      for v, c in VIEWS.items()])
    return units.select("review_id", "unit_pos", "unit", F.explode(views).alias("_v")) \
                .select("_v.view", "_v.cluster", "review_id", "unit_pos", "unit")


def chosen_clusters(labels):
    """(setting, view, cluster): top-k clusters of each view, one row per setting."""
    ranked = W.top_k_clusters(labels, max(TOPKS), ["view"], "cluster")
    ks = F.explode(F.array(*[F.lit(k) for k in TOPKS])).alias("top_k")
    return (ranked.select("view", "cluster", "size_rank", ks)
                  .filter(F.col("size_rank") <= F.col("top_k"))
                  .select(F.concat("view", F.lit("_top"), F.col("top_k").cast("string")).alias("setting"),
                          "view", "top_k", "cluster"))


def chosen_table(spark, sf_dir):
    """(setting, view, top_k, cluster): the chosen clusters, written once."""
    return stage(spark, sf_dir, "chosen_clusters", lambda: chosen_clusters(unit_labels(spark, sf_dir)))


def term_counts(spark, sf_dir):
    """(view, cluster, term, tf) for the chosen clusters, written once.

    Each unit is tokenised once and its tokens counted once, by the columns of
    all views together; the counts are then summed under every view.  The
    chosen-cluster table (views x k rows) is broadcast into a semi join.
    """
    def build():
        units = mintoken_units(spark, sf_dir)
        chosen = chosen_table(spark, sf_dir).select("view", "cluster").distinct()
        cols = list(VIEWS.values())
        counts = (units.select(*cols, F.explode(W.vectorizer_tokens("unit")).alias("term"))
                       .groupBy(*cols, "term").agg(F.count(F.lit(1)).alias("tf")))
        views = F.array(*[F.struct(F.lit(v).alias("view"), F.col(c).cast("string").alias("cluster"))
                          for v, c in VIEWS.items()])
        rows = counts.select("term", "tf", F.explode(views).alias("_v")).select("_v.view", "_v.cluster", "term", "tf")
        return (rows.join(F.broadcast(chosen), ["view", "cluster"], "left_semi")
                    .groupBy("view", "cluster", "term").agg(F.sum("tf").alias("tf")))
    return stage(spark, sf_dir, "term_counts", build)


def setting_top_words(spark, sf_dir, variant):
    """Top words per (setting, cluster); a small table written once per session."""
    return stage(spark, sf_dir, f"top_words_{variant}", lambda: build_setting_top_words(spark, sf_dir, variant))


def build_setting_top_words(spark, sf_dir, variant):
    chosen = chosen_table(spark, sf_dir)
    # chosen has at most len(VIEWS) * sum(TOPKS) rows: a proven broadcast bound
    tf = term_counts(spark, sf_dir).join(F.broadcast(chosen.select("setting", "view", "cluster")),
                                         ["view", "cluster"]).select("setting", "cluster", "term", "tf")
    if variant == "raw":
        weights = W.ctfidf(tf, chosen, ["setting"], "cluster", top=TOP_N_WORDS)
    else:
        weights = W.ctfidf(tf, chosen, ["setting"], "cluster",
                           stopwords=list(W.ENGLISH_STOPWORDS), max_features=5000, norm="l2")
    return W.top_words(weights, TOP_N_WORDS, ["setting", "cluster"])


@query
def ctfidf_raw_top_words(spark, sf_dir):
    t = setting_top_words(spark, sf_dir, "raw")
    return t.select("setting", "cluster", "rank", "word", F.round("weight", 6).alias("weight"))


@query
def ctfidf_l2_top_words(spark, sf_dir):
    t = setting_top_words(spark, sf_dir, "l2")
    return t.select("setting", "cluster", "rank", "word", F.round("weight", 6).alias("weight"))


@query
def rbo_pairs(spark, sf_dir):
    words = setting_top_words(spark, sf_dir, "raw").withColumnRenamed("cluster", "topic")
    r = DIV.rbo_pairs(words, p=0.9, top_n=TOP_N_WORDS)
    return r.select("setting", "topic_a", "topic_b", F.round("rbo", 6).alias("rbo"))


@query
def irbo_by_setting(spark, sf_dir):
    words = setting_top_words(spark, sf_dir, "raw").withColumnRenamed("cluster", "topic")
    r = DIV.irbo(words, p=0.9, top_n=TOP_N_WORDS)
    return r.select("setting", "n_topics", F.round("irbo", 6).alias("irbo"))


@query
def irbo_summary(spark, sf_dir):
    """Per-setting IRBO plus the mean over views for each top-k (grouping sets)."""
    words = setting_top_words(spark, sf_dir, "raw").withColumnRenamed("cluster", "topic")
    r = DIV.irbo(words, p=0.9, top_n=TOP_N_WORDS)
    r = r.withColumn("top_k", F.regexp_extract("setting", r"_top(\d+)$", 1).cast("int"))
    g = r.groupingSets([["setting", "top_k"], ["top_k"]], "setting", "top_k").agg(
        F.avg("irbo").alias("irbo"), F.grouping("setting").alias("_g"))
    name = F.when(F.col("_g") == 1, F.concat(F.lit("top"), F.col("top_k").cast("string"), F.lit("_avg"))) \
            .otherwise(F.col("setting"))
    return g.select(name.alias("name"), F.round("irbo", 6).alias("irbo"))


def coherence_inputs(spark, sf_dir):
    units = mintoken_units(spark, sf_dir)
    texts = COH.tokenised_texts(units)
    words = setting_top_words(spark, sf_dir, "l2").withColumnRenamed("cluster", "topic")
    # membership in the vocabulary, checked for the candidate topic words only
    vocab = COH.present_terms(texts, words)
    topics = COH.clean_topics(words, vocab)
    return texts, vocab, topics


@query
def vocabulary(spark, sf_dir):
    units = mintoken_units(spark, sf_dir)
    return COH.vocabulary(COH.tokenised_texts(units)).select("term", "df")


@query
def coherence_cv(spark, sf_dir):
    texts, _, topics = coherence_inputs(spark, sf_dir)
    cv = COH.coherence_cv(texts, topics)
    return cv.select("setting", F.col("topic").alias("cluster"), "n_words", F.round("c_v", 6).alias("c_v"))


def external_words(spark, sf_dir, variant):
    """(setting, topic, rank, word) read back from topic-word JSON files: the sets of the smaller top-k."""
    path = scratch_path(spark, sf_dir, f"external_topics_{variant}")
    small = setting_top_words(spark, sf_dir, variant).withColumnRenamed("cluster", "topic").filter(
        F.col("setting").endswith(f"_top{min(TOPKS)}"))
    IO.write_topic_words(small.select("setting", "topic", "rank", "word"), path, "topics")
    return IO.read_topic_words(spark, path).select("setting", F.col("topic_id").cast("string").alias("topic"), "rank", "word")


def by_source(spark, sf_dir, variant):
    """Words of the clusters and of the external topics, told apart by ``source``."""
    own = setting_top_words(spark, sf_dir, variant).select("setting", F.col("cluster").alias("topic"), "rank", "word")
    return own.withColumn("source", F.lit("clusters")).unionByName(
        external_words(spark, sf_dir, variant).withColumn("source", F.lit("external")))


@query
def irbo_sources(spark, sf_dir):
    r = DIV.irbo(by_source(spark, sf_dir, "raw"), p=0.9, top_n=TOP_N_WORDS, setting_cols=["source", "setting"])
    return r.select("source", "setting", "n_topics", F.round("irbo", 6).alias("irbo"))


@query
def coherence_sources(spark, sf_dir):
    texts = COH.tokenised_texts(mintoken_units(spark, sf_dir))
    words = by_source(spark, sf_dir, "l2")
    keys = ["source", "setting"]
    topics = COH.clean_topics(words, COH.present_terms(texts, words), setting_cols=keys)
    s = COH.coherence_summary(COH.coherence_cv(texts, topics, setting_cols=keys), keys, settings=words)
    return s.select("source", "setting", "k", F.round("avg_c_v", 6).alias("avg_c_v"))


@query
def coherence_summary(spark, sf_dir):
    texts, _, topics = coherence_inputs(spark, sf_dir)
    s = COH.coherence_summary(COH.coherence_cv(texts, topics))
    return s.select("setting", "k", F.round("avg_c_v", 6).alias("avg_c_v"))


# ------------------------------------------ clusters, representatives, table
from gleaner.operators import clusters as CL  # noqa: E402
from gleaner.operators import reps as REP  # noqa: E402
from gleaner.operators import table as TB  # noqa: E402

TOP_K = 10
ALPHA = 1.0
N_SAMPLES = 8


def clustered_units(spark, sf_dir):
    """(dim, cluster_id, outlier, vec_id, phrase, source, vec) for both cluster views."""
    labels = FX.clusters(spark, sf_dir)
    vecs = FX.vectors(spark, sf_dir).select("vec_id", "vec")
    return labels.join(FX.phrases(spark, sf_dir), "vec_id").join(vecs, "vec_id")


def reps_table(spark, sf_dir):
    return stage(spark, sf_dir, "weighted_reps",
                 lambda: REP.weighted_reps(clustered_units(spark, sf_dir), TOP_K, ALPHA))


def labelled_sheet(spark, sf_dir):
    """Inspection sheet with aspect labels: the course of each representative."""
    units = clustered_units(spark, sf_dir)
    reps = reps_table(spark, sf_dir)
    sheet = REP.cluster_samples(units, reps, N_SAMPLES).drop("aspect_label")
    src = reps.select("dim", "cluster_id", "rep_id").join(
        FX.phrases(spark, sf_dir).select(F.col("vec_id").alias("rep_id"), F.col("source").alias("aspect_label")),
        "rep_id")
    return sheet.join(src.drop("rep_id"), ["dim", "cluster_id"])


@query
def top_k_clusters(spark, sf_dir):
    return CL.top_k_clusters(clustered_units(spark, sf_dir), TOP_K).select(
        "dim", "cluster_id", "size", "size_rank")


@query
def central_phrase(spark, sf_dir):
    units = clustered_units(spark, sf_dir)
    top = CL.top_k_clusters(units, TOP_K)
    cen = CL.central_phrase(units.join(F.broadcast(top.select("dim", "cluster_id")), ["dim", "cluster_id"],
                                       "left_semi"))
    return top.join(cen, ["dim", "cluster_id"]).select("dim", "cluster_id", "size", "representative_phrase")


@query
def weighted_centroid(spark, sf_dir):
    units = clustered_units(spark, sf_dir)
    top = CL.top_k_clusters(units, TOP_K)
    chosen = units.join(F.broadcast(top.select("dim", "cluster_id")), ["dim", "cluster_id"], "left_semi")
    c = REP.weighted_centroid(chosen, ALPHA)
    return c.select("dim", "cluster_id", F.posexplode("centroid").alias("pos", "value")) \
            .select("dim", "cluster_id", "pos", F.round("value", 6).alias("value"))


@query
def weighted_reps(spark, sf_dir):
    r = REP.weighted_reps(clustered_units(spark, sf_dir), TOP_K, ALPHA)
    return r.select("dim", "cluster_id", "size", "weighted_centroid_phrase",
                    F.round("rep_cosine_sim", 6).alias("rep_cosine_sim"))


@query
def cluster_samples(spark, sf_dir):
    s = REP.cluster_samples(clustered_units(spark, sf_dir), reps_table(spark, sf_dir), N_SAMPLES)
    return s.select("dim", "cluster_id", "size", "rep_phrase", "sample_phrases")


@query
def side_by_side(spark, sf_dir):
    ranked = TB.rank_in_group(TB.drop_unlabelled(labelled_sheet(spark, sf_dir)))
    return TB.side_by_side(ranked)


@query
def label_membership(spark, sf_dir):
    ranked = TB.rank_in_group(TB.drop_unlabelled(labelled_sheet(spark, sf_dir)))
    return TB.label_membership(ranked).select("aspect_label", "rep_phrase", "appears_in")


# --------------------------------------------------------------- topic table
from gleaner.operators import topics as TP  # noqa: E402

EARLY_STOP = 2000


def mentions(spark, sf_dir):
    return TP.valid_mentions(FX.responses(spark, sf_dir))


@query
def topic_fold(spark, sf_dir):
    return TP.fold_topics(mentions(spark, sf_dir), early_stop=None)


@query
def topic_early_stop(spark, sf_dir):
    return TP.fold_topics(mentions(spark, sf_dir), early_stop=EARLY_STOP)


@query
def topic_fold_seeds(spark, sf_dir):
    """Early stop and folding that start from the topic file's seeds and two of the events' own topics."""
    lines = FX.topic_lines(spark, sf_dir).select("line_no", F.regexp_replace("line", r" \(Count: \d+\)", "").alias("line"))
    own = spark.range(2).select((F.col("id") + 1_000_000).alias("line_no"),
                                F.element_at(F.array(F.lit("[1] CLICK: seed"), F.lit("[1] view: seed")), (F.col("id") + 1).cast("int")).alias("line"))
    return TP.fold_topics(mentions(spark, sf_dir), EARLY_STOP, TP.read_seed_topics(lines.unionByName(own))).drop("topic_order")


@query
def processed_responses(spark, sf_dir):
    resp = FX.responses(spark, sf_dir)
    return TP.processed_responses(resp, TP.valid_mentions(resp), EARLY_STOP).select("doc_pos", "response")


@query
def topic_rejects(spark, sf_dir):
    return TP.topic_rejects(FX.responses(spark, sf_dir))


@query
def parse_topic_lines(spark, sf_dir):
    return TP.parse_topic_lines(FX.topic_lines(spark, sf_dir)).filter(F.col("status") == "ok") \
             .select("line_no", "lvl", "name", "count", "desc")


def topic_tree(spark, sf_dir):
    return TP.topic_parents(TP.parse_topic_lines(FX.topic_lines(spark, sf_dir)))


@query
def topic_parents(spark, sf_dir):
    return topic_tree(spark, sf_dir)


@query
def topic_file_lines(spark, sf_dir):
    return TP.topic_file_lines(topic_tree(spark, sf_dir)).select(F.element_at("path", -1).alias("node_id"), "line")


@query
def topic_outline(spark, sf_dir):
    return TP.topic_outline(topic_tree(spark, sf_dir)).select(F.element_at("path", -1).alias("node_id"), "line")


@query
def find_duplicates(spark, sf_dir):
    """Every topic name of the tree, upper-cased, sought on its own level."""
    tree = topic_tree(spark, sf_dir)
    return TP.find_duplicates(tree, tree.select("lvl", F.upper("name").alias("name"))).select("sought", "lvl", "node_id", "name", "parent_id")


@query
def topic_names(spark, sf_dir):
    return TP.topic_names(topic_tree(spark, sf_dir))


@query
def remove_topic(spark, sf_dir):
    return TP.remove_topic(topic_tree(spark, sf_dir), "LARGE", 1)


@query
def merge_topics(spark, sf_dir):
    return TP.merge_topics(topic_tree(spark, sf_dir), [("economy", 1), ("PROMO", 1)], "VALUE",
                           "Mentions economy and promotional parts.")


@query
def drop_rare_topics(spark, sf_dir):
    return TP.drop_rare_topics(topic_tree(spark, sf_dir), 0.01)


@query
def topic_top_words(spark, sf_dir):
    return TP.topic_top_words(topic_tree(spark, sf_dir), 10)


# ------------------------------------------------------------ density clusters
from gleaner.operators import density as DEN  # noqa: E402

EPS = 1.2
MIN_SAMPLES = 5
MIN_CLUSTER_SIZE = 5


def density_points(spark, sf_dir):
    """(vec_id, x): the whole embeddings."""
    return FX.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))


@query
def knn(spark, sf_dir):
    r = DEN.knn(density_points(spark, sf_dir), MIN_SAMPLES)
    return r.select("src", "dst", F.round("dist", 9).alias("dist"), "rank")


@query
def knn_cosine(spark, sf_dir):
    r = DEN.knn(density_points(spark, sf_dir), MIN_SAMPLES, metric="cosine")
    return r.select("src", "dst", F.round("dist", 9).alias("dist"), "rank")


@query
def density_eps_cut(spark, sf_dir):
    return DEN.density_cluster(density_points(spark, sf_dir), EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE)


@query
def density_tree_cut(spark, sf_dir):
    """The clusters of ``density_eps_cut``, read off the spanning tree of mutual reachability."""
    pts = density_points(spark, sf_dir)
    return DEN.tree_clusters(pts, DEN.reachability_tree(pts, MIN_SAMPLES), EPS, MIN_CLUSTER_SIZE)


from gleaner.operators import hierarchy as HI  # noqa: E402


def _reach_tree(spark, sf_dir):
    return stage(spark, sf_dir, "reach_tree", lambda: DEN.reachability_tree(density_points(spark, sf_dir), MIN_SAMPLES))


@query
def density_hierarchy(spark, sf_dir):
    return HI.density_hierarchy(density_points(spark, sf_dir), MIN_SAMPLES, MIN_CLUSTER_SIZE, tree=_reach_tree(spark, sf_dir))


@query
def condensed_tree(spark, sf_dir):
    """Every cluster of the hierarchy: where it starts, what it is a part of, its stability, whether it is picked."""
    clusters, _ = HI.condensed_tree(*HI.merge_tree(_reach_tree(spark, sf_dir), MIN_CLUSTER_SIZE), MIN_CLUSTER_SIZE)
    return clusters.select(F.col("rep").alias("smallest_id"), "size", F.col("prep").alias("parent_id"), F.col("psize").alias("parent_size"),
                           F.round("birth", 6).alias("birth"), F.round("stability", 6).alias("stability"), "picked")


@query
def outlier_score(spark, sf_dir):
    pts = density_points(spark, sf_dir)
    labels = DEN.density_cluster(pts, EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE)
    nb = DEN.knn(pts, MIN_SAMPLES, include_self=True)
    o = DEN.outlier_score(labels, nb, MIN_SAMPLES)
    return o.select("vec_id", "cluster_id", F.round("core_dist", 9).alias("core_dist"),
                    F.round("outlier", 6).alias("outlier"))


from gleaner.operators import chain as CH  # noqa: E402

CHAIN_EPS = {5: 0.33, 10: 0.72}


@query
def cluster_chain(spark, sf_dir):
    """Units -> vectors -> two reductions -> density clusters -> representatives -> ranked sheet."""
    units = FX.phrases(spark, sf_dir).join(FX.vectors(spark, sf_dir).select("vec_id", "vec"), "vec_id")
    clustered = stage(spark, sf_dir, "chain_units", lambda: CH.clustered_units(units, CHAIN_EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE))
    r = CH.ranked_sheet(clustered, TOP_K, ALPHA, N_SAMPLES)
    return r.withColumn("rep_cosine_sim", F.round("rep_cosine_sim", 6))


# ------------------------------------------------------ embeddings, reduction
from gleaner.operators import embed as EMB  # noqa: E402

HASH_DIM = 64
PROJ_DIMS = (2, 3, 5, 10, 20, 50)


def _sparse(df, keys):
    return (df.select(*keys, F.posexplode("vec").alias("bucket", "value"))
              .filter(F.col("value") != 0)
              .select(*keys, "bucket", F.round("value", 6).alias("value")))


@query
def hash_embed(spark, sf_dir):
    e = EMB.hash_embed_sparse(mintoken_units(spark, sf_dir), HASH_DIM)
    return e.select("review_id", "unit_pos", "bucket", F.round("value", 6).alias("value"))


@query
def hash_embed_dense(spark, sf_dir):
    """The dense-vector form of the same encoder (array column per unit)."""
    e = EMB.hash_embed(mintoken_units(spark, sf_dir), HASH_DIM)
    return _sparse(e, ["review_id", "unit_pos"])


@query
def embed_units_plugin(spark, sf_dir):
    e = EMB.embed_units(mintoken_units(spark, sf_dir), EMB.hashing_encoder_factory(HASH_DIM), "hash64")
    return _sparse(e, ["review_id", "unit_pos"])


@query
def embed_models(spark, sf_dir):
    """Two encoders, one of them with unit-length vectors."""
    models = {"hash32": EMB.hashing_encoder_factory(32), "hash64": EMB.hashing_encoder_factory(HASH_DIM)}
    e = EMB.embed_models(mintoken_units(spark, sf_dir), models, normalise={"hash32": True})
    return _sparse(e, ["review_id", "unit_pos", "model"])


@query
def random_projection(spark, sf_dir):
    vecs = FX.vectors(spark, sf_dir)
    r = EMB.reduce_dims(vecs, PROJ_DIMS, "random", seed=42).filter(F.col("dim_label") != "orig")
    return r.select("vec_id", "dim_label", F.posexplode("vec").alias("pos", "value")) \
            .select("vec_id", "dim_label", "pos", F.round("value", 6).alias("value"))


@query
def reduce_manifest(spark, sf_dir):
    r = EMB.reduce_dims(FX.vectors(spark, sf_dir), PROJ_DIMS, "random", seed=42)
    return EMB.manifest(r).select("dim_label", "n_components", "rows")


@query
def pca_dims(spark, sf_dir):
    """PCA of the 64-d vectors to 5 and 10 components (no SQL oracle: rows only)."""
    vecs = FX.vectors(spark, sf_dir)
    parts = [EMB.pca_reduce(vecs, k, "vec", "p").select("vec_id", F.lit(f"{k}d").alias("dim_label"),
                                                        F.posexplode("p").alias("pos", "value"))
             for k in (5, 10)]
    return parts[0].unionByName(parts[1])


@query
def normalize_cosine(spark, sf_dir):
    """L2-normalised vectors and their cosine to the first coordinate axis."""
    from gleaner.functions.vectors import cosine_similarity, normalize_vec
    v = FX.vectors(spark, sf_dir)
    n = v.select("vec_id", normalize_vec("vec").alias("nv"), "vec")
    axis = F.transform(F.col("vec"), lambda x, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return n.select("vec_id", F.round(F.aggregate("nv", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq_norm"),
                    F.round(cosine_similarity(F.col("vec"), axis), 6).alias("cos_axis0"))


# ---------------------------------------------------------- sources and sinks
from gleaner.plans.stages import scratch_path  # noqa: E402
from gleaner.sources import io as IO  # noqa: E402


@query
def reviews_csv_roundtrip(spark, sf_dir):
    """Reviews written as multi-line quoted CSV and read back with a fixed schema."""
    path = scratch_path(spark, sf_dir, "reviews_csv")
    r = FX.reviews(spark, sf_dir).select(F.col("course_id").alias("CourseId"), F.col("review").alias("Review"),
                                         F.col("label").cast("string").alias("Label"))
    IO.write_table(r, path, "csv")
    return IO.read_reviews(spark, path)


@query
def corpus_roundtrip(spark, sf_dir):
    """Phrase corpus written as JSON lines (NULL labels omitted) and read back."""
    path = scratch_path(spark, sf_dir, "corpus_json")
    IO.write_corpus(R.to_corpus(mintoken_units(spark, sf_dir), label_col="label"), path)
    c = IO.read_corpus(spark, path)
    return c.select("id", "text", F.col("label").cast("int").alias("label"))


@query
def topic_words_roundtrip(spark, sf_dir):
    """Top words written as a digit-keyed JSON object per setting, read back
    through the four-shape VARIANT normaliser."""
    path = scratch_path(spark, sf_dir, "topic_words")
    words = setting_top_words(spark, sf_dir, "raw").withColumnRenamed("cluster", "topic")
    IO.write_topic_words(words, path, "dict")
    return IO.read_topic_words(spark, path).select("setting", "topic_id", "rank", "word")


# ------------------------------------------------- more table / topic operators
# A prompt template of our own (the reference's wording is not reproduced).
PROMPT_TEMPLATE = ("You will receive a document and a list of topics.\n"
                   "[Topics]\n{Topics}\n[Document]\n{Document}\n"
                   "Answer with lines in the form \"[1] Topic: description\" {{one per line}}.")
CONTEXT_LEN = 4000


@query
def check_alignment(spark, sf_dir):
    """Vector keys against document keys: one-sided and duplicated ids."""
    vecs = FX.table(spark, sf_dir, "embeddings").select("vec_id")
    docs = FX.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return CL.check_alignment(vecs, docs, "vec_id")


@query
def topic_list_forms(spark, sf_dir):
    """The four string forms of every topic of the tree, with the pre-order path."""
    t = TP.with_paths(topic_tree(spark, sf_dir))
    forms = [("name", False, False), ("desc", False, True), ("count", True, False), ("full", True, True)]
    out = None
    for label, c, d in forms:
        part = t.select("node_id", F.lit(label).alias("form"), TP.node_to_str(c, d).alias("topic"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def seed_topics(spark, sf_dir):
    """Seed-file lines ``[lvl] name: desc`` (from the part topic file) read as seeds."""
    lines = FX.topic_lines(spark, sf_dir).select(
        "line_no", F.regexp_replace("line", r" \(Count: \d+\)", "").alias("line"))
    return TP.read_seed_topics(lines).select("line_no", "lvl", "name", "count", "desc")


@query
def build_prompts(spark, sf_dir):
    """Generation prompts for every document with the folded topic list."""
    topics = TP.fold_topics(mentions(spark, sf_dir), early_stop=EARLY_STOP).select(
        F.col("topic_order").alias("order"), TP.node_to_str(False, True).alias("topic"))
    docs = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    p = TP.build_prompts(docs, topics, PROMPT_TEMPLATE, CONTEXT_LEN, 500, "text")
    return p.select("doc_id", "prompt", "pruned", "truncated")
