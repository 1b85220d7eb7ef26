"""C_v topic coherence.

Boolean sliding windows of 110 tokens over each text (a shorter text is one
window), probabilities p(w) and p(w, w') as window fractions, NPMI with
eps = 1e-12, and per topic the mean over its words of the cosine between
the word's NPMI vector and the sum of all the topic's NPMI vectors.

Windows are never materialised one by one.  The texts are read once for the
places of their topic words (a look-up a token, no shuffle).  A text of at
most 110 tokens is a single window, whose word set is what was found.
Along a longer text the set of topic words inside the window only changes
where a window starts 109 tokens before an occurrence or one token after
it; those change points cut the window starts into *segments* of identical
word sets, each weighted by its number of starts.  Occurrences are matched
to segments with an equi-join on 110-token buckets plus a range filter, so a
text costs O(occurrences x words per window), never O(length x window).
Word pairs are counted per pair with map-side partial aggregation and only
then restricted to pairs inside one topic.

Denominator: ``'relevant'`` counts windows of texts holding at least one of
the setting's topic words (what the common library does), ``'all'`` counts
windows of every non-empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import coherence_tokens
from gleaner.session import checkpoint_dir

WINDOW = 110
EPS = 1e-12
# Topic words are broadcast only up to this many distinct words.
BROADCAST_WORDS_LIMIT = 200_000
# Up to this many words a plan holds the words themselves (one set a task, one look-up a token).
LISTED_WORDS = 10_000


def tokenised_texts(units: DataFrame, text_cols: Sequence[str] = ("review_id", "unit_pos"),
                    text_col: str = "unit") -> DataFrame:
    """``(text_id..., tokens)`` with the coherence tokenizer.

    The generator makes a text be tokenised once a scan, however often a plan names ``tokens``.
    """
    return units.select(*text_cols, F.explode(F.array(coherence_tokens(text_col))).alias("tokens"))


def vocabulary(texts: DataFrame, id_cols: Sequence[str] = ("review_id", "unit_pos")) -> DataFrame:
    """``(term, df)``: the dictionary with document frequencies."""
    ids = list(id_cols)
    return (texts.select(*ids, F.explode(F.array_distinct("tokens")).alias("term"))
                 .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def present_terms(texts: DataFrame, topics: DataFrame) -> DataFrame:
    """``(term)``: the topic words (after re-tokenising) that occur in some text.

    Equivalent to the vocabulary for ``clean_topics``' membership test, but it
    only looks each token up among the candidates instead of aggregating every term."""
    cand = topics.select(F.explode(coherence_tokens("word")).alias("word")).distinct()
    known = _known_words(cand)
    if known is not None:
        return texts.select(F.explode(F.filter("tokens", lambda t: t.isin(known))).alias("term")).distinct()
    return texts.select(F.explode("tokens").alias("term")).join(cand.select(F.col("word").alias("term")), "term", "left_semi").distinct()


def _known_words(words: DataFrame) -> list[str] | None:
    """The words of a table of up to ``LISTED_WORDS`` of them, else None."""
    some = [r["word"] for r in words.limit(LISTED_WORDS + 1).collect()]
    return some if len(some) <= LISTED_WORDS else None


def clean_topics(topics: DataFrame, vocab: DataFrame, setting_cols: Sequence[str] = ("setting",),
                 topic_col: str = "topic") -> DataFrame:
    """Re-tokenise topic words like the texts; drop words outside the vocabulary
    and topics left empty.  Returns ``(*setting, topic, pos, word)``; a word
    may repeat inside a topic (each position counts, as in the reference)."""
    s = list(setting_cols)
    joined = topics.groupBy(*s, topic_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))),
                                 lambda x: x["word"]), " ").alias("_txt"))
    toks = joined.select(*s, topic_col, F.posexplode(coherence_tokens("_txt")).alias("_p", "word"))
    kept = toks.join(vocab.select(F.col("term").alias("word")), "word", "left_semi")
    w = Window.partitionBy(*s, topic_col).orderBy("_p")
    return kept.withColumn("pos", F.row_number().over(w) - 1).select(*s, topic_col, "pos", "word")


def _occurrences(texts: DataFrame, words: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """``(text..., L, occ)``: the topic words of each text that holds any, with their places
    (``array<struct<i, word>>``), the only tokens C_v needs."""
    ids = list(id_cols)
    places = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t.alias("word")))
    known = _known_words(words)
    if known is not None:
        occ = F.filter(places, lambda x: x["word"].isin(known))
    else:
        # one row of words; a text is cut to those it holds before its places are looked up
        listed = words.agg(F.collect_list("word").alias("_tw"))
        texts = texts.crossJoin(F.broadcast(listed)).withColumn("_tw", F.array_intersect("tokens", "_tw"))
        occ = F.filter(places, lambda x: F.array_contains("_tw", x["word"]))
    return texts.select(*ids, F.size("tokens").alias("L"), F.explode(F.array(occ)).alias("occ")).filter(F.size("occ") > 0)


def _window_segments(occ: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """``(text..., seg, seg_len, word)``: each distinct topic word present in
    each segment of identical windows, ``seg_len`` windows per segment."""
    ids = list(id_cols)
    short = (occ.filter(F.col("L") <= WINDOW)
                .select(*ids, F.lit(0).alias("seg"), F.lit(1).alias("seg_len"), "word").distinct())
    long_occ = occ.filter(F.col("L") > WINDOW).withColumn("S", F.col("L") - WINDOW)
    # change points of the window-start axis [0, S]
    cuts = (long_occ.select(*ids, "S", F.explode(F.array(
                F.lit(0), F.greatest(F.lit(0), F.col("i") - (WINDOW - 1)), F.col("i") + 1)).alias("seg"))
            .filter(F.col("seg") <= F.col("S")).distinct())
    w = Window.partitionBy(*ids).orderBy("seg")
    segs = cuts.withColumn("seg_len", F.coalesce(F.lead("seg").over(w), F.col("S") + 1) - F.col("seg"))
    # occurrences at i lie in the window starting at seg iff seg <= i <= seg + WINDOW - 1
    seg_b = segs.select(*ids, "seg", "seg_len",
                        F.explode(F.array(F.floor(F.col("seg") / WINDOW),
                                          F.floor(F.col("seg") / WINDOW) + 1)).alias("b"))
    occ_b = long_occ.select(*ids, "i", "word", F.floor(F.col("i") / WINDOW).alias("b"))
    hits = (seg_b.join(occ_b, [*ids, "b"])
                 .filter((F.col("i") >= F.col("seg")) & (F.col("i") <= F.col("seg") + (WINDOW - 1)))
                 .select(*ids, "seg", "seg_len", "word").distinct())
    return short.unionByName(hits)


def _segment_word_sets(texts: DataFrame, topics: DataFrame, ids) -> DataFrame:
    """``(text..., L, seg, seg_len, ws)``: the sorted distinct topic words of
    every window segment.

    The texts are read once.  A text of at most ``WINDOW`` tokens is one window,
    whose word set needs no shuffle.  Longer texts go through change-point
    segments (``_window_segments``).
    """
    held = _occurrences(texts, topics.select("word").distinct(), ids).checkpoint(eager=True)
    short = held.filter(F.col("L") <= WINDOW).select(
        *ids, "L", F.lit(0).alias("seg"), F.lit(1).alias("seg_len"),
        F.array_sort(F.array_distinct(F.col("occ.word"))).alias("ws"))
    occs = held.filter(F.col("L") > WINDOW).select(*ids, "L", F.inline("occ"))
    lengths = occs.select(*ids, "L").distinct()
    long_sets = (_window_segments(occs, ids)
                 .groupBy(*ids, "seg", "seg_len").agg(F.array_sort(F.collect_set("word")).alias("ws"))
                 .join(lengths, ids))
    return short.unionByName(long_sets.select(*ids, "L", "seg", "seg_len", "ws"))


def coherence_cv(texts: DataFrame, topics: DataFrame, setting_cols: Sequence[str] = ("setting",),
                 topic_col: str = "topic", id_cols: Sequence[str] = ("review_id", "unit_pos"),
                 denominator: str = "relevant") -> DataFrame:
    """Per-topic C_v: ``(*setting, topic, n_words, c_v)``.

    ``texts`` is ``(id..., tokens)``; ``topics`` is the cleaned
    ``(*setting, topic, pos, word)`` table from ``clean_topics``.  The topic
    table (settings x topics x top-n words) is broadcast after a size check.
    """
    s, ids = list(setting_cols), list(id_cols)
    # The topic table is small and read by several branches below:
    # checkpoint it once to the shared folder.
    checkpoint_dir(topics.sparkSession)
    topics = topics.checkpoint(eager=True)
    n_words = topics.select("word").distinct().limit(BROADCAST_WORDS_LIMIT + 1).count()
    if n_words > BROADCAST_WORDS_LIMIT:
        raise ValueError("topic word table exceeds the broadcast bound")
    words_by_setting = topics.select(*s, "word").distinct()

    sets = _segment_word_sets(texts, topics, ids).checkpoint(eager=True)
    # p(w): windows containing w (partial aggregation by word)
    occ = (sets.select("seg_len", F.explode("ws").alias("word"))
               .groupBy("word").agg(F.sum("seg_len").alias("c_w")))
    # p(w, w'): pairs of distinct words of one window segment, summed per word
    # pair first (map-side), then kept only for pairs inside one topic
    pairs_of = F.flatten(F.transform(
        "ws", lambda x, i: F.transform(F.slice(F.col("ws"), i + 2, F.size(F.col("ws"))),
                                       lambda y: F.struct(x.alias("w1"), y.alias("w2")))))
    pair_counts = (sets.filter(F.size("ws") > 1).select("seg_len", F.explode(pairs_of).alias("_p"))
                       .groupBy(F.col("_p.w1").alias("w1"), F.col("_p.w2").alias("w2"))
                       .agg(F.sum("seg_len").alias("c_12")))
    ta = topics.select(*s, topic_col, F.col("word").alias("w1"))
    tb = topics.select(*s, topic_col, F.col("word").alias("w2"))
    topic_pairs = ta.join(tb, [*s, topic_col]).filter(F.col("w1") < F.col("w2")).distinct()
    co = pair_counts.join(F.broadcast(topic_pairs), ["w1", "w2"])

    # window totals per setting
    if denominator == "all":
        tot = texts.filter(F.size("tokens") > 0).agg(
            F.sum(F.greatest(F.size("tokens") - (WINDOW - 1), F.lit(1))).alias("n_windows"))
        totals = words_by_setting.select(*s).distinct().crossJoin(tot)  # settings x one row
    elif denominator == "relevant":
        # a text is relevant to a setting when it holds one of its words
        text_words = sets.select(*ids, "L", F.explode("ws").alias("word")).distinct()
        rel = (text_words.join(F.broadcast(words_by_setting), "word").select(*s, *ids, "L").distinct())
        totals = rel.groupBy(*s).agg(F.sum(F.greatest(F.col("L") - (WINDOW - 1), F.lit(1))).alias("n_windows"))
    else:
        raise ValueError(f"unknown denominator {denominator!r}")

    ti = topics.select(*s, topic_col, F.col("pos").alias("i"), F.col("word").alias("wi"))
    tj = topics.select(*s, topic_col, F.col("pos").alias("j"), F.col("word").alias("wj"))
    pairs = ti.join(tj, [*s, topic_col])  # all position pairs of one topic: <= n^2 rows per topic
    occ_i = occ.select(F.col("word").alias("wi"), F.col("c_w").alias("c_i"))
    occ_j = occ.select(F.col("word").alias("wj"), F.col("c_w").alias("c_j"))
    co_ab = co.select(*s, topic_col, F.col("w1").alias("wi"), F.col("w2").alias("wj"), "c_12")
    co_ba = co.select(*s, topic_col, F.col("w2").alias("wi"), F.col("w1").alias("wj"), "c_12")
    co_sym = co_ab.unionByName(co_ba)
    pairs = (pairs.join(occ_i, "wi", "left").join(occ_j, "wj", "left")
                  .join(co_sym, [*s, topic_col, "wi", "wj"], "left")
                  .join(totals, s))
    n = F.col("n_windows").cast("double")
    c12 = F.when(F.col("wi") == F.col("wj"), F.col("c_i")).otherwise(F.coalesce(F.col("c_12"), F.lit(0)))
    p12 = c12 / n + F.lit(EPS)
    pij = (F.col("c_i") / n) * (F.col("c_j") / n)
    npmi = F.when(F.col("c_i").isNull() | F.col("c_j").isNull() | (pij == 0), F.lit(0.0)) \
            .otherwise(F.log(p12 / pij) / (-F.log(p12)))
    # v_i[u] = sum over positions j with word u of npmi(w_i, u)
    v = (pairs.withColumn("npmi", npmi)
              .groupBy(*s, topic_col, "i", "wj").agg(F.sum("npmi").alias("v")))
    vstar = v.groupBy(*s, topic_col, "wj").agg(F.sum("v").alias("vs"))
    vv = v.join(vstar, [*s, topic_col, "wj"])
    per_word = vv.groupBy(*s, topic_col, "i").agg(
        F.sum(F.col("v") * F.col("vs")).alias("dot"),
        F.sqrt(F.sum(F.col("v") ** 2)).alias("nv"),
        F.sqrt(F.sum(F.col("vs") ** 2)).alias("ns"))
    cos = F.when((F.col("nv") == 0) | (F.col("ns") == 0), F.lit(0.0)) \
           .otherwise(F.col("dot") / (F.col("nv") * F.col("ns")))
    return (per_word.groupBy(*s, topic_col)
                    .agg(F.count(F.lit(1)).alias("n_words"), F.avg(cos).alias("c_v")))


def coherence_summary(per_topic: DataFrame, setting_cols: Sequence[str] = ("setting",),
                      settings: DataFrame | None = None) -> DataFrame:
    """Mean C_v per setting with the number of topics.

    ``settings`` names every setting: one without topics has k = 0 and a NULL mean.
    """
    s = list(setting_cols)
    out = per_topic.groupBy(*s).agg(F.count(F.lit(1)).alias("k"), F.avg("c_v").alias("avg_c_v"))
    if settings is None:
        return out
    return settings.select(*s).distinct().join(out, s, "left").fillna(0, subset=["k"])
