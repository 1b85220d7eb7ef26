"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by key
within their source, distributed prefix sums of their sizes give each its
place, and each source is cut at its exact budget.  A budget above a source's
size repeats whole epochs first; the rest of the budget takes documents in
key order, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.common import Stages, session

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words, without keeping them: one character is left of each."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, C.WORD_GAP), "")
    return F.size(words).cast("long")


def random_key(id_: Column, seed: str = SEED) -> Column:
    """The same pseudo-random hexadecimal key for an id in every run."""
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary")), 1, 16)


def targets(sizes: DataFrame, stages: Stages, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(grp, source_size, target): what each source gives; ``sizes(grp, source_size)`` has a row per source.

    Sources in order of ``grp`` weigh ``weights`` in turn and share
    percent / 100 of all sizes; a target stops at ``max_epochs`` times its
    source's size and the excess is shared anew by weight until none is above.
    """
    ranked = C.running_totals(sizes.withColumn("one", F.lit(1)), ["grp"], ["one"], stages, "ranked-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    table = stages.put("weights", ranked.select("grp", "source_size", weight.cast("long").alias("weight")))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    cap = F.col("source_size") * max_epochs
    capped, budget, share = F.lit(False), percent * total / 100.0, 0.0
    known = 0
    while True:  # each turn caps at least one source more, or ends
        free = table.where(~capped).agg(F.sum("weight").alias("w"), F.count("*").alias("c")).first()
        if not free["c"]:
            share = 0.0
            break
        taken = table.where(capped).agg(F.coalesce(F.sum(cap), F.lit(0)).alias("s")).first()["s"]
        rest, all_weight = budget - taken, float(free["w"])
        target = F.col("weight") * F.lit(rest) / F.lit(all_weight)
        above = capped | (target > cap)
        n = table.where(above).count()
        if n == known:
            share = target
            break
        # a source that is above once stays at its cap: what the others share only grows
        capped, known = above, n
    return table.select("grp", "source_size", F.when(capped, cap.cast("double")).otherwise(share).cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS,
        stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), k1, k2.

    A null text has size 0 and gives nothing; a null source is a source of
    its own and comes last; repeated rows are documents of their own (equal
    rows may share the cut, in either order, to the same total).  The budget
    of a source is its target rounded to whole words.
    """
    stages = stages or Stages(session(docs), "mixing")
    return _takes(docs, id_col, text_col, source_col, weights, percent, max_epochs, stages, [])


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes (r1, r2) of a row's columns other than id and text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return [k.alias(name) for k, name in zip(C.text_key(F.to_json(F.struct(*rest), exact) if rest else F.lit("")), ("r1", "r2"))]


def _takes(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], percent: int,
           max_epochs: int, stages: Stages, row_key: list[Column]) -> DataFrame:
    """The rows of ``mix``, with the columns of ``row_key``, which also order equal documents."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words(t).alias("size"),
                       F.when(src.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), src)).alias("grp"),
                       random_key(F.col(id_col)).alias("key"), *C.text_key(t), *row_key)
    extra = rows.columns[6:]
    placed = C.running_totals(rows, ["key", "size", "k1", "k2", *extra], ["size"], stages, "placed", group="grp")
    placed = stages.put("prefix", placed)
    sizes = stages.put("sizes", placed.groupBy("grp").agg(F.sum("size").alias("source_size")))
    goal = stages.put("targets", targets(sizes, stages, weights, percent, max_epochs))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div greatest(source_size, 1)")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("size_before")))
    return placed.join(goal, "grp").select("doc_id", "size", "source_size", "target",
                                           (epochs * F.col("size") + part).cast("long").alias("taken"), "k1", "k2", *extra)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: ``docs`` repeated as often as they are taken, the document at a cut shortened.

    Whole copies keep the text as it is; a part holds the first words, joined
    by one space.  Documents of which nothing is taken go.
    """
    stages = Stages(session(docs), "mixing")
    row_key = _row_key(docs, id_col, text_col)
    found = stages.put("mix", _takes(docs, id_col, text_col, source_col, weights, percent, max_epochs, stages, row_key)
                       .where("taken > 0").select(F.col("doc_id").alias("m_id"), "size", "taken", "k1", "k2", "r1", "r2"))
    # rows equal in every column have several takes; sum them and deal them out again by row
    key = ["k1", "k2", "r1", "r2"]
    renamed = lambda p: {c: p + c for c in key}
    shares = stages.put("shares", found.groupBy("m_id", *key, "size").agg(
        F.sum("taken").alias("taken")).withColumnsRenamed(renamed("m")))
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), t.alias("t"), *row_key)
    one = one.select("row", "id", "t", *C.text_key(F.col("t")), "r1", "r2")
    twice = stages.put("twice", one.groupBy("id", *key).agg(F.count("*").alias("c")).where("c > 1")
                       .withColumnsRenamed({"id": "t_id", **renamed("t")}))

    def same(p):
        on = F.col("id").eqNullSafe(F.col(f"{p}_id"))
        for c in key:
            on = on & (F.col(c) == F.col(p + c))
        return on

    single = one.join(twice, same("t"), "left_anti")
    folded = (one.join(twice, same("t"), "left_semi").groupBy("id", *key)
              .agg(F.first("row").alias("row"), F.first("t").alias("t")).select("row", "id", "t", *key))
    taken = single.union(folded).join(shares, same("m"))
    copies = taken.withColumn("copy", F.explode(F.expr("sequence(0, cast((taken - 1) div size as int))")))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    part = F.array_join(F.slice(F.array_remove(F.split("t", C.WORD_GAP), ""), 1, words.cast("int")), " ")
    text = F.when(words >= F.col("size"), F.col("row")[text_col]).otherwise(part)
    return copies.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
