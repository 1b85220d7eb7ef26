"""Substring dedup by prefix-partitioned suffix trees, over words.

A word is removed when a window of ``length`` words covers it whose word
sequence also starts anywhere else.  Candidate runs come from ``repeats``.
The runs' suffixes are then split by prefixes of *variable length* into
memory-sized groups: a few words first, and where a group has more than
``group_size`` suffixes the prefix doubles up to ``length``.  In a group, the
suffix tree is built as the tree of longest common prefixes of its sorted suffixes; internal
nodes at least ``length`` words deep are the maximal repeats, and the leaves
under them are windows that occur more than once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm import repeats as R
from gleaner.llm.common import Stages, session

WINDOW_WORDS = 35
ANCHOR_WORDS = 15
GROUP_SUFFIXES = 20_000


def _suffixes(length: int, depth: int):
    """mapInArrow body: runs -> one row per suffix (window), keyed by a prefix of ``depth`` words."""
    schema = pa.schema([("prefix", pa.int64()), ("run", pa.int64()), ("at", pa.int32()), ("symbols", pa.binary())])

    def body(batches):
        for batch in batches:
            for run, n, raw in zip(batch["run"].to_pylist(), batch["n"].to_pylist(), batch["symbols"]):
                words = np.frombuffer(raw.as_buffer(), np.uint64)
                sums = C.prefix_sums(words)
                at = np.arange(n)
                prefix = C.range_hash(sums, at, at + depth)
                width = 8 * length
                data = raw.as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(prefix.view(np.int64)), pa.array(np.full(n, run)), pa.array(at.astype(np.int32)),
                    pa.array([data[8 * i:8 * i + width] for i in range(n)], pa.binary())], schema=schema)

    return body


def deep_leaves(words: np.ndarray, length: int) -> np.ndarray:
    """Rows of ``words`` (suffixes, cut after ``length`` words) that lie under a deep internal node.

    The sorted suffixes and the longest common prefix of neighbours are the
    suffix tree of the group; a leaf lies under an internal node of depth
    ``length`` when a neighbour shares that many words with it.
    """
    if len(words) < 2:
        return np.zeros(len(words), bool)
    order = np.lexsort(words.T[::-1])
    same = words[order[1:]] == words[order[:-1]]
    lcp = np.where(same.all(axis=1), length, same.argmin(axis=1))
    deep = np.zeros(len(words), bool)
    deep[order[1:][lcp >= length]] = True
    deep[order[:-1][lcp >= length]] = True
    return deep


def _grow_tree(length: int):
    """applyInArrow body: the suffixes of one group of prefixes -> windows that repeat."""
    def body(table: pa.Table) -> pa.Table:
        raw = b"".join(table["symbols"].to_pylist())
        words = np.frombuffer(raw, np.uint64).reshape(-1, length)
        deep = deep_leaves(words, length)
        at = table["at"].to_numpy()[deep].astype(np.int32)
        return pa.table({"run": table["run"].to_numpy()[deep], "first": at, "last": (at + 1).astype(np.int32)},
                        schema=pa.schema([("run", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))

    return body


def suffix_tree_repeats(start_depth: int = 2, group_size: int = GROUP_SUFFIXES):
    """The method as a ``resolve`` function of ``repeats.repeated_spans``."""
    def resolve(runs: DataFrame, length: int, stages: Stages) -> DataFrame:
        parts: list[DataFrame] = []
        depth, turn = min(start_depth, length), 0
        total = runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]
        groups = max(1, -(-2 * total // group_size))
        suffixes = stages.put(f"suffixes{turn}", runs.mapInArrow(
            _suffixes(length, depth), "prefix long, run long, at int, symbols binary"))
        while True:
            sizes = stages.put(f"sizes{turn}", suffixes.groupBy("prefix").agg(F.count("*").alias("c")))
            # prefixes of one suffix hang off a leaf edge; small ones are packed into memory-sized groups
            small = sizes.where(f"c > 1 and c <= {group_size}").select("prefix")
            packed = (suffixes.join(small, "prefix").withColumn("grp", F.pmod(F.xxhash64("prefix"), F.lit(groups))))
            parts.append(stages.put(f"leaves{turn}", packed.groupBy("grp").applyInArrow(_grow_tree(length), R.SPAN_SCHEMA)))
            large = sizes.where(f"c > {group_size}").select("prefix")
            if not large.limit(1).count():
                break
            over = suffixes.join(large, "prefix")
            if depth >= length:  # one internal node of full depth: all its suffixes repeat
                parts.append(over.select("run", F.col("at").alias("first"), (F.col("at") + 1).alias("last")))
                break
            turn, depth = turn + 1, min(length, 2 * depth)
            head = F.expr(f"substring(symbols, 1, {8 * depth})")
            suffixes = stages.put(f"suffixes{turn}", over.withColumn("prefix", F.xxhash64(head)))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    return resolve


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW_WORDS,
                    anchor: int = ANCHOR_WORDS, group_size: int = GROUP_SUFFIXES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_spans, kept_sha256.

    Null texts have no words; texts of fewer than ``length`` words lose
    nothing; repeated rows count as copies (all copies lose the window);
    other columns are not read.  kept_sha256 is over the kept words joined by
    one space.  An empty table gives an empty table.
    """
    stages = Stages(session(docs), "substring")
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"))
    words = F.filter(F.split("text", C.WORD_GAP), lambda w: w != "")
    narrow = stages.put("narrow", narrow.withColumn("w", words).select(
        "doc_id", *C.text_key(F.col("text")), F.size("w").cast("long").alias("n_words"),
        F.sha2(F.array_join("w", " "), 256).alias("full_sha256")))
    cut = R.repeated_spans(docs, text_col, "words", length, min(anchor, length), stages,
                           suffix_tree_repeats(group_size=group_size))
    return R.per_text(narrow, cut, stages, "n_words", length).select(
        "doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = WINDOW_WORDS,
                   anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` with the repeated windows taken out of ``text_col``.

    A text that loses words becomes its kept words joined by one space; one
    that loses all of them goes.  Untouched texts, null ones too, stay as
    they are, and so do all other columns.
    """
    stages = Stages(session(docs), "substring")
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = R.repeated_spans(docs, text_col, "words", length, min(anchor, length), stages, suffix_tree_repeats())
    copies = (docs.select(t.alias("t")).select(*C.text_key(F.col("t")), F.size(
        F.filter(F.split("t", C.WORD_GAP), lambda w: w != "")).alias("s"))
        .groupBy("k1", "k2").agg(F.count("*").alias("m"), F.first("s").alias("s"))
        .where(f"m > 1 and s >= {length}").select("k1", "k2", F.lit(True).alias("all")))
    changed = stages.put("changed", copies.join(cut.select("k1", "k2", "kept"), ["k1", "k2"], "full")
                         .select("k1", "k2", F.when(F.col("all"), F.lit(b"")).otherwise(F.col("kept")).alias("kept")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("t"))
    joined = (rows.select("row", *C.text_key(F.col("t"))).join(changed, ["k1", "k2"], "left")
              .where("kept is null or length(kept) > 0"))
    text = F.when(F.col("kept").isNull(), F.col("row")[text_col]).otherwise(F.decode("kept", "UTF-8"))
    return joined.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
