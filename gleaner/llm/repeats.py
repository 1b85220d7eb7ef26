"""Repeated windows of length L over sequences of symbols (words or bytes).

Shared by the two substring operators, which differ in how they compare
candidate segments (suffix trees, suffix array).  The steps:

1. Every window of L symbols is assigned to its *anchor*: the last smallest
   k-gram hash inside it.  Equal windows have equal anchors at equal offsets,
   so runs of windows of one anchor are one record (anchor, content hash of
   the run, place); only about 2 / (L - k + 2) of the positions give one.
2. Anchors at one place only cannot repeat and are dropped (partial
   aggregation, then a semi join that adaptive execution may split).
3. The texts around what is left, as *near runs*, go through 1 and 2 again
   with grams nearly as long as a window, which leaves little that does not
   repeat.  Records with equal content at two places repeat as a whole.
4. Different contents of one anchor can share some windows: one
   representative of each such content is read as a *run*, its anchor gram
   reduced to one symbol, and the operator's own method finds the windows
   that occur at two places of the runs.

Exact copies of a text share one 128-bit key, so they cost one text.  A text
that occurs twice and has a window is covered in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.common import PIECE, Stages

SPAN_SCHEMA = "run long, first int, last int"


def _anchor_runs(sums: np.ndarray, length: int, k: int, first_of: np.ndarray, end_of: np.ndarray):
    """Records of windows that lie inside one text.

    first_of / end_of: for texts in order, where their symbols start and end.
    Gives anchor, content, start and number of windows of each record.
    """
    w = length - k + 1
    g = C.gram_hash(sums, k)
    if len(g) < w:
        return None
    a, have = g, 1
    while have * 2 <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    if have < w:
        a = np.minimum(a[:len(a) - (w - have)], a[w - have:])
    last = end_of - length  # last window start of each text
    ok = np.zeros(len(a) + 1, np.int32)
    fit = last >= first_of
    np.add.at(ok, first_of[fit], 1)
    np.add.at(ok, last[fit] + 1, -1)
    valid = np.cumsum(ok[:-1]) > 0
    change = np.empty(len(a), bool)
    change[0] = True
    change[1:] = (a[1:] != a[:-1]) | ~valid[:-1]
    change |= g[w - 1:] == a
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    heads = np.flatnonzero(change[at])
    n = np.diff(np.append(heads, len(at)))
    start = at[heads]
    content = C.range_hash(sums, start, start + n - 1 + length)
    return a[start], content, start, n


def _anchor_place(sums: np.ndarray, k: int, anchor: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """Where the anchor gram of each record lies, from the record's start (the last of equal ones)."""
    g = C.gram_hash(sums, k)
    out = np.empty(len(start), np.int32)
    for i in range(0, len(start), 50_000):
        at = start[i:i + 50_000]
        same = g[at[:, None] + np.arange(w)] == anchor[i:i + 50_000, None]
        out[i:i + 50_000] = w - 1 - same[:, ::-1].argmax(axis=1)
    return out


def _symbols_of_words(buf, offsets, i, j):
    starts, ends = C.word_spans(buf, int(offsets[i]), int(offsets[j]), offsets[i:j])
    return C.word_hash(buf, starts, ends), np.searchsorted(starts, offsets[i:j + 1])


def _symbols_of_bytes(buf, offsets, i, j):
    lo, hi = int(offsets[i]), int(offsets[j])
    return C.byte_symbols(buf[lo:hi]), offsets[i:j + 1] - lo


def _stored_words(buf, offsets, i, j):
    lo, hi = int(offsets[i]), int(offsets[j])
    return buf[lo:hi].copy().view(np.uint64), (offsets[i:j + 1] - lo) // 8


#: How to read the symbols of texts, and of runs that were cut from them.
SYMBOLS = {("words", "text"): _symbols_of_words, ("bytes", "text"): _symbols_of_bytes,
           ("words", "symbols"): _stored_words, ("bytes", "symbols"): _symbols_of_bytes}


def _records(unit: str, column: str, keys: tuple[str, ...], length: int, k: int, place: bool = False):
    """mapInArrow body: (keys, text or symbols) -> records (anchor, content, keys, at, n)."""
    read = SYMBOLS[unit, column]

    def body(batches):
        for batch in batches:
            buf, offsets = C.text_buffer(batch[column])
            names = [batch[c].to_numpy() for c in keys]
            for i, j in C.runs_of_texts(offsets):
                symbols, first = read(buf, offsets, i, j)
                # pieces of windows; a piece overlaps the next by length - 1 symbols
                for p in range(0, max(1, len(symbols) - length + 1), PIECE):
                    q = min(len(symbols), p + PIECE + length - 1)
                    lo = np.clip(first[:-1], p, q) - p
                    hi = np.clip(first[1:], p, q) - p
                    sums = C.prefix_sums(symbols[p:q])
                    found = _anchor_runs(sums, length, k, lo, hi)
                    if found is None:
                        continue
                    anchor, content, start, n = found
                    doc = np.searchsorted(first, start + p, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), *[pa.array(x[i + doc]) for x in names],
                         pa.array((start + p - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
                         *([pa.array(_anchor_place(sums, k, anchor, start, length - k + 1))] if place else [])],
                        names=["anchor", "content", *keys, "at", "n", *(["gram_at"] if place else [])])

    return body


def merge_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, in order, touching ones joined."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    head = np.ones(len(first), bool)
    head[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(head)
    return first[at], last[np.append(at[1:], len(first)) - 1]


def _runs(unit: str, column: str, keys: tuple[str, ...], length: int):
    """mapInArrow body: (keys, text or symbols, want) -> each run of overlapping wanted records."""
    read = SYMBOLS[unit, column]

    def body(batches):
        for batch in batches:
            buf, offsets = C.text_buffer(batch[column])
            names = [batch[c].to_pylist() for c in keys]
            for r in range(batch.num_rows):
                if unit == "bytes":
                    symbols = buf[int(offsets[r]):int(offsets[r + 1])]
                else:
                    symbols, _ = read(buf, offsets, r, r + 1)
                flat = batch["want"][r].values
                at = flat.field("at").to_numpy().astype(np.int64)
                first, last = merge_spans(at, at + flat.field("n").to_numpy() - 1 + length)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.full(len(first), x[r])) for x in names], pa.array(first.astype(np.int32)),
                     pa.array((last - first - length + 1).astype(np.int32)),
                     pa.array([symbols[i:j].tobytes() for i, j in zip(first.tolist(), last.tolist())], pa.binary())],
                    names=[*keys, "start", "n", "symbols"])

    return body


def _reduced(unit: str, length: int, k: int):
    """mapInArrow body: (near, symbols, want) -> each wanted record with its anchor gram as one symbol.

    All windows of a record hold its anchor's k symbols, so a window of
    ``length`` symbols is one of ``length - k + 1`` symbols of the reduced
    record; two windows are equal exactly when their reduced ones are.
    """
    def body(batches):
        for batch in batches:
            near = batch["near"].to_pylist()
            for r, raw in enumerate(batch["symbols"].to_pylist()):
                symbols = np.frombuffer(raw, np.uint64 if unit == "words" else np.uint8).astype(np.uint64)
                rows = []
                for x in batch["want"][r].as_py():
                    i, g, j = x["at"], x["at"] + x["gram_at"], x["at"] + x["n"] - 1 + length
                    gram = np.array([x["anchor"]], np.int64).view(np.uint64)
                    rows.append((i, x["n"], x["anchor"], np.concatenate([symbols[i:g], gram, symbols[g + k:j]]).tobytes()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), near[r])), pa.array([x[0] for x in rows], pa.int32()),
                    pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.int64()),
                    pa.array([x[3] for x in rows], pa.binary())],
                    names=["near", "at", "n", "g", "symbols"])

    return body


def _cut(unit: str):
    """mapInArrow body: (k1, k2, text, spans) -> counts and what is kept."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def body(batches):
        for batch in batches:
            buf, offsets = C.text_buffer(batch["text"])
            k1, k2 = batch["k1"].to_pylist(), batch["k2"].to_pylist()
            for r in range(batch.num_rows):
                flat = batch["spans"][r].values
                first, last = merge_spans(flat.field("first").to_numpy().astype(np.int64),
                                          flat.field("last").to_numpy().astype(np.int64))
                lo, hi = int(offsets[r]), int(offsets[r + 1])
                raw = buf[lo:hi].tobytes()
                if unit == "bytes":
                    edges = np.concatenate([[0], np.stack([first, last], 1).ravel(), [hi - lo]]).tolist()
                    kept = b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
                else:
                    starts, ends = C.word_spans(buf, lo, hi, offsets[r:r + 1])
                    gone = np.zeros(len(starts) + 1, np.int32)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, last, -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    kept = b" ".join([raw[s:e] for s, e in zip((starts[stay] - lo).tolist(), (ends[stay] - lo).tolist())])
                yield pa.RecordBatch.from_arrays([
                    pa.array([k1[r]]), pa.array([k2[r]]), pa.array([int((last - first).sum())]), pa.array([len(first)]),
                    pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept], pa.binary())], schema=schema)

    return body


def _at_two_places(records: DataFrame, place: tuple[str, ...], stages: Stages) -> DataFrame:
    """Records whose anchor is at two places at least."""
    where = F.xxhash64(*place, "at")
    multi = (records.groupBy("anchor").agg(F.min(where).alias("p"), F.max(where).alias("q"))
             .where("p <> q").select("anchor"))
    return records.join(stages.put("multi-" + place[0], multi), "anchor", "left_semi")


def repeated_spans(docs: DataFrame, text_col: str, unit: str, length: int, k: int, stages: Stages,
                   resolve: Callable[[DataFrame, int, Stages], DataFrame]) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256, kept) of every text that repeats in part.

    ``resolve(runs, width, stages)`` is the operator's method: it takes reduced
    runs (run, anchor g, n windows, 64-bit symbols) and gives spans (run, first, last):
    the windows first..last - 1, of ``width`` reduced symbols, that also start
    anywhere else.
    Texts shorter than ``length`` and texts without repeats give no row.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(t.alias("text")).select(*C.text_key(F.col("text")), "text")
    place = ("k1", "k2")
    records = stages.put("records", keyed.mapInArrow(
        _records(unit, "text", place, length, k), "anchor long, content long, k1 long, k2 long, at int, n int").drop("content"))
    found = stages.put("found", _at_two_places(records, place, stages))
    candidates = stages.put("candidates", found.select(*place).distinct())
    texts = stages.put("texts", C.texts_of(docs, text_col, candidates))
    want = found.groupBy(*place).agg(F.collect_list(F.struct("at", "n")).alias("want"))
    near = stages.put("near", texts.join(want, [*place]).mapInArrow(
        _runs(unit, "text", place, length), "k1 long, k2 long, start int, n int, symbols binary")
        .select(F.xxhash64("k1", "k2", "start").alias("near"), "*"))
    stages.drop("records")
    stages.drop("found")

    # again on what is left, with grams nearly as long as a window
    long_k = max(k, length - max(1, length // 10))
    place = ("near",)
    records = stages.put("records2", near.select("near", "symbols").mapInArrow(
        _records(unit, "symbols", place, length, long_k, True),
        "anchor long, content long, near long, at int, n int, gram_at int"))
    found = stages.put("found2", _at_two_places(records, place, stages).withColumn("sid", F.xxhash64("anchor", "content")))
    # contents: at two places, or to be compared with the anchor's others
    where = F.xxhash64("near", "at")
    contents = stages.put("contents", found.groupBy("anchor", "sid").agg(
        F.min(where).alias("p"), F.max(where).alias("q"), F.min(F.struct("near", "at", "n", "gram_at")).alias("rep")))
    groups = contents.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    want = (contents.join(groups, "anchor", "left_semi").select("anchor", "rep.*")
            .groupBy("near").agg(F.collect_list(F.struct("at", "n", "gram_at", "anchor")).alias("want")))
    runs = stages.put("runs", near.select("near", "symbols").join(want, "near").mapInArrow(
        _reduced(unit, length, long_k), "near long, at int, n int, g long, symbols binary")
        .select(F.xxhash64("near", "at").alias("run"), "*"))
    shared = stages.put("shared", resolve(runs.select("run", "g", "n", "symbols"), length - long_k + 1, stages))

    whole = (found.join(contents.where("p <> q").select("sid"), "sid", "left_semi")
             .select("near", F.col("at").alias("first"), (F.col("at") + F.col("n") + (length - 1)).alias("last")))
    # a content at one place only is its own representative
    part = (runs.select("run", "near", "at").join(shared, "run")
            .select("near", (F.col("at") + F.col("first")).alias("first"),
                    (F.col("at") + F.col("last") + (length - 1)).alias("last")))
    spans = whole.union(part).join(near.select("near", "k1", "k2", F.col("start").alias("base")), "near")
    spans = (spans.select("k1", "k2", (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("last")).alias("last"))
             .groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    cut = stages.put("cut", texts.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(
        _cut(unit), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    for key in ("records2", "found2", "contents", "candidates", "texts", "near", "runs", "shared"):
        stages.drop(key)
    return cut


def per_text(narrow: DataFrame, cut: DataFrame, stages: Stages, size: str, length: int) -> DataFrame:
    """Join what was cut to every document by text key; copies with a window are covered in full.

    ``narrow`` holds k1, k2, the number of symbols in ``size``, ``full_sha256``
    and whatever else is to be kept.  Adds n_removed, n_spans, kept_sha256.
    """
    copies = (narrow.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.first(size).alias("s"))
              .where((F.col("m") > 1) & (F.col("s") >= length)).select("k1", "k2", F.lit(True).alias("all")))
    changed = stages.put("changed", copies.join(cut.drop("kept"), ["k1", "k2"], "full"))
    gone = F.coalesce(F.col("all"), F.lit(False))
    return (narrow.join(changed, ["k1", "k2"], "left")
            .withColumn("n_removed", F.when(gone, F.col(size)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long"))
            .withColumn("n_spans", F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"))
            .withColumn("kept_sha256", F.when(gone, F.sha2(F.lit(""), 256))
                        .otherwise(F.coalesce("kept_sha256", "full_sha256")))
            .drop("all", "full_sha256"))
