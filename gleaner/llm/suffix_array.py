"""Suffix-array dedup over bytes, by a distributed difference-cover algorithm.

A byte is removed when a string of ``length`` bytes covers it that also
starts anywhere else.  Candidate runs come from ``repeats``, the long gram
that all strings of a run share reduced to one symbol; the suffixes of all
runs are sorted together:

* Places 1 and 2 modulo 3 (a difference cover) are the sample.  Their triples
  of symbols are sorted and named by rank; triples of names (3, then 9 symbols
  on) are sorted and named again, until a name stands for a whole string.
  Names that occur once rule out the strings that hold them, so such places
  leave early.
* Remaining places (0 modulo 3) are merged in: against class 1 by (symbol,
  rank at p + 1), against class 2 by (two symbols, rank at p + 2).  Each
  comparison is one range-sort with running counts; the counts add up to the
  rank among all suffixes.
* Neighbours in that order whose prefixes of one string's length are equal
  repeat.

Runs of different anchors cannot share a string.  So the sort is dealt out by
anchor: many small groups go to one task, which does these steps in memory; a
group too large for a task is range-sorted over all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm import repeats as R
from gleaner.llm.common import Stages, session

STRING_BYTES = 200
ANCHOR_BYTES = 64
GROUP_RUNS = 4096
BUCKET_RUNS = 1024


def _at(x: np.ndarray, p: np.ndarray, default: int) -> np.ndarray:
    """x[p], or default after the end."""
    inside = p < len(x)
    return np.where(inside, x[np.minimum(p, len(x) - 1)], default)


def _sampled(n: int) -> np.ndarray:
    p = np.arange(n)
    return p[p % 3 != 0]


_TRIPLE = pa.schema([("run", pa.int64()), ("p", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])
_TRIPLE_DDL = "run long, p int, c0 long, c1 long, c2 long"


def _first_triples(batches):
    """Triples of symbols at the sampled places of each run (run, symbols)."""
    for batch in batches:
        for run, raw in zip(batch["run"].to_pylist(), batch["symbols"].to_pylist()):
            s = np.frombuffer(raw, np.int64)
            p = _sampled(len(s))
            low = np.iinfo(np.int64).min
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(p), run)), pa.array(p.astype(np.int32)), pa.array(s[p]),
                pa.array(_at(s, p + 1, low)), pa.array(_at(s, p + 2, low))], schema=_TRIPLE)


def _names_array(n: int, places: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)  # 0: no name
    out[places] = names
    return out


def _alive(batch, r: int, length: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(names by place, windows that may still repeat) of one run after naming."""
    n = batch["size"][r].as_py()
    flat = batch["named"][r].values
    p, name = flat.field("p").to_numpy().astype(np.int64), flat.field("name").to_numpy()
    names = _names_array(n, p, np.abs(name))
    dead = np.zeros(n + 1, np.int64)
    left = np.arange(n) % 3 != 0  # sampled places that left earlier
    left[p] = False
    left = np.flatnonzero(left)
    np.add.at(dead, np.maximum(0, left - length + 1), 1)
    np.add.at(dead, left + 1, -1)
    span = depth + 2
    if span <= min(n, length):
        # Equal strings have a place among p, p + 1, p + 2 that is sampled in both:
        # where all sampled names of the three occur once, the string does too.
        lone = np.arange(n) % 3 == 0
        lone[p] = name < 0
        q = np.flatnonzero(lone[:n - span + 1] & lone[1:n - span + 2] & lone[2:n - span + 3])
        np.add.at(dead, np.maximum(0, q + span - length), 1)
        np.add.at(dead, q + 1, -1)
    alive = np.cumsum(dead[:-1]) == 0
    alive[max(0, n - length + 1):] = False
    return names, alive


def _next_triples(length: int, depth: int):
    """Triples of names, for the places that a window needs that may still repeat."""
    def body(batches):
        for batch in batches:
            for r, run in enumerate(batch["run"].to_pylist()):
                names, alive = _alive(batch, r, length, depth)
                if not alive.any():
                    continue
                p = _sampled(len(names))
                near = np.zeros(len(names) + 1, np.int64)
                w = np.flatnonzero(alive)
                np.add.at(near, w, 1)
                np.add.at(near, np.minimum(w + length, len(names)), -1)
                p = p[np.cumsum(near[:-1])[p] > 0]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(p), run)), pa.array(p.astype(np.int32)), pa.array(names[p]),
                    pa.array(_at(names, p + depth, 0)), pa.array(_at(names, p + 2 * depth, 0))], schema=_TRIPLE)

    return body


def _merge_rows(length: int, depth: int):
    """One row per window that may still repeat: its class, symbols and the ranks it is compared by."""
    schema = pa.schema([("run", pa.int64()), ("p", pa.int32()), ("cls", pa.int32()), ("s0", pa.int64()),
                        ("s1", pa.int64()), ("r0", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()),
                        ("h", pa.int64())])

    def body(batches):
        for batch in batches:
            for r, run in enumerate(batch["run"].to_pylist()):
                names, alive = _alive(batch, r, length, depth)
                p = np.flatnonzero(alive)
                if not len(p):
                    continue
                raw = batch["symbols"][r].as_py()
                s = np.frombuffer(raw, np.int64)
                sums = C.prefix_sums(s.view(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(p), run)), pa.array(p.astype(np.int32)),
                    pa.array((p % 3).astype(np.int32)), pa.array(s[p]), pa.array(_at(s, p + 1, 0)),
                    pa.array(names[p]), pa.array(_at(names, p + 1, 0)), pa.array(_at(names, p + 2, 0)),
                    pa.array(C.range_hash(sums, p, p + length).view(np.int64))], schema=schema)

    return body


def _name(triples: DataFrame, stages: Stages, turn: int) -> DataFrame:
    """(run, p, name): names are ranks of the sorted distinct triples, from 1; negative if the triple occurs once."""
    key = ["c0", "c1", "c2"]
    distinct = triples.groupBy(*key).agg(F.count("*").alias("c"), F.lit(1).alias("one"))
    ranked = C.running_totals(distinct, key, ["one"], stages, f"names{turn}")
    rank = F.col("one_before") + 1
    names = stages.put(f"ranked{turn}", ranked.select(*key, F.when(F.col("c") == 1, -rank).otherwise(rank).alias("name")))
    return triples.join(names, key).select("run", "p", "name")


def _neighbours(batches):
    """Rows in suffix order (rank, h, run, p): whether a neighbour in this partition starts with the same string."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    schema = pa.schema([("run", pa.int64()), ("p", pa.int32()), ("h", pa.int64()), ("same", pa.bool_()),
                        ("pid", pa.int32()), ("edge", pa.int32())])

    def out(rows, first):
        run, p, h, same, edge = rows
        if first and len(h):
            edge[0] |= 1
        return pa.RecordBatch.from_arrays([pa.array(run), pa.array(p), pa.array(h), pa.array(same),
                                           pa.array(np.full(len(h), pid, np.int32)), pa.array(edge)], schema=schema)

    held, first = None, True  # the last row of the batch before
    for batch in batches:
        run, p, h = (batch[c].to_numpy() for c in ("run", "p", "h"))
        if not len(h):
            continue
        same = np.zeros(len(h), bool)
        if held is not None:
            run, p, h = np.append(held[0], run), np.append(held[1], p), np.append(held[2], h)
            same = np.append(held[3], same)
        equal = h[1:] == h[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        held = (run[-1:], p[-1:], h[-1:], same[-1:])
        if len(h) > 1:
            yield out((run[:-1], p[:-1], h[:-1], same[:-1], np.zeros(len(h) - 1, np.int32)), first)
            first = False
    if held is not None:
        yield out((*held, np.full(1, 2, np.int32)), first)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of the rows of some columns of small non-negative numbers."""
    out = keys[0]
    for key in keys[1:]:
        out = np.unique(out * (int(key.max(initial=0)) + 1) + key, return_inverse=True)[1]
    return np.unique(out, return_inverse=True)[1] + 1


def _order(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row when sorted by the columns."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys[::-1])] = np.arange(len(out))
    return out


def repeated_places(symbols: np.ndarray, sizes: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """The same method for some runs in memory: which places start a string that starts elsewhere too.

    symbols: of all runs; sizes: symbols of each run; windows: strings of each run.
    """
    first = np.cumsum(sizes) - sizes
    pos = np.arange(len(symbols)) - np.repeat(first, sizes)
    left = np.repeat(sizes, sizes) - pos

    def ahead(x, d):
        return np.where(left > d, np.append(x[d:], np.zeros(min(d, len(x)), x.dtype)), 0)

    r = _ranks(np.unique(symbols, return_inverse=True)[1])
    cls = pos % 3
    sample = np.flatnonzero(cls != 0)
    names, source, depth = np.zeros(len(symbols), np.int64), r, 1
    while depth < length:  # names for 3, 9, 27 ... symbols
        names[sample] = _ranks(source[sample], ahead(source, depth)[sample], ahead(source, 2 * depth)[sample])
        source, depth = names, 3 * depth
    at = np.flatnonzero(pos < np.repeat(windows, sizes))
    c, total = cls[at], np.zeros(len(at), np.int64)
    r1, r2, s1 = ahead(names, 1)[at], ahead(names, 2)[at], ahead(r, 1)[at]
    keys = {(0, 1): (r[at], r1), (0, 2): (r[at], s1, r2), (1, 2): (names[at],)}
    for (a, b), key in keys.items():
        rows = np.flatnonzero((c == a) | (c == b))
        place = _order(*[k[rows] for k in key])
        by_class = {}
        for x in (a, b):
            own = c[rows] == x
            by_class[x] = np.empty(int(own.sum()), np.int64)
            by_class[x][np.argsort(place[own], kind="stable")] = np.arange(own.sum())
            # places of the own class are counted once: class 0 against class 2, the others against each other
            once = (x == 0 and b == 2) or (a, b) == (1, 2)
            total[rows[own]] += place[own] - (0 if once else by_class[x])
    sums = C.prefix_sums(symbols)
    h = C.range_hash(sums, at, at + length)
    order = np.lexsort((at, h, total))
    equal = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(at), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    return at[hit]


def _sort_group(length: int):
    """applyInArrow body: the runs of some whole anchor groups -> strings that repeat."""
    schema = pa.schema([("run", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def body(table: pa.Table) -> pa.Table:
        raw = table["symbols"].to_pylist()
        sizes = np.array([len(x) // 8 for x in raw], np.int64)
        symbols = np.frombuffer(b"".join(raw), np.uint64)
        place = repeated_places(symbols, sizes, table["n"].to_numpy().astype(np.int64), length)
        start = np.cumsum(sizes) - sizes
        of = np.searchsorted(start, place, "right") - 1
        p = (place - start[of]).astype(np.int32)
        return pa.table({"run": table["run"].to_numpy()[of], "first": p, "last": (p + 1).astype(np.int32)}, schema=schema)

    return body


def suffix_sort_repeats(group_runs: int = GROUP_RUNS, bucket_runs: int = BUCKET_RUNS):
    """The method as a ``resolve`` function of ``repeats.repeated_spans``.

    Strings of different anchors differ, so anchor groups are sorted apart:
    groups of up to ``group_runs`` runs are packed into buckets that one task
    sorts in memory, larger ones are sorted by range over all tasks.
    """
    def resolve(runs: DataFrame, length: int, stages: Stages) -> DataFrame:
        size = stages.put("groups", runs.groupBy("g").agg(F.count("*").alias("c")))
        small = size.where(f"c > 1 and c <= {group_runs}")
        buckets = max(1, -(-int(small.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("s")).first()["s"]) // bucket_runs))
        packed = runs.join(small.select("g"), "g").withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        found = packed.groupBy("bucket").applyInArrow(_sort_group(length), R.SPAN_SCHEMA)
        large = size.where(f"c > {group_runs}").select("g")
        if not large.limit(1).count():
            return found
        return found.union(sort_by_range(runs.join(large, "g", "left_semi"), length, stages))

    return resolve


def sort_by_range(runs: DataFrame, length: int, stages: Stages) -> DataFrame:
    """The method with distributed sorts, for runs of any number: see the module's text."""
    runs = stages.put("large", runs.select("run", "symbols", (F.length("symbols") / 8).cast("int").alias("size")))
    triples = stages.put("triples0", runs.mapInArrow(_first_triples, _TRIPLE_DDL))
    depth, turn = 3, 0
    while True:
        named = _name(triples, stages, turn)
        whole = stages.put(f"named{turn}", named.groupBy("run").agg(
            F.collect_list(F.struct("p", "name")).alias("named")).join(runs.select("run", "size"), "run"))
        if depth >= length:
            break
        stages.drop(f"triples{turn}")
        turn += 1
        triples = stages.put(f"triples{turn}", whole.mapInArrow(_next_triples(length, depth), _TRIPLE_DDL))
        depth *= 3
    rows = stages.put("suffixes", whole.join(runs.select("run", "symbols"), "run").mapInArrow(
        _merge_rows(length, depth),
        "run long, p int, cls int, s0 long, s1 long, r0 long, r1 long, r2 long, h long"))

    def counted(classes: list[int], key: list[str], name: str) -> DataFrame:
        part = rows.where(F.col("cls").isin(classes)).select(
            *key, "run", "p", "cls", "h", F.lit(1).alias("all"),
            *[(F.col("cls") == c).cast("int").alias(f"c{c}") for c in classes])
        return C.running_totals(part, [*key, "cls", "run", "p"], ["all", *[f"c{c}" for c in classes]], stages, name)

    def share(df: DataFrame, value) -> DataFrame:
        return df.select("run", "p", "h", value.alias("v"))

    a = counted([0, 1], ["s0", "r1"], "with1")
    b = counted([0, 2], ["s0", "s1", "r2"], "with2")
    c = counted([1, 2], ["r0"], "sample")
    own = lambda x, y: F.when(F.col("cls") == x, F.col(f"c{x}_before")).otherwise(F.col(f"c{y}_before"))
    ranked = (share(a, F.col("all_before") - own(0, 1))
              .union(share(b, F.when(F.col("cls") == 0, F.col("all_before"))
                           .otherwise(F.col("all_before") - F.col("c2_before"))))
              .union(share(c, F.col("all_before")))
              .groupBy("run", "p").agg(F.sum("v").alias("rank"), F.first("h").alias("h")))
    order = ["rank", "h", "run", "p"]
    near = stages.put("neighbours", ranked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _neighbours, "run long, p int, h long, same boolean, pid int, edge int"))
    # first and last row of each partition: compared with the neighbour partition's
    w = Window.partitionBy().orderBy("pid", F.col("edge") > 1)
    ends = near.where("edge > 0").withColumn("same2", (F.lag("h").over(w) == F.col("h")) | (F.lead("h").over(w) == F.col("h")))
    hit = near.where("same").select("run", "p").union(ends.where("same2").select("run", "p")).distinct()
    return hit.select("run", F.col("p").alias("first"), (F.col("p") + 1).alias("last"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = STRING_BYTES,
                 anchor: int = ANCHOR_BYTES, group_runs: int = GROUP_RUNS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts shorter than ``length`` bytes lose nothing;
    repeated rows count as copies (every copy loses the string); other
    columns are not read.  An empty table gives an empty table.
    """
    stages = Stages(session(docs), "suffixes")
    t = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = stages.put("narrow", docs.select(
        F.col(id_col).alias("doc_id"), *C.text_key(text), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(t, 256).alias("full_sha256")))
    cut = R.repeated_spans(docs, text_col, "bytes", length, min(anchor, length), stages, suffix_sort_repeats(group_runs))
    return R.per_text(narrow, cut, stages, "n_bytes", length).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
