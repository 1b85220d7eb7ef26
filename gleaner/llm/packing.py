"""Packing token sequences by minimum bin slack.

Documents are tokenised once; full windows of ``capacity`` tokens fill a
sequence each, and what remains of a document has fewer tokens.  How many
remainders there are of each length (at most ``capacity - 1`` numbers) is all
that the planner needs: for each new sequence it takes the longest length
left, runs a subset-sum dynamic program over the remaining lengths, whose
reachable sums are the bits of one integer, and backtracks the counts of the
multiset that comes closest to the capacity.  The same multiset serves as
many sequences as its lengths allow.  Where the best multiset would leave
more than ``max_slack`` tokens free, one remainder is cut to fill them and
its tail goes back among the remaining lengths.

Remainders then find their place by their rank within their length, which is
a distributed prefix count; a very common length costs no task more.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.common import Stages, session

CAPACITY = 1024
MAX_SLACK = 4


# -------------------------------------------------------------------- planner
def best_multiset(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, how many) with the largest sum up to ``room``, by bitset subset sums.

    ``counts`` bounds how often a length may be used.  The program adds
    lengths from long to short, in powers of two of their count, keeps the
    reachable sums before each step, and stops once ``room`` is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, batch = min(counts[length], room // length), 1
        while left:
            take = min(batch, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            batch *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return list(chosen.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_slack: int = MAX_SLACK) -> tuple[dict[int, list], int]:
    """Where the remainders of each length go.

    Gives, for each length, steps (first rank, end rank, kind, ...) in rank
    order, and the number of sequences.  A step ``place`` holds (first
    sequence, offset, pieces a sequence); a step ``cut`` holds (head length,
    first sequence, offset, rank of the first tail among its length).
    """
    left = {length: n for length, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)   # ranks given out
    ever = dict(left)               # ranks in existence
    steps: dict[int, list] = {}
    sequence = 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        need = {longest: 1}
        for length, n in best_multiset(capacity - longest, rest):
            need[length] = need.get(length, 0) + n
        times = min(left[length] // n for length, n in need.items())
        fill = sum(length * n for length, n in need.items())
        slack = capacity - fill
        cut = None
        if slack > max_slack and fill & (fill - 1):
            over = {length: n - need.get(length, 0) for length, n in left.items()}
            spare = [length for length, n in over.items() if n > 0 and length > slack]
            if spare:
                cut = max(spare, key=lambda x: (over[x], x))
                times = min(times, left[cut] // (need.get(cut, 0) + 1))
        offset = 0
        for length, n in sorted(need.items(), reverse=True):
            a = used[length]
            steps.setdefault(length, []).append((a, a + n * times, "place", sequence, offset, n))
            used[length] = a + n * times
            left[length] -= n * times
            offset += n * length
        if cut is not None:
            tail = cut - slack
            a = used[cut]
            steps.setdefault(cut, []).append((a, a + times, "cut", slack, sequence, offset, ever.get(tail, 0)))
            used[cut] = a + times
            left[cut] -= times
            ever[tail] = ever.get(tail, 0) + times
            left[tail] = left.get(tail, 0) + times
            used.setdefault(tail, 0)
        left = {length: n for length, n in left.items() if n}
        sequence += times
    return steps, sequence


def places(length: int, rank: int, steps: dict[int, list], starts: dict[int, list]) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of one remainder."""
    out, start = [], 0
    while True:
        step = steps[length][bisect_right(starts[length], rank) - 1]
        k = rank - step[0]
        if step[2] == "place":
            _, _, _, first, offset, n = step
            out.append((start, length, first + k // n, offset + (k % n) * length))
            return out
        _, _, _, head, first, offset, tail_rank = step
        out.append((start, head, first + k, offset))
        start, length, rank = start + head, length - head, tail_rank + k


# ---------------------------------------------------------------- Spark side
_IDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def _tokenise(path: str, pattern: str, end_id: int, capacity: int, id_type: pa.DataType):
    """mapInArrow body: (doc_id, text) -> full windows and remainders (those with their ids)."""
    def body(batches):
        from gleaner.llm.bpe import TextEncoder

        encoder = TextEncoder(path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for big in batches:
            _, offsets = C.text_buffer(big["text"])
            for i, j in C.runs_of_texts(offsets, 1 << 21):
                batch = big.slice(i, j - i)
                doc_id = batch["doc_id"].to_pylist()
                rows = {c: [] for c in (*_IDS, "ids")}
                for d, ids in zip(doc_id, encoder.encode([x or "" for x in batch["text"].to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start:4 * (start + capacity)]
                        rest = len(piece) < 4 * capacity
                        for c, v in zip((*_IDS, "ids"), (d, start, len(piece) // 4, zlib.crc32(piece), n, piece if rest else None)):
                            rows[c].append(v)
                types = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    return body


def _place(steps: dict[int, list], id_type: pa.DataType):
    """mapInArrow body: remainders with their rank -> placed pieces."""
    def body(batches):
        starts = {length: [s[0] for s in found] for length, found in steps.items()}
        for batch in batches:
            rows = {c: [] for c in (*_IDS, "sequence_id", "offset")}
            cols = [batch[c].to_pylist() for c in (*_IDS, "rank", "ids")]
            for d, start, length, crc, n, rank, ids in zip(*cols):
                found = places(length, rank, steps, starts)
                for at, size, sequence, offset in found:
                    value = crc if len(found) == 1 else zlib.crc32(ids[4 * at:4 * (at + size)])
                    for c, v in zip(rows, (d, start + at, size, value, n, sequence, offset)):
                        rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, id_type if c == "doc_id" else pa.int64())
                                              for c, v in rows.items()], names=list(rows))

    return body


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, max_slack: int = MAX_SLACK, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids (a null or empty text has just ``end_id``) lie in
    exactly one piece; pieces fill sequences of at most ``capacity`` ids from
    offset 0 without gaps.  Repeated rows are packed as often as they occur.
    Other columns are not read; an empty table gives an empty table.
    """
    import public_tokenizers
    from pyspark.sql.pandas.types import to_arrow_type

    spark = session(docs)
    stages = Stages(spark, "packing")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType
    arrow, ddl = to_arrow_type(id_type), id_type.simpleString()
    pieces = stages.put("pieces", docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _tokenise(path, public_tokenizers.PATTERN, end_id, capacity, arrow),
        f"doc_id {ddl}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"))
    rest = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["c"] for r in rest.groupBy("length").agg(F.count("*").alias("c")).collect()}  # < capacity rows
    steps, n_sequences = plan(counts, capacity, max_slack)
    ranked = C.running_totals(rest.withColumn("one", F.lit(1)), ["doc_id", "start", "ids_crc32"], ["one"], stages,
                              "ranked", group="length")
    placed = ranked.withColumnRenamed("one_before", "rank").mapInArrow(
        _place(steps, arrow), f"doc_id {ddl}, start long, length long, ids_crc32 long, doc_tokens long, "
                              "sequence_id long, offset long")
    full = C.running_totals(pieces.where(F.col("length") == capacity).drop("ids").withColumn("one", F.lit(1)),
                            ["doc_id", "start", "ids_crc32"], ["one"], stages, "full")
    full = full.select(*_IDS, (F.col("one_before") + n_sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(full.select(*placed.columns))
