"""Quality classifier: hashed word n-grams, logistic regression, FTRL.

Words (and their shapes: letter case, digits and punctuation runs) are hashed
as 1- and 2-grams into ``2 ** bits`` buckets.  Weights are learnt with
follow-the-regularised-leader (proximal, per-coordinate rates, L1 and L2) on a
bounded sample of labelled documents: the ``max_train`` of smallest hash, whole
texts, dealt to ``shards`` learners (more where a learner would get over
``SHARD_BYTES`` of text) whose weights are averaged.  Scoring goes over every
whole text: a sparse dot product of its n-gram shares and the weights.  Long
texts are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.common import Stages, session
from gleaner.llm.quality_rules import labelled_good

BITS = 18
MAX_TRAIN = 16_384
SHARDS = 4
#: Text of one learner: its examples take about eight times as much memory.
SHARD_BYTES = 32 << 20
PASSES = 4
THRESHOLD = 0.3


def _shape_bytes(b: np.ndarray) -> np.ndarray:
    """Bytes with letters folded: lower case to a, upper case to A, digits to 0, UTF-8 beyond ASCII to a."""
    out = b.copy()
    out[(b >= 97) & (b <= 122) | (b >= 128)] = 97
    out[(b >= 65) & (b <= 90)] = 65
    out[(b >= 48) & (b <= 57)] = 48
    return out


def _shape_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape, runs of one symbol counted once."""
    out = np.zeros(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + C.PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        shape = _shape_bytes(buf[lo:hi])
        fresh = np.ones(len(shape), bool)
        fresh[1:] = shape[1:] != shape[:-1]
        fresh[starts[i:j] - lo] = True
        place = np.append(0, np.cumsum(fresh))
        sums = C.prefix_sums(C.byte_symbols(shape[fresh]))
        out[i:j] = C.range_hash(sums, place[starts[i:j] - lo], place[ends[i:j] - lo])
        i = j
    return out


def _pieces(buf: np.ndarray, lo: int, hi: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that cover buf[lo:hi] and cut no word."""
    while lo < hi:
        end = min(hi, lo + limit)
        while end < hi:
            gap = np.flatnonzero(C.is_gap(buf[end:min(hi, end + limit)]))
            if len(gap):
                end += int(gap[0])
                break
            end = min(hi, end + limit)
        yield lo, end
        lo = end


def features(column, bits: int, limit: int = C.PIECE * 4) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, words, n-gram buckets) for the texts of a batch in order; a text of over ``limit`` bytes comes in several pieces."""
    buf, offsets = C.text_buffer(column)
    mask = np.uint64((1 << bits) - 1)
    pair = lambda x: C.mix(x[:-1] * np.uint64(3) + C.mix(x[1:]))
    for i, j in C.runs_of_texts(offsets, limit):
        last = np.empty(0, np.uint64), np.empty(0, np.uint64)  # word before the piece, and its shape
        spans = [(int(offsets[i]), int(offsets[j]))]
        if spans[0][1] - spans[0][0] > limit:  # one long text
            spans = _pieces(buf, *spans[0], limit)
        for a, b in spans:
            starts, ends = C.word_spans(buf, a, b, offsets[i:j])
            words, shapes = (np.concatenate([x, y]) for x, y in zip(last, (C.word_hash(buf, starts, ends), _shape_hash(buf, starts, ends))))
            old = len(last[0])
            grams = [C.mix(words[old:] ^ np.uint64(11)), C.mix(shapes[old:] ^ np.uint64(13)),
                     C.mix(pair(words) ^ np.uint64(17)), C.mix(pair(shapes) ^ np.uint64(19))]
            first = np.searchsorted(starts, offsets[i:j + 1]) if j - i > 1 else np.array([0, len(starts)])
            for t, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), i):
                ids = np.concatenate([grams[0][lo:hi], grams[1][lo:hi], grams[2][lo:max(lo, hi - 1 + old)], grams[3][lo:max(lo, hi - 1 + old)]])
                yield t, hi - lo, (ids & mask).astype(np.int64)
            last = words[-1:], shapes[-1:]


def examples(column, bits: int, limit: int = C.PIECE * 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text of a batch: (distinct buckets, share of each), at most ``2 ** bits`` long."""
    for _, parts in groupby(features(column, bits, limit), key=lambda part: part[0]):
        at, count, n = np.empty(0, np.int64), np.empty(0), 0
        for _, words, ids in parts:
            new, times = np.unique(ids, return_counts=True)
            if n:
                at, place = np.unique(np.concatenate([at, new]), return_inverse=True)
                count = np.bincount(place, np.concatenate([count, times]), len(at))
            else:
                at, count = new, times.astype(float)
            n += words
        yield at.astype(np.int32), (count / max(1, n)).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """FTRL-proximal logistic regression (bias in the last coordinate)."""

    def __init__(self, bits: int, rate: float = 0.5, l1: float = 1e-4, l2: float = 1e-3, beta: float = 1.0):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)
        self.rate, self.l1, self.l2, self.beta = rate, l1, l2, beta

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.rate + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.rate
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _train(bits: int, passes: int):
    """applyInArrow body: one shard of labelled texts -> its weights."""
    def body(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("order", "k1", "k2")])
        rows = list(zip(examples(table["text"], bits), table["good"].to_pylist()))
        model = Ftrl(bits)
        for _ in range(passes):
            for (at, x), good in rows:
                model.learn(np.append(at.astype(np.int64), 1 << bits), np.append(x.astype(float), 1.0), float(good))
        return pa.table({"shard": table["shard"].slice(0, 1), "n": pa.array([len(rows)]),
                         "w": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})

    return body


def train(labelled: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN, shards: int = SHARDS, passes: int = PASSES,
          shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Weights (2 ** bits and the bias) from the whole texts of labelled(id, text, good).

    Every shard holds at most ``shard_bytes`` of text and one text more.  Its
    weight vector reaches the driver alone.  Without labelled rows all
    weights are 0 and every score is 0.5.
    """
    stages = Stages(session(labelled), "train")
    order = F.xxhash64(F.lit(77), F.col("id").cast("string"))
    rows = labelled.select(order.alias("order"), *C.text_key(F.col("text")), "text", "good", F.lit(1).cast("long").alias("one"),
                           F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    placed = stages.put("placed", C.running_totals(rows, ["order", "k1", "k2"], ["one", "bytes"], stages, "sorted")
                        .where(F.col("one_before") < max_train))
    stages.drop("sorted")
    size = placed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("s")).first()["s"]
    parts = max(shards, -(-size // shard_bytes))
    shard = F.least(F.lit(parts - 1), F.expr(f"cast(bytes_before * {parts} div {max(1, size)} as int)"))
    sample = placed.select("order", "k1", "k2", "text", "good", shard.alias("shard"))
    models = stages.put("models", sample.groupBy("shard").applyInArrow(_train(bits, passes), "shard int, n long, w binary"))
    total = np.zeros((1 << bits) + 1)
    n = 0
    for m in models.orderBy("shard").toLocalIterator():
        total += m["n"] * np.frombuffer(m["w"], "<f4")
        n += m["n"]
    return (total / max(1, n)).astype(np.float32)


def _score(weights: np.ndarray, bits: int):
    """mapInArrow body: (id, held_out, text) -> score."""
    def body(batches):
        for batch in batches:
            dots, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for text, n, ids in features(batch["text"], bits):
                dots[text] += weights[ids].sum(dtype=np.float64)
                words[text] += n
            dots = dots / np.maximum(words, 1) + float(weights[-1])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(sigmoid(dots))],
                                             names=["doc_id", "held_out", "score"])

    return body


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  bits: int = BITS, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= threshold).

    Labels of ids whose crc32 modulo 5 is 0 are never read into training,
    nor are null, contradicting or id-less labels.  A null or empty text
    scores the bias.  Repeated rows score alike; other columns are not read.
    """
    stages = Stages(session(docs), "classifier")
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # choose by the narrow label table alone, so that no text is sorted to be dropped
    good = labelled_good(labels, label=label_col).where(~held_out(F.col("label_id")))
    chosen = stages.put("chosen", good.withColumn("o", F.xxhash64(F.lit(77), F.col("label_id").cast("string")))
                        .orderBy("o", "label_id").limit(max_train).drop("o"))
    known = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # max_train rows at most
    chosen = stages.put("labelled", known.select(F.col("doc_id").alias("id"), "text", "good"))
    weights = train(chosen, bits, max_train)
    scored = rows.mapInArrow(_score(weights, bits), f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
