"""Shared pieces of the training-data operators.

* ``Stages``: tables written once as Parquet in the shared checkpoint folder,
  which cuts lineage and survives lost executors.
* ``with_text_key``: 128-bit key of a whole text, so that exact copies
  collapse without row ids (null, duplicate and missing ids do no harm).
* ``keep_keys`` / ``texts_of``: rows whose key is in a set; the set is
  broadcast only after its size was checked, else both sides are shuffled.
* vectorised word spans and rolling hashes over Arrow text buffers, cut into
  pieces so that memory does not grow with one long text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir

#: ASCII white space; everything else belongs to words.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A set of keys is broadcast up to this many rows (16 bytes each).
BROADCAST_ROWS = 500_000
PIECE = 1 << 17


class Stages:
    """Parquet tables of one operator call, under the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/gleaner-llm/{name}-{uuid.uuid4().hex}"
        for roots in _watchers:
            roots.append(self)

    def put(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{key}")
        return self.get(key)

    def get(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{key}")

    def drop(self, key: str) -> None:
        """Remove a table that no later step reads."""
        self._delete(f"{self.root}/{key}")

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_watchers: list[list[Stages]] = []


@contextmanager
def scratch():
    """The ``Stages`` that operators open inside the block; all are removed at its end."""
    opened: list[Stages] = []
    _watchers.append(opened)
    try:
        yield opened
    finally:
        _watchers.remove(opened)
        for stages in opened:
            stages.drop_all()


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(0x51ED27), t).alias("k2")]


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in the stored table ``keys``."""
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def texts_of(docs: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """(k1, k2, text): each distinct text whose key is in ``keys``, once."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(t.alias("text")).select(*text_key(F.col("text")), "text")
    return keep_keys(keyed, keys, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))


# ------------------------------------------------------------- prefix sums
def _running(values: list[str], group: str | None):
    """mapInArrow body over sorted rows: sums of the earlier rows of the same group in this partition."""
    def body(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carry = None, np.zeros(len(values), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            head = np.zeros(n, bool)
            if group is not None:
                g = batch[group]
                head[0] = last is None or g[0].as_py() != last
                head[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                last = g[n - 1].as_py()
            run = np.cumsum(head)  # 0: goes on from the batch before
            at = np.flatnonzero(head)
            new = []
            for c, v in enumerate(values):
                x = batch[v].to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(x) - x
                base = np.concatenate([[-carry[c]], before[at]])
                before = before - base[run]
                new.append(pa.array(before))
                carry[c] = before[-1] + x[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int32)), *new],
                                             names=[*batch.schema.names, "pid", *[f"{v}_before" for v in values]])

    return body


def running_totals(df: DataFrame, order: list[str], values: list[str], stages: Stages, name: str,
                   group: str | None = None) -> DataFrame:
    """Add ``<v>_before``: the sum of integer column v over all earlier rows (of the same group).

    Rows are range-sorted by (group, order), so a large group spans many
    partitions; each partition sums what it holds, and the totals of the
    partitions before it (one row per partition and group) are joined on.
    ``group`` must not hold nulls.
    """
    keys = [*([group] if group else []), *order]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", pid int, " + ", ".join(f"{v}_before long" for v in values)
    local = stages.put(name, df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .mapInArrow(_running(values, group), schema))
    by = ["pid", *([group] if group else [])]
    sums = local.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = stages.put(f"{name}-offsets", sums.select(
        *by, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}_offset") for v in values]))
    joined = local.join(offsets, by)
    return joined.select(*df.columns, *[(F.col(f"{v}_before") + F.col(f"{v}_offset")).alias(f"{v}_before") for v in values])


# ------------------------------------------------------------- text buffers
def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def is_gap(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def word_spans(buf: np.ndarray, lo: int, hi: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (absolute) of each word of buf[lo:hi]; no word crosses ``cuts`` (text starts)."""
    if hi <= lo:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~is_gap(buf[lo:hi])
    fresh = np.empty(hi - lo, bool)
    fresh[0] = True
    fresh[1:] = ~word[:-1]
    inner = cuts[(cuts >= lo) & (cuts < hi)] - lo
    fresh[inner] = True
    starts = np.flatnonzero(word & fresh)
    last = np.empty(hi - lo, bool)
    last[-1] = True
    last[:-1] = ~word[1:]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(word & last) + 1
    return starts + lo, ends + lo


# ------------------------------------------------------------ rolling hashes
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE * 2)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _tables[key] = np.cumprod(x)
    return _tables["up"], _tables["down"]


def byte_symbols(b: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte."""
    if "bytes" not in _tables:
        _tables["bytes"] = np.random.default_rng(20_071).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return _tables["bytes"][b]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S33)


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:len(symbols)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[starts:ends] for many ranges."""
    _, down = powers(len(sums) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k symbols in a row."""
    n = len(sums) - 1 - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = powers(len(sums) + 1)
    return mix((sums[k:] - sums[:-k]) * down[:n])


#: Words of more bytes get a non-linear hash of their own: long texts over two letters can share a polynomial hash.
LONG_WORD = 64


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each word; ``fold`` lower-cases A-Z first.  Works piece by piece."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        b = buf[lo:hi]
        if fold:
            b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        out[i:j] = range_hash(prefix_sums(byte_symbols(b)), starts[i:j] - lo, ends[i:j] - lo)
        for w in (np.flatnonzero(ends[i:j] - starts[i:j] > LONG_WORD) + i).tolist():
            out[w] = xxhash.xxh3_64_intdigest(b[starts[w] - lo:ends[w] - lo].tobytes())
        i = j
    return out


def runs_of_texts(offsets: np.ndarray, limit: int = PIECE * 4) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` bytes together (a longer text is alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batch_words(column, fold: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: (first, end, word count of each, word hashes of all)."""
    buf, offsets = text_buffer(column)
    for i, j in runs_of_texts(offsets):
        starts, ends = word_spans(buf, int(offsets[i]), int(offsets[j]), offsets[i:j])
        counts = np.diff(np.searchsorted(starts, offsets[i:j + 1]))
        yield i, j, counts, word_hash(buf, starts, ends, fold)
