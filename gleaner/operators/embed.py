"""Embeddings and dimension reduction.

* ``hash_embed`` - the offline default encoder: signed feature hashing.  A
  word goes to bucket ``int(md5(word)[0:8], 16) % dim`` with sign ``+1`` when
  ``int(md5(word)[8:16], 16)`` is even, else ``-1``; a unit's vector is the
  sum over its words.  Words are found by a column expression and summed
  batch by batch in ``mapInArrow``, no shuffle.
* ``embed_units`` - the plug-in path: any encoder (a factory returning a
  ``texts -> matrix`` callable) runs in ``mapInArrow``; the model is built
  once per Python worker and fed Arrow batches of ``batch_size`` rows.
* ``random_projection`` - seeded +-1/sqrt(k) projection; the sign matrix
  (d x k values, a parameter-sized table) is built by Spark and broadcast.
* ``pca_reduce`` - MLlib PCA per model, sign fixed so each component's
  largest-magnitude loading is positive.
* ``reduce_dims`` / ``manifest`` - every model to every k <= d plus ``orig``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from gleaner.functions.text import vectorizer_tokens
from gleaner.functions.vectors import normalize_vec

REDUCED_DIMS = (2, 3, 5, 10, 20, 50, 200)
# The sign matrix of a projection is broadcast only up to this many values.
MAX_PROJECTION_VALUES = 50_000_000


def _hex_int(h: F.Column, start: int) -> F.Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long")


def _word_hashes(words: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of each word."""
    h = np.frombuffer(b"".join(hashlib.md5(w).digest()[:8] for w in words), ">u4").reshape(-1, 2)
    return (h[:, 0] % dim).astype(np.int64), np.where(h[:, 1] % 2 == 0, 1.0, -1.0)


def _hashed(tokens: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, sign) of each word of a batch; a word is hashed once a batch."""
    row = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    words = pc.list_flatten(tokens).dictionary_encode()
    bucket, sign = _word_hashes(words.dictionary.cast(pa.binary()).to_pylist(), dim)
    at = words.indices.to_numpy(zero_copy_only=False)
    return row, bucket[at], sign[at]


def hash_embed(units: DataFrame, dim: int = 64, text_col: str = "unit", out: str = "vec",
               normalize: bool = False, tokens=vectorizer_tokens) -> DataFrame:
    """Add ``vec ARRAY<DOUBLE>`` of length ``dim`` by signed feature hashing (of nulls where there is no text)."""
    rest = [c for c in units.columns if c != out]
    words = units.select(*[F.col(f"`{c}`") for c in rest], tokens(text_col).alias("_words"))
    schema = Ty.StructType([f for f in units.schema.fields if f.name != out] + [Ty.StructField(out, Ty.ArrayType(Ty.DoubleType()))])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            row, bucket, sign = _hashed(batch["_words"], dim)
            flat = np.bincount(row * dim + bucket, weights=sign, minlength=n * dim) if len(row) else np.zeros(n * dim)
            none = np.repeat(pc.is_null(batch["_words"]).to_numpy(zero_copy_only=False), dim)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(flat, mask=none))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), vec], names=[*rest, out])

    res = words.mapInArrow(run, schema)
    if normalize:
        res = res.withColumn(out, normalize_vec(out))
    return res.select(*[F.col(f"`{c}`") for c in units.columns], *([] if out in units.columns else [out]))


def _new_keys(keys: pa.RecordBatch) -> np.ndarray:
    """Whether each row's key differs from that of the row before (nulls are equal)."""
    new = np.zeros(keys.num_rows, bool)
    new[:1] = True
    for column in keys.columns:
        a, b = column[1:], column[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        none = pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        new[1:] |= differ | none
    return new


def hash_embed_sparse(units: DataFrame, dim: int = 64, key_cols: Sequence[str] = ("review_id", "unit_pos"),
                      text_col: str = "unit", tokens=vectorizer_tokens) -> DataFrame:
    """The same signed feature hashing as sparse rows ``(key..., bucket, value)``
    (non-zero buckets only).  Units are dealt and sorted by key; a task sums
    the words of one key after the other, so it holds a batch and one vector.
    O(words) instead of O(words x dim)."""
    keys = list(key_cols)
    words = units.select(*keys, tokens(text_col).alias("_words")).filter(F.size("_words") > 0)
    fields = {f.name: f for f in words.schema.fields}
    schema = Ty.StructType([fields[k] for k in keys] + [Ty.StructField("bucket", Ty.IntegerType()), Ty.StructField("value", Ty.DoubleType())])

    def run(batches):
        def rows(keys_at, bucket, value):
            kept = np.flatnonzero(value)
            return pa.RecordBatch.from_arrays([*keys_at.take(pa.array(kept)).columns, pa.array(bucket[kept].astype(np.int32)), pa.array(value[kept])],
                                              names=[*keys, "bucket", "value"])

        last = None  # key, buckets and sums of the last key so far: the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.select(keys)
            row, bucket, value = _hashed(batch["_words"], dim)
            if last is not None:
                held = pa.concat_batches([last[0], held])
                row, bucket, value = (np.concatenate(v) for v in ((np.zeros(len(last[1]), np.int64), row + 1), (last[1], bucket), (last[2], value)))
            new = _new_keys(held)
            first = np.flatnonzero(new)
            code, at = np.unique((np.cumsum(new) - 1)[row] * dim + bucket, return_inverse=True)
            total, group, bucket = np.bincount(at, weights=value, minlength=len(code)), code // dim, code % dim
            done = group < len(first) - 1
            yield rows(held.take(pa.array(first[group[done]])), bucket[done], total[done])
            last = held.slice(int(first[-1]), 1), bucket[~done], total[~done]
        if last is not None:
            yield rows(last[0].take(pa.array(np.zeros(len(last[1]), np.int64))), last[1], last[2])

    return words.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


# ------------------------------------------------------------- plug-in path
#: Words whose hashes an encoder keeps before it starts anew.
KNOWN_WORDS = 1 << 18


def hashing_encoder_factory(dim: int = 64) -> Callable[[], Callable]:
    """Encoder factory equal to ``hash_embed`` (used to test the plug-in path)."""
    def factory():
        import re

        # \w{2,} on lower-cased text: letters, digits (any script) and "_"
        tok = re.compile(r"\w{2,}", re.UNICODE)
        known: dict[str, int] = {}  # word -> 2 * bucket, and 1 more for -1

        def encode(texts):
            if len(known) > KNOWN_WORDS:
                known.clear()
            words = [tok.findall(t.lower()) if t is not None else () for t in texts]
            fresh = list({w for ws in words for w in ws if w not in known})
            bucket, sign = _word_hashes([w.encode("utf-8") for w in fresh], dim)
            known.update(zip(fresh, (2 * bucket + (sign < 0)).tolist()))
            code = np.array([known[w] for ws in words for w in ws], np.int64)
            row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
            return np.bincount(row * dim + code // 2, weights=1.0 - 2.0 * (code % 2), minlength=len(texts) * dim).reshape(len(texts), dim)
        return encode
    return factory


_ENCODERS: dict = {}  # of this Python worker, by what the factory is, not by what it is called


def _encoder(key: str, factory: Callable[[], Callable]) -> Callable:
    if key not in _ENCODERS:
        _ENCODERS[key] = factory()
    return _ENCODERS[key]


def _factory_key(factory: Callable[[], Callable]) -> str:
    """Digest of a factory with the parameters it holds."""
    import hashlib

    from pyspark import cloudpickle
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


#: Parts that the units of a model are dealt to, for each default partition of the session.
PARTS_PER_CORE = 2


def embed_models(units: DataFrame, models: Mapping[str, Callable[[], Callable]], key_cols: Sequence[str] = ("review_id", "unit_pos"),
                 text_col: str = "unit", batch_size: int = 64, normalise: bool | Mapping[str, bool] = False) -> DataFrame:
    """``(key..., model, vec ARRAY<DOUBLE>)``: every unit encoded by every model.

    ``models`` gives an encoder factory for each name.  The names are joined to
    the units as a table and the rows dealt by model, so a task loads one
    encoder or few; encoders are kept by factory and parameters, so two calls
    that use one name for different models do not share an encoder.
    ``normalise`` (for all, or by name) scales vectors to unit length; a zero
    vector stays as it is.
    """
    keys = list(key_cols)
    spark = units.sparkSession
    wanted = {name: (normalise if isinstance(normalise, bool) else bool(normalise.get(name, False))) for name in models}
    plan = {name: (_factory_key(f), f, wanted[name]) for name, f in models.items()}
    names = spark.createDataFrame([(n,) for n in sorted(models)], "model string")
    parts = max(1, spark.sparkContext.defaultParallelism * PARTS_PER_CORE)
    salt = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    rows = units.select(*keys, text_col).crossJoin(F.broadcast(names))  # one row a model
    if len(models) > 1:
        rows = rows.withColumn("_salt", salt).repartition(parts * len(models), "model", "_salt").drop("_salt")
    fields = [f for f in units.schema.fields if f.name in keys]
    schema = Ty.StructType(fields + [Ty.StructField("model", Ty.StringType()),
                                     Ty.StructField("vec", Ty.ArrayType(Ty.DoubleType()))])

    def run(batches):
        for batch in batches:
            model = batch["model"]
            for name in model.unique().to_pylist():
                key, factory, unit_length = plan[name]
                encode = _encoder(key, factory)
                part = batch.filter(pc.equal(model, name))
                texts = part[text_col].to_pylist()
                # the encoder sees at most batch_size texts per call
                vecs = np.concatenate([np.asarray(encode(texts[i:i + batch_size]), np.float64) for i in range(0, len(texts), batch_size)])
                if unit_length:
                    norm = np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))
                    vecs = vecs / np.where(norm > 0, norm, 1.0)
                ends = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1])
                yield pa.RecordBatch.from_arrays([*(part[f.name] for f in fields), part["model"], pa.ListArray.from_arrays(ends, pa.array(vecs.ravel()))],
                                                 names=schema.names)

    return rows.select(*keys, "model", text_col).mapInArrow(run, schema)


def embed_units(units: DataFrame, encoder_factory: Callable[[], Callable], model_name: str,
                key_cols: Sequence[str] = ("review_id", "unit_pos"), text_col: str = "unit",
                batch_size: int = 64, normalise: bool = False) -> DataFrame:
    """``embed_models`` with one model."""
    return embed_models(units, {model_name: encoder_factory}, key_cols, text_col, batch_size, normalise)


# ------------------------------------------------------- dimension reduction
def _sign_matrix(spark, d: int, k: int, seed: int) -> DataFrame:
    """One row ``signs ARRAY<DOUBLE>`` of length d*k (row-major, +-1/sqrt(k))."""
    if d * k > MAX_PROJECTION_VALUES:
        raise ValueError(f"projection matrix {d}x{k} exceeds the broadcast bound")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    s = F.when(F.pmod(_hex_int(h, 1), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) / F.lit(math.sqrt(k))
    return (spark.range(d * k).select("id", s.alias("s"))
                 .agg(F.array_sort(F.collect_list(F.struct("id", "s"))).alias("_p"))
                 .select(F.transform("_p", lambda x: x["s"]).alias("signs")))


def random_projection(vectors: DataFrame, k: int, seed: int = 42, vec: str = "vec", out: str = "vec_k",
                      d: int | None = None) -> DataFrame:
    """Seeded random projection to k dimensions: ``out_j = sum_i x_i R_ij``."""
    if d is None:
        d = vectors.select(F.max(F.size(vec))).first()[0]
    if k > d:
        raise ValueError(f"k={k} exceeds input dimension {d}")
    signs = _sign_matrix(vectors.sparkSession, d, k, seed)
    proj = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.aggregate(
        F.sequence(F.lit(0), F.lit(d - 1)), F.lit(0.0),
        lambda acc, i: acc + F.col(vec)[i].cast("double") * F.col("signs")[i * k + j]))
    return vectors.crossJoin(F.broadcast(signs)).withColumn(out, proj).drop("signs")


def pca_reduce(vectors: DataFrame, k: int, vec: str = "vec", out: str = "vec_k") -> DataFrame:
    """MLlib PCA to k components; each component's sign makes its
    largest-magnitude loading positive (deterministic output)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    pc = model.pc.toArray()  # d x k loadings: bounded by the parameters
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array(F.col("_p"))
    flipped = F.transform(arr, lambda x, j: x * F.array(*[F.lit(s) for s in signs])[j])
    return model.transform(v).withColumn(out, flipped).drop("_v", "_p")


def reduce_dims(vectors: DataFrame, dims: Sequence[int] = REDUCED_DIMS, method: str = "random",
                seed: int = 42, vec: str = "vec", key_cols: Sequence[str] = ("vec_id",),
                model_col: str | None = None) -> DataFrame:
    """``(key..., dim_label, n_components, vec)`` for every k plus ``orig``; a k above d raises."""
    keys = list(key_cols) + ([model_col] if model_col else [])
    d = vectors.select(F.max(F.size(vec))).first()[0]
    parts = [vectors.select(*keys, F.lit("orig").alias("dim_label"), F.lit(d).alias("n_components"),
                            F.transform(vec, lambda x: x.cast("double")).alias("vec"))]
    for k in dims:
        if k > d:
            raise ValueError(f"{k} dimensions asked of vectors that have {d}")
        r = random_projection(vectors, k, seed, vec, "_r", d) if method == "random" \
            else pca_reduce(vectors, k, vec, "_r")
        parts.append(r.select(*keys, F.lit(f"{k}d").alias("dim_label"), F.lit(k).alias("n_components"),
                              F.col("_r").alias("vec")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def manifest(reduced: DataFrame, model_col: str | None = None) -> DataFrame:
    """One row per (model, dim_label) output, with its width."""
    keys = ([model_col] if model_col else []) + ["dim_label"]
    return reduced.groupBy(*keys).agg(F.max("n_components").alias("n_components"),
                                      F.count(F.lit(1)).alias("rows"))
