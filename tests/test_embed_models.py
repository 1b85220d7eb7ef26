"""Several encoders, equal names, normalised vectors."""

import math

import pytest

from gleaner.operators import embed


def _units(spark):
    texts = ["alpha beta beta", "gamma", "", None, "alpha", "delta alpha gamma beta"]
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "review_id long, unit_pos int, unit string").repartition(3)


def _vec(df):
    return {(r.review_id, r.model): list(r.vec) for r in df.collect()}


def test_models_of_one_name_and_other_parameters_differ(spark):
    units = _units(spark)
    small = _vec(embed.embed_units(units, embed.hashing_encoder_factory(8), "m"))
    large = _vec(embed.embed_units(units, embed.hashing_encoder_factory(16), "m"))
    assert {len(v) for v in small.values()} == {8} and {len(v) for v in large.values()} == {16}


def test_every_unit_by_every_model(spark):
    units = _units(spark)
    models = {"a": embed.hashing_encoder_factory(8), "b": embed.hashing_encoder_factory(16)}
    got = _vec(embed.embed_models(units, models, normalise={"b": True}, batch_size=2))
    assert set(got) == {(i, m) for i in range(6) for m in "ab"}
    for i in range(6):
        plain = _vec(embed.embed_units(units, models["b"], "b"))[i, "b"]
        norm = math.sqrt(sum(x * x for x in plain))
        assert got[i, "b"] == pytest.approx([x / norm if norm else 0.0 for x in plain])
    assert got[0, "a"] == _vec(embed.embed_units(units, models["a"], "x"))[0, "x"]


def _words(spark):
    rows = [(1, 0, "alpha beta beta gamma"), (1, 0, "gamma delta alpha"), (2, 0, None), (None, 1, "alpha alpha"), (None, 1, "beta"), (3, 0, "a b"), (4, 2, "Ünï été_1 alpha")]
    return spark.createDataFrame(rows * 30, "review_id long, unit_pos int, unit string").repartition(3)


def _plain(rows, dim):
    import hashlib
    import re
    total = {}
    for r in rows:
        for w in re.findall(r"\w{2,}", (r.unit or "").lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            at = (r.review_id, r.unit_pos, int(h[:8], 16) % dim)
            total[at] = total.get(at, 0.0) + (1.0 if int(h[8:16], 16) % 2 == 0 else -1.0)
    return {k: v for k, v in total.items() if v}


def test_sparse_sums_rows_of_one_key_over_batches_without_a_bucket_aggregate(spark):
    units = _words(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a key goes over several batches
    try:
        sparse = embed.hash_embed_sparse(units, 5)
        rows = sparse.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {(r.review_id, r.unit_pos, r.bucket): r.value for r in rows}
    assert len(got) == len(rows) and got == _plain(units.collect(), 5)
    # a map of (unit, bucket) sums would hold all words of a task
    assert "HashAggregate" not in sparse._jdf.queryExecution().toString()
    assert embed.hash_embed_sparse(units.limit(0), 5).count() == 0


def test_dense_is_one_pass_over_the_words(spark):
    units = _words(spark).withColumn("vec", units_lit())
    dense = embed.hash_embed(units, 7)
    assert dense.columns == units.columns
    for r in dense.collect():
        if r.unit is None:
            assert list(r.vec) == [None] * 7
        else:
            want = _plain([r], 7)
            assert list(r.vec) == [want.get((r.review_id, r.unit_pos, b), 0.0) for b in range(7)]
    # no loop over buckets x words
    assert "aggregate(" not in dense._jdf.queryExecution().toString()
    unit = embed.hash_embed(units, 7, normalize=True).filter("unit = 'gamma delta alpha'").first()
    assert math.isclose(sum(x * x for x in unit.vec), 1.0)


def units_lit():
    from pyspark.sql import functions as F
    return F.lit("old")


def test_encoder_hashes_a_word_once(monkeypatch):
    hashed = []
    plain = embed._word_hashes
    monkeypatch.setattr(embed, "_word_hashes", lambda words, dim: hashed.extend(words) or plain(words, dim))
    encode = embed.hashing_encoder_factory(8)()
    a = encode(["alpha beta alpha", None, ""])
    b = encode(["alpha beta alpha"])
    assert a.shape == (3, 8) and (a[0] == b[0]).all() and not a[1:].any()
    assert sorted(hashed) == [b"alpha", b"beta"]
