"""C_v: worked example and brute force over materialised sliding windows."""

import math
import random

import pytest

from gleaner.operators import coherence as COH


def _texts(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)],
                                 "review_id long, unit_pos int, tokens array<string>")


def _topics(spark, topics):
    rows = [("s", f"t{k}", p, w) for k, ws in enumerate(topics) for p, w in enumerate(ws)]
    return spark.createDataFrame(rows, "setting string, topic string, pos int, word string")


def test_worked_example(spark):
    texts = _texts(spark, [["a", "b"], ["a", "b"], ["a"], ["c"]])
    r = COH.coherence_cv(texts, _topics(spark, [["a", "b"]]), denominator="all").first()
    assert r.c_v == pytest.approx(0.9241483571, abs=1e-9)


def _brute(texts, topics, denominator, window=110, eps=1e-12):
    words = {w for t in topics for w in t}
    wins = []
    for t in texts:
        if not t:
            continue
        if denominator == "relevant" and not (set(t) & words):
            continue
        n = max(len(t) - window + 1, 1)
        for s in range(n):
            wins.append(set(t[s:s + window]))
    N = len(wins)
    res = []
    for tw in topics:
        def c(*ws):
            return sum(1 for w in wins if all(x in w for x in ws))

        def npmi(a, b):
            pa, pb, pab = c(a) / N, c(b) / N, c(a, b) / N
            if pa == 0 or pb == 0:
                return 0.0
            return math.log((pab + eps) / (pa * pb)) / -math.log(pab + eps)
        uniq = sorted(set(tw))
        vecs = []
        for wi in tw:
            v = {u: 0.0 for u in uniq}
            for wj in tw:
                v[wj] += npmi(wi, wj)
            vecs.append(v)
        vs = {u: sum(v[u] for v in vecs) for u in uniq}
        sims = []
        for v in vecs:
            dot = sum(v[u] * vs[u] for u in uniq)
            nv = math.sqrt(sum(x * x for x in v.values()))
            ns = math.sqrt(sum(x * x for x in vs.values()))
            sims.append(0.0 if nv == 0 or ns == 0 else dot / (nv * ns))
        res.append(sum(sims) / len(sims))
    return res


@pytest.mark.parametrize("denominator", ["all", "relevant"])
def test_matches_brute_force_with_long_texts(spark, denominator):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(30)]
    texts = [[rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 50, 109, 110, 111, 260, 400]))]
             for _ in range(40)]
    topics = [rnd.sample(vocab[:12], 5), rnd.sample(vocab, 4) + [vocab[0]]]
    got = {r.topic: r.c_v for r in COH.coherence_cv(_texts(spark, texts), _topics(spark, topics),
                                                    denominator=denominator).collect()}
    exp = _brute(texts, topics, denominator)
    for k, e in enumerate(exp):
        assert got[f"t{k}"] == pytest.approx(e, abs=1e-9)


def test_a_text_is_tokenised_once_a_scan(spark):
    units = spark.range(3).selectExpr("id as review_id", "0 as unit_pos", "'Alpha beta of ' || id as unit")
    texts = COH.tokenised_texts(units)
    from pyspark.sql import functions as F
    used = texts.filter(F.size("tokens") > 0).filter(F.size("tokens") <= COH.WINDOW).select("review_id", F.size("tokens"), "tokens")
    assert used._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {tuple(r.tokens) for r in used.collect()} == {("alpha", "beta")}


def test_more_words_than_a_plan_lists(spark, monkeypatch):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(20)]
    texts = _texts(spark, [[rnd.choice(vocab) for _ in range(rnd.choice([0, 2, 9, 130]))] for _ in range(30)]).cache()
    topics = _topics(spark, [vocab[:4], vocab[2:9], [vocab[0], vocab[0]]]).cache()
    seen = COH.present_terms(texts, topics.withColumnRenamed("pos", "rank"))
    first = sorted(COH.coherence_cv(texts, topics).collect()), sorted(seen.collect())
    monkeypatch.setattr(COH, "LISTED_WORDS", 1)
    seen = COH.present_terms(texts, topics.withColumnRenamed("pos", "rank"))
    second = sorted(COH.coherence_cv(texts, topics).collect()), sorted(seen.collect())
    assert [r[:3] for r in first[0]] == [r[:3] for r in second[0]] and first[1] == second[1]
    assert [r.c_v for r in first[0]] == pytest.approx([r.c_v for r in second[0]], abs=1e-9)
