"""Cutoffs and verdicts of the quality rules against exact binomial tails, cutoff by cutoff."""

import math
import random

import pytest

from gleaner.llm import quality_rules as Q


def _tail(k, n, p):
    return math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def _cutoffs(rows, alpha, delta):
    """{stratum: {rule: cutoff}} of (stratum, good, {rule: bin}), each rule's cutoffs tested from the loosest on."""
    strata = sorted({r[0] for r in rows})
    level, out = delta / (len(strata) * len(Q.RULES)), {}
    for s in strata:
        out[s] = {}
        good, bad = ([r[2] for r in rows if r[0] == s and r[1] == g] for g in (True, False))
        for rule in Q.RULES:
            best = None
            for j in range(Q.GRID - 1, -1, -1):
                k, hit = (sum(b[rule] > j for b in group) for group in (good, bad))
                if not good or _tail(k, len(good), alpha / len(Q.RULES)) > level:
                    break
                if hit > k and (best is None or hit - k > best[0]):
                    best = (hit - k, j)
            out[s][rule] = best and best[1]
    return out


@pytest.mark.parametrize("alpha", [0.05, 0.2])
def test_cutoffs_are_those_of_sequential_exact_tests(spark, alpha):
    rnd = random.Random(5)
    rows = []
    for s, n in (("a", 900), ("b", 470), ("c", 60), ("d", 700)):
        for _ in range(n):
            good = rnd.random() < 0.9
            bins = {r: min(Q.GRID, int(abs(rnd.gauss(0, 2 + i + (0 if good else 12))))) for i, r in enumerate(Q.RULES)}
            rows.append((s, good, bins))
    frame = spark.createDataFrame([(s, g, *(b[r] for r in Q.RULES)) for s, g, b in rows],
                                  "stratum string, good boolean, " + ", ".join(f"bin_{r} int" for r in Q.RULES))
    got = {r.stratum: {q: r[f"cut_{q}"] for q in Q.RULES} for r in Q.cutoffs(frame, alpha, 0.05).collect()}
    want = _cutoffs(rows, alpha, 0.05)
    none = dict.fromkeys(Q.RULES)
    assert {s: got.get(s, none) for s in want} == want
    assert any(v is not None for v in want["a"].values()) and (alpha > 0.05 or want["c"] == none)


def test_verdict_and_kept_rows(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    docs, labels = [], []
    for i in range(800):
        good = i % 4 > 0
        words = [word() for _ in range(20)]
        if not good and i % 8 == 0:
            words += ["#$%&" * 4] * 2  # symbols
        docs.append((i, " ".join(words), "en", "extra"))
        labels.append((i, int(good)))
    docs += [(900, None, "en", None), (901, "", None, "x"), (902, "too short", "en", "x"), (0, docs[0][1], "en", "extra")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, row string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    judged = sorted((r.doc_id, r.kept) for r in Q.judge(d, lab).collect())
    want = sorted((i, t is not None and len(t.split()) >= 10 and "#" not in t) for i, t, *_ in docs)
    assert judged == want
    kept = Q.keep_good(d, lab)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in want if k)
    report = {r.stratum: (r.n, r.usable) for r in Q.strata_report(d, lab).collect()}
    assert report == {"en": (600, True)}
    need = Q.strata_report(d, lab).first()["needed"]
    p = 1 - Q.ALPHA / len(Q.RULES)
    assert p ** need <= Q.DELTA / len(Q.RULES) < p ** (need - 1)
