"""The Jaccard join's bounds, long columns and hashes."""

import random

import numpy as np
import pytest

from gleaner.llm import common as C
from gleaner.llm import jaccard, substring


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def _roots(texts, n, percent):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in range(len(texts))}


def test_long_words_over_two_letters_do_not_collide(spark):
    one, two = thue_morse(1024), thue_morse(1024, True)
    import pyarrow as pa
    hashes = [h for *_, words in C.batch_words(pa.array([one, two, one])) for h in words.tolist()]
    assert hashes[0] == hashes[2] != hashes[1]
    docs = _docs(spark, [one, two])
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {0: 0, 1: 1}
    texts = [" ".join(f"{w}{i}" for i in range(41)) for w in (one, two)]  # no window in common
    assert all(r.n_removed == 0 for r in substring.substring_dedup(_docs(spark, texts)).collect())


def test_partner_two_size_classes_up(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[:19]), " ".join(words)]  # 17 of 28 three-word shingles: 60.7 %
    for percent, want in ((60, 0), (61, 1)):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(_docs(spark, texts), percent=percent).collect()}
        assert got == {0: 0, 1: want}


def test_bitmaps_never_exceed_the_difference():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        pool = rnd.integers(1, 1 << 62, 400, dtype=np.uint64)
        a, b = (np.unique(rnd.choice(pool, int(rnd.integers(1, 300)))) for _ in range(2))
        assert jaccard.fewest_differences(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))


def test_prefixes_of_linked_sets_share_a_column():
    rnd = random.Random(5)
    for percent in (10, 50, 60, 80, 90, 100):
        for _ in range(300):
            a = set(rnd.sample(range(40), rnd.randint(1, 40)))
            b = {x for x in a if rnd.random() < 0.95} | set(rnd.sample(range(40), rnd.randint(0, 2)))
            if not b or a == b or 100 * len(a & b) < percent * len(a | b):
                continue
            firsts = [set(sorted(s)[:jaccard.prefix_length(len(s), percent)]) for s in (a, b)]
            assert firsts[0] & firsts[1], (percent, a, b)


@pytest.mark.parametrize("n, percent, row_block, tile", [(5, 80, 16, 256), (5, 80, 2, 3), (2, 50, 3, 4), (3, 90, 1, 2)])
def test_groups_of_near_copies_and_shared_passages(spark, monkeypatch, n, percent, row_block, tile):
    """A large group of near copies, chains at the threshold, and one passage in many documents."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "BLOCK", tile)
    rnd = random.Random(11)
    words = lambda k, c: [f"{c}{rnd.randrange(2000)}" for _ in range(k)]
    base, passage = words(60, "b"), words(20, "p")
    texts = []
    for _ in range(40):
        near = list(base)
        for _ in range(rnd.randint(0, 3)):
            near[rnd.randrange(60)] = f"n{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(near[rnd.randint(0, 4):]))
    chain = words(70, "c")
    texts += [" ".join(chain[i * 2:i * 2 + 40]) for i in range(15)]  # only neighbours are alike
    texts += [" ".join(words(rnd.randint(0, 30), "d") + passage + words(rnd.randint(0, 30), "e")) for _ in range(25)]
    texts += ["", "one", "one", "one two", " ".join(passage)]
    want = _roots(texts, n, percent)
    got = {r.doc_id: r.component_id for r in
           jaccard.jaccard_components(_docs(spark, texts), n=n, percent=percent, row_block=row_block).collect()}
    assert got == want
    assert len(set(want.values())) < len(texts) - 20


def test_blocks_leave_pairs_to_an_earlier_column():
    import pyarrow as pa

    def near(earlier):
        grams = np.arange(1, 41, dtype=np.uint64)
        bits = [jaccard.bitmap(grams), jaccard.bitmap(grams[:-1])]
        table = pa.table({"side": [0, 1], "node": [5, 9], "n": [40, 39], "part": [5, 9], "inside": [False, False],
                          "bits": bits, "earlier": pa.array(earlier, pa.list_(pa.int64()))})
        return jaccard._close_blocks(80)(table).to_pylist()

    assert near([[], []]) == near([[1, 2], [3]]) == [{"a": 5, "b": 9}]
    assert near([[1, 2], [2, 3]]) == []


@pytest.mark.parametrize("earlier", [1, 32])
def test_chains_of_sizes_with_few_earlier_columns(spark, monkeypatch, earlier):
    monkeypatch.setattr(jaccard, "EARLIER", earlier)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        near = list(base)
        for _ in range(rnd.randint(0, 5)):
            near[rnd.randrange(80)] = f"n{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(near))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(_docs(spark, texts), n=5, percent=80).collect()}
    assert got == _roots(texts, 5, 80)


def test_scratch_removes_what_operators_opened(spark):
    import os
    with C.scratch() as opened:
        out = jaccard.keep_one(_docs(spark, ["a b c d e f"] * 3)).count()
    assert out == 1 and opened
    assert not any(os.path.exists(s.root.removeprefix("file:")) for s in opened)


def test_columns_cut_by_size_hold_all_linked_pairs(spark):
    rnd = random.Random(8)
    for n, percent in ((40, 80), (40, 90), (15, 50)):
        sets = [set(rnd.sample(range(3 * n), rnd.randint(2, n))) for _ in range(40)]
        sets += [{x for x in s if rnd.random() < 0.95} | {rnd.randrange(3 * n)} for s in sets]
        sets = [*{frozenset(s) for s in sets if s}, frozenset({0}), frozenset(range(1000))]  # the last two: no partner in size
        rows = [(i, len(s), sorted(s)[:jaccard.prefix_length(len(s), percent)]) for i, s in enumerate(sets)]
        sigs = spark.createDataFrame([*rows, *rows[:9]], "node long, n_shingles long, columns array<long>")
        got = [(r.key, r.node) for r in jaccard._cells(sigs, percent).collect()]
        assert len(got) == len(set(got)) < sum(len(r[2]) for r in rows)
        columns = {}
        for key, node in got:
            columns.setdefault(node, set()).add(key)
        assert len(sets) - 1 not in columns
        for a, x in enumerate(sets):
            for b in range(a):
                if 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                    assert columns[a] & columns[b], (percent, x, sets[b])


def test_blocks_give_the_nearest_pairs_first():
    import pyarrow as pa

    grams = np.arange(1, 101, dtype=np.uint64)
    sets = [grams[:-1], *(grams[:-1 - k] for k in range(1, 9))]  # the first against ever smaller ones
    table = pa.table({"side": [0] + [1] * 8, "node": list(range(9)), "n": [len(x) for x in sets], "part": list(range(9)), "inside": [False] * 9,
                      "bits": [jaccard.bitmap(x) for x in sets], "earlier": pa.array([[]] * 9, pa.list_(pa.int64()))})
    pairs = lambda most: [(r["a"], r["b"]) for r in jaccard._close_blocks(80, most)(table).to_pylist()]
    assert pairs(2) == [(0, 1), (0, 2)]
    assert sorted(pairs(None)) == [(0, b) for b in range(1, 9)]
