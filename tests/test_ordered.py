"""Scans along an order, two-step top terms, class-wise IRBO and file order against plain loops."""

import random

from pyspark.sql import functions as F

from gleaner.operators import diversity, ordered, topics, words
from gleaner.sources import io


def test_next_and_last_seen_cross_partitions(spark):
    rnd = random.Random(1)
    nos = rnd.sample(range(1000), 120)
    rows = [(i, i if rnd.random() < 0.1 else None) for i in nos]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "no long, mark long").repartition(parts)
        nxt = {r.no: r.n for r in ordered.with_next(df, "no", "n").collect()}
        seen = {r.no: r.s for r in ordered.with_last_seen(df, ["no"], "mark", "s").collect()}
        last = None
        for i, (no, mark) in enumerate(sorted(rows)):
            last = mark if mark is not None else last
            assert seen[no] == last
            assert nxt[no] == (sorted(nos)[i + 1] if i + 1 < len(nos) else None)
    none = spark.createDataFrame([], "no long, mark long")
    assert ordered.with_next(none, "no", "n").count() == 0 and ordered.with_last_seen(none, ["no"], "mark", "s").count() == 0


def test_topic_plans_have_no_window_over_the_whole_table(spark):
    lines = ["[1] Trade (Count: 2): x", "[2] Tax (Count: 1): t", "[1] Health (Count: 1): h", "[2] Tax (Count: 5): u", "[2] Tax (Count: 1): v"]
    parsed = topics.parse_topic_lines(spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string"))
    tree = topics.topic_parents(parsed)
    assert {(r.name, r["count"], r.parent_id) for r in tree.collect()} == {("Trade", 2, 0), ("Health", 1, 0), ("Tax", 1, 1), ("Tax", 6, 3)}
    m = spark.createDataFrame([(i + 1, i, 0, "T" + str(i % 5), "d", 1, "t" + str(i % 5)) for i in range(20)],
                              "idx long, doc_pos long, line_pos int, name string, desc string, lvl int, key string")
    stop = topics.early_stop_index(m, 3)
    assert tuple(stop.first()) == (9, 8)  # the last new topic is mention 5; three duplicates may follow
    for df in (tree, stop):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "Window " in line:
                assert "_pid" in line, line


def test_top_terms_in_two_steps(spark):
    rnd = random.Random(3)
    rows = [("ab"[i % 2], f"t{i}", rnd.randint(1, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "setting string, term string, tot long")
    got = {(r.setting, r.term) for r in words._top_terms(df, ["setting"], 20, [F.col("tot").desc(), F.col("term")]).collect()}
    want = {(s, t) for g in "ab" for s, t, _ in sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:20]}
    assert got == want


def test_pad_zero_fills_short_clusters(spark):
    rows = [("s", 0, "a", 2.0), ("s", 0, "b", 1.0), ("s", 1, "c", 3.0), ("s", 2, "d", 1.0), ("s", 2, "e", 0.5), ("s", 2, "f", 0.2), ("u", 0, "z", 1.0)]
    df = spark.createDataFrame(rows, "setting string, cluster int, term string, weight double")
    got = {}
    for r in words.top_words(df, 3, pad_zero=["setting"]).collect():
        got.setdefault((r.setting, r.cluster), {})[r["rank"]] = (r.word, r.weight)
    assert got["s", 0] == {1: ("a", 2.0), 2: ("b", 1.0), 3: ("f", 0.0)}
    assert got["s", 1] == {1: ("c", 3.0), 2: ("f", 0.0), 3: ("e", 0.0)}
    assert got["s", 2] == {1: ("d", 1.0), 2: ("e", 0.5), 3: ("f", 0.2)} and got["u", 0] == {1: ("z", 1.0)}


def test_irbo_by_classes_equals_the_sum_over_pairs(spark):
    rnd = random.Random(6)
    rows = []
    for t in range(30):
        for rank, w in enumerate(rnd.sample(["every"] + [f"w{i}" for i in range(25)], rnd.randint(1, 10)), 1):
            rows.append(("s", t, rank, w))
        rows.append(("all", t, 1, "every"))  # a word in every list
    df = spark.createDataFrame(rows, "setting string, topic int, rank int, word string")
    for variant in ("reference", "standard"):
        pairs = {r.setting: r.s for r in diversity.rbo_pairs(df, variant=variant).groupBy("setting").agg(F.sum("rbo").alias("s")).collect()}
        got = {r.setting: r.irbo for r in diversity.irbo(df, variant=variant).collect()}
        for s in ("s", "all"):
            assert abs(got[s] - (1 - pairs[s] / (30 * 29 / 2))) < 1e-12
    join = diversity._rbo_total(df.filter("setting = 'all'"), 0.9, 10, ["setting"], "topic", "reference")
    assert join.count() == 1


def test_lines_of_a_folder_keep_file_order(spark, tmp_path):
    for name, n in (("a.md", 3), ("b.md", 4000), ("c.md", 1)):
        (tmp_path / name).write_text("".join(f"[1] {name[0]}{i} (Count: {i}): d\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r.line.split()[1] for r in io.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(4000)] + ["c0"]
    parsed = io.read_topic_lines(spark, str(tmp_path)).orderBy("line_no").first()
    assert parsed["name"] == "a0" and parsed["line_no"] == 1
