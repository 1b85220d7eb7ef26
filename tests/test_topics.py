"""Topic folding, early stop, topic lines and trees (FIXTURES.md) plus a loop oracle."""

import random

from gleaner.operators import topics as TP


def _resp(spark, responses):
    return spark.createDataFrame(list(enumerate(responses)), "doc_pos long, response string")


def test_fold_example(spark):
    resp = _resp(spark, ["[1] Trade: x", "[1] trade: y\n[2] Sub: z\nNone", "[1] R&D: w", "[1] Health: h"])
    topics = {r.name: (r["count"], r.desc) for r in TP.fold_topics(TP.valid_mentions(resp), None).collect()}
    assert topics == {"Trade": (2, "x"), "Health": (1, "h")}
    rej = sorted((r.line, r.status) for r in TP.topic_rejects(resp).collect())
    assert rej == [("None", "invalid_format"), ("[1] R&D: w", "invalid_format"), ("[2] Sub: z", "lower_level")]


def test_early_stop_example(spark):
    resp = _resp(spark, ["[1] Trade: a", "[1] trade: b", "[1] TRADE: c", "[1] Health: h"])
    m = TP.valid_mentions(resp)
    topics = {r.name: r["count"] for r in TP.fold_topics(m, 1).collect()}
    assert topics == {"Trade": 3}
    kept = [r.doc_pos for r in TP.processed_responses(resp, m, 1).collect()]
    assert sorted(kept) == [0, 1]


def _loop(mentions, n):
    seen, counts, run = {}, {}, 0
    for key in mentions:
        if key in seen:
            counts[key] += 1
            run += 1
            if run > n:
                break
        else:
            seen[key] = True
            counts[key] = 1
            run = 0
    return counts


def test_early_stop_equals_loop(spark):
    rnd = random.Random(5)
    for trial in range(6):
        names = [f"T{i}" for i in range(rnd.randint(1, 6))]
        seq = [rnd.choice(names[: rnd.randint(1, len(names))]) for _ in range(rnd.randint(1, 80))]
        n = rnd.randint(0, 6)
        resp = _resp(spark, [f"[1] {s}: d" for s in seq])
        got = {r.name.lower(): r["count"] for r in TP.fold_topics(TP.valid_mentions(resp), n).collect()}
        assert got == {k.lower(): v for k, v in _loop(seq, n).items()}, (seq, n)


def test_topic_lines_and_parents(spark):
    lines = ["[1] Trade (Count: 2): Exchange", "[1] Trade (Count: 2)", "    [2] Tax (Count: 1): t",
             "[1] Health (Count: 5): h", "[2] Care (Count: 1): c", "[2] Care (Count: 2): c2"]
    df = spark.createDataFrame([(i + 1, l) for i, l in enumerate(lines)], "line_no long, line string")
    parsed = TP.parse_topic_lines(df)
    st = {r.line_no: r.status for r in parsed.collect()}
    assert st[2] == "reject"
    tree = {r.name: (r.node_id, r["count"], r.parent_id) for r in TP.topic_parents(parsed).collect()}
    assert tree["Trade"] == (1, 2, 0)
    assert tree["Tax"] == (3, 1, 1)
    assert tree["Health"] == (4, 5, 0)
    assert tree["Care"] == (5, 3, 4)  # same name under one parent adds counts
    outline = [r.line for r in TP.topic_outline(TP.topic_parents(parsed)).orderBy("path").collect()]
    assert outline == ["[1] Trade", "\t[2] Tax", "[1] Health", "\t[2] Care"]
    removed = {r.name for r in TP.remove_topic(TP.topic_parents(parsed), "Trade", 1).collect()}
    assert removed == {"Health", "Care"}
    merged = {r.name: r["count"] for r in TP.merge_topics(TP.topic_parents(parsed), [("trade", 1), ("HEALTH", 1)],
                                                       "Both", "d").collect()}
    assert merged == {"Both": 7}


def test_prune_topics_prefix_under_budget(spark):
    sims = spark.createDataFrame(
        [(0, "[1] Alpha", 0.9), (0, "[1] Beta beta beta", 0.8), (0, "[1] Gamma", 0.1), (1, "[1] Alpha", 0.2),
         (1, "[1] Gamma", 0.7)], "doc_pos long, topic string, sim double")
    budget = spark.createDataFrame([(0, 8), (1, 4)], "doc_pos long, max_top_len long")
    kept = sorted((r.doc_pos, r.topic) for r in TP.prune_topics(sims, budget).collect())
    # costs: "[1] Alpha" = 4 estimator tokens ([ 1 ] Alpha), "[1] Beta beta beta" = 6, "[1] Gamma" = 4
    assert kept == [(0, "[1] Alpha"), (1, "[1] Gamma")]


def test_build_prompts_fills_like_format(spark):
    docs = spark.createDataFrame([(0, "a {Topics} b"), (1, " ".join(["w"] * 50))], "doc_id long, text string")
    topics = spark.createDataFrame([(1, "[1] Trade: x"), (2, "[1] Health: y")], "order long, topic string")
    out = {r.doc_id: r for r in TP.build_prompts(docs, topics, "T:{Topics}|D:{Document}|{{x}}", 30, 5).collect()}
    assert out[0].prompt == "T:[1] Trade\n[1] Health|D:a {Topics} b|{x}"
    assert out[1].truncated and out[1].prompt.count("w") < 50


def test_prompts_fit_and_cut_prefixes(spark):
    texts = ["don't stop: it's  a\twell-known\nthing " * 6, "tax and trade", "care " * 12, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    topics = spark.createDataFrame([(i, f"[1] {n}: x") for i, n in enumerate(["Alpha", "Trade tax", "Beta gamma", "Care", "Delta"])],
                                   "order long, topic string")
    out = TP.build_prompts(docs, topics, "{Topics}|{Document}", 26, 12)
    rows = {r.doc_id: r for r in out.select("*", TP.estimate_tokens("prompt").alias("n")).collect()}
    assert all(r.n <= 26 for r in rows.values()) and len(rows) == 5
    for r in rows.values():
        shown, doc = r.prompt.split("|")
        assert (texts[r.doc_id] or "").startswith(doc) and (r.truncated or doc == (texts[r.doc_id] or ""))
        assert r.pruned == (len(shown.split("\n")) < 5)
    assert rows[0].truncated and rows[2].pruned and rows[2].prompt.split("\n")[0].split("|")[0] == "[1] Care"
    assert not rows[1].pruned or rows[1].prompt.startswith("[1] Trade tax")


def test_seeds_in_fold_and_early_stop(spark):
    seeds = TP.read_seed_topics(spark.createDataFrame([(1, "[1] Trade: s"), (2, "[2] Tax"), (3, "[1] TRADE")], "line_no long, line string"))
    m = TP.valid_mentions(_resp(spark, ["[1] trade: a", "[1] Trade: b", "[1] Health: h", "[1] health: i"]))
    rows = [(r.name, r["count"]) for r in TP.fold_topics(m, None, seeds).orderBy("topic_order").collect()]
    assert rows == [("Trade", 3), ("Tax", 1), ("TRADE", 1), ("Health", 2)]
    # the run of duplicates begins at index 0
    assert tuple(TP.early_stop_index(m, 1, seeds=seeds).first()) == (2, 1)
    assert tuple(TP.early_stop_index(m, 2, seeds=seeds).first()) == (None, None)
    other = m.withColumnRenamed("doc_pos", "document")
    assert tuple(TP.early_stop_index(other, 1, "document", seeds).first()) == (2, 1)


def test_two_merges_and_third_level(spark):
    lines = ["[1] A (Count: 1): a", "[2] B (Count: 2): b", "[3] C (Count: 3): c", "[1] D (Count: 4): d", "[1] E (Count: 5): e"]
    tree = TP.topic_parents(TP.parse_topic_lines(spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")))
    assert tree.count() == 5
    once = TP.merge_topics(tree, [("d", 1)], "M", "m")
    twice = {r.name: (r.node_id, r["count"]) for r in TP.merge_topics(once, [("e", 1)], "N", "n").collect()}
    assert twice == {"A": (1, 1), "B": (2, 2), "C": (3, 3), "M": (6, 4), "N": (7, 5)}


def test_rejects_end_at_the_failed_call(spark):
    resp = _resp(spark, ["None", "Error", "None"])
    assert [r.doc_pos for r in TP.topic_rejects(resp).orderBy("doc_pos").collect()] == [0, 1]


def test_find_duplicates(spark):
    tree = spark.createDataFrame([(1, 1, "Trade", 0), (2, 2, "Ports", 1), (3, 1, "Health", 0), (4, 2, "ports", 3), (5, 2, "Trade", 3)],
                                 "node_id long, lvl int, name string, parent_id long")
    sought = spark.createDataFrame([(2, "PORTS"), (2, "PORTS"), (1, "trade"), (3, "Trade"), (None, "Trade"), (1, None)], "lvl int, name string")
    got = sorted((r.sought, r.node_id) for r in TP.find_duplicates(tree, sought).collect())
    assert got == [("PORTS", 2), ("PORTS", 4), ("trade", 1)]
    assert TP.find_duplicates(tree, sought.limit(0)).count() == 0
