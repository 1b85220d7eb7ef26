"""Inputs that once ended a job or were cut silently."""

import pytest

from gleaner import session
from gleaner.operators import density, topics, words


def test_odd_topic_lines_are_rejected(spark):
    lines = ["[99999999999] Foo: y", "[١] Foo: y", "[1] Foo: y"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.status for r in topics.parse_topic_mentions(df).collect()] == ["invalid_format", "invalid_format", "ok"]
    df = spark.createDataFrame([(0, "[1] A (Count: 99999999999999999999): x"), (1, "[1] A (Count: 2): x")], "line_no int, line string")
    assert [r.status for r in topics.parse_topic_lines(df).orderBy("line_no").collect()] == ["reject", "ok"]


def test_bad_json_has_no_topics(spark):
    df = spark.createDataFrame([(0, "{bad"), (1, '{"1": ["a"], "x": ["b"]}'), (2, '{"1": ["c"]}')], "doc int, value string")
    assert [(r.doc, r.word) for r in words.normalise_topic_words(df, "value", ["doc"]).collect()] == [(2, "c")]


def test_components_converge_or_raise(spark):
    path = [(i * 37 % 61, (i + 1) * 37 % 61) for i in range(60)]
    df = spark.createDataFrame(path, "src long, dst long")
    assert {r.component for r in density.connected_components(df).collect()} == {0}
    with pytest.raises(RuntimeError):
        density.connected_components(df, max_rounds=1)


def test_early_stop_takes_any_document_column(spark):
    rows = [(1, "a", 0, 5), (1, "a", 1, 6), (1, "a", 2, 7)]
    df = spark.createDataFrame(rows, "lvl int, key string, idx long, doc long")
    assert topics.early_stop_index(df, 1, "doc").first().stop_doc == 7


def test_cluster_without_checkpoint_folder_raises():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
