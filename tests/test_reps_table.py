"""Weighted centroid example and the golden inspection sheet -> comparison table."""

import pytest

from gleaner.operators import reps as REP
from gleaner.operators import table as TB


def test_weighted_centroid_and_representative(spark):
    rows = [(5, 1, 1, "p1", [1.0, 0.0], 0.0), (5, 1, 2, "p2", [0.0, 1.0], 0.5), (5, 1, 3, "p3", [1.0, 1.0], 1.0)]
    u = spark.createDataFrame(rows, "dim int, cluster_id int, vec_id long, phrase string, vec array<double>, "
                                    "outlier double")
    c = REP.weighted_centroid(u, 1.0).first().centroid
    assert c == pytest.approx([0.666667, 0.333333], abs=1e-6)
    rep = REP.representative_phrase(u, REP.weighted_centroid(u, 1.0)).first()
    assert rep.weighted_centroid_phrase == "p3"
    assert rep.rep_cosine_sim == pytest.approx(0.948683, abs=1e-6)
    allone = u.withColumn("outlier", u.outlier * 0 + 1.0)
    assert REP.weighted_centroid(allone, 1.0).first().centroid == pytest.approx([0.666667, 0.666667], abs=1e-6)


# Golden inspection sheet (20 rows) and its expected tables, recreated as literals.
SHEET = [
    (5, 577, 469, "good programming assignments", "challenging programming exercises"),
    (5, 482, 348, "math content obviously must lot well explained", "hard math content"),
    (5, 187, 307, "excelente curso muy bueno explicacion sencilla de las cosas", "excellent course"),
    (5, 70, 282, "course using matlab octave really helpful", "Octave and Matlab"),
    (5, 4, 238, "great course", "great course"),
    (5, 565, 201, "helps understand implementation application basics basic yet powerful algorithms", "algorithm"),
    (5, 167, 181, "andrew expert great teacher", "Andrew good teaching"),
    (5, 365, 174, "good overview data science", "good intro to data science"),
    (5, 0, 172, "excellent course", "execellent course"),
    (5, 414, 158, "one best courses coursera", "best course in coursera"),
    (10, 608, 349, "good programming assignments", "good programming exercises"),
    (10, 519, 345, "math content obviously must lot well explained", "hard math content"),
    (10, 82, 283, "first disappointed homework needs done matlab octave instead", "Octave and Matlab"),
    (10, 190, 261, "es el mejor curso de todos gracias por compartir tanto conocimiento", "good way of teaching"),
    (10, 5, 238, "great course", "great course"),
    (10, 150, 199, "andrew expert great teacher", "Andrew good teaching"),
    (10, 2, 172, "excellent course", "execellent course"),
    (10, 478, 157, "one best courses ever coursera", "best course in coursera"),
    (10, 20, 148, "老师讲的通俗易懂，很利于入门机器学习。", "good way of teaching"),
    (10, 514, 137, "taught not sufficient quizzes", "quiz questions"),
]

TABLE = [
    "| 1 | good programming assignments | challenging programming exercises | good programming assignments | good programming exercises |",
    "| 2 | math content obviously must lot well explained | **hard math content** | math content obviously must lot well explained | **hard math content** |",
    "| 3 | excelente curso muy bueno explicacion sencilla de las cosas | excellent course | first disappointed homework needs done matlab octave instead | **Octave and Matlab** |",
    "| 4 | course using matlab octave really helpful | **Octave and Matlab** | es el mejor curso de todos gracias por compartir tanto conocimiento | good way of teaching |",
    "| 5 | great course | **great course** | great course | **great course** |",
    "| 6 | helps understand implementation application basics basic yet powerful algorithms | algorithm | andrew expert great teacher | **Andrew good teaching** |",
    "| 7 | andrew expert great teacher | **Andrew good teaching** | excellent course | **execellent course** |",
    "| 8 | good overview data science | good intro to data science | one best courses ever coursera | **best course in coursera** |",
    "| 9 | excellent course | **execellent course** | 老师讲的通俗易懂，很利于入门机器学习。 | good way of teaching |",
    "| 10 | one best courses coursera | **best course in coursera** | taught not sufficient quizzes | quiz questions |",
]

MEMBERSHIP = [
    ("Andrew good teaching", "andrew expert great teacher", "both"),
    ("Octave and Matlab", "first disappointed homework needs done matlab octave instead", "both"),
    ("best course in coursera", "one best courses ever coursera", "both"),
    ("execellent course", "excellent course", "both"),
    ("great course", "great course", "both"),
    ("hard math content", "math content obviously must lot well explained", "both"),
    ("algorithm", "helps understand implementation application basics basic yet powerful algorithms", "5D"),
    ("challenging programming exercises", "good programming assignments", "5D"),
    ("excellent course", "excelente curso muy bueno explicacion sencilla de las cosas", "5D"),
    ("good intro to data science", "good overview data science", "5D"),
    ("good programming exercises", "good programming assignments", "10D"),
    ("good way of teaching", "es el mejor curso de todos gracias por compartir tanto conocimiento", "10D"),
    ("quiz questions", "taught not sufficient quizzes", "10D"),
]


def _ranked(spark):
    sheet = spark.createDataFrame(SHEET, "dim int, cluster_id int, size long, rep_phrase string, aspect_label string")
    return TB.rank_in_group(TB.drop_unlabelled(sheet), tie_col="cluster_id")


def test_side_by_side_golden(spark):
    rows = TB.side_by_side(_ranked(spark)).orderBy("top_n").collect()
    assert [r.md_line for r in rows] == TABLE


def test_label_membership_golden(spark):
    rows = TB.label_membership(_ranked(spark)).orderBy("order_key", "aspect_label").collect()
    assert [(r.aspect_label, r.rep_phrase, r.appears_in) for r in rows] == MEMBERSHIP
