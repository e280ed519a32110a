from conftest import rows
from pyspark.sql import functions as F

from threadlens.operators import aggregates as A
from threadlens.operators.filters import (
    drop_missing_source, exclude_containing, filter_values, negative_flagged, parse_values, table_shape)

EDGES = [i / 10 - 1 for i in range(11)]


def test_bins_hold_their_right_edge(spark):
    scores = [(-1.0, 1), (-0.9, 2), (-0.85, 4), (0.0, 8), (0.01, 16), (-1.2, 32), (None, 64)]
    df = spark.createDataFrame(scores, "s float, n long")
    got = {b: n for _, b, n in rows(A.binned_histogram(df, "s", "n", EDGES))}
    assert len(got) == 10
    assert got["[-1.0~-0.9]"] == 3 and got["[-0.9~-0.8]"] == 4 and got["[-0.1~0.0]"] == 8
    assert sum(got.values()) == 15


def test_prediction_analysis_without_errors(spark):
    df = spark.createDataFrame([("t", 1, 1), ("u", 0, 1), ("u", 1, 0), ("u", 1, 0)], "topic string, label int, pred int")
    got = {r[0]: r[1:] for r in rows(A.prediction_analysis(df, "topic", "label", "pred", 0, 1))}
    assert got["t"] == (1, 0, 0, 0, 1.0, None)
    assert got["u"] == (0, 3, 1, 2, 0.0, 2 / 3)


def test_phrase_hits_count_texts(spark):
    df = spark.createDataFrame([("a b a",), ("b",), (None,)], "t string")
    assert sorted(rows(A.phrase_hits(df, "t", ["a", "b", "c"]))) == [("a", 1), ("b", 2), ("c", 0)]


def test_shares(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("y", 4), (None, 0)], "g string, n long")
    assert sorted(r[2] for r in rows(A.share_of_total(df, "n"))) == [0.0, 12.5, 37.5, 50.0]
    per_group = {(r[0], r[1]): r[2] for r in rows(A.share_of_total(df.filter("g is not null"), "n", "g"))}
    assert per_group == {("x", 1): 25.0, ("x", 3): 75.0, ("y", 4): 100.0}


def test_share_below_ignores_missing_scores(spark):
    df = spark.createDataFrame([("t", "1", -0.9), ("t", "2", 0.5), ("t", "3", None)], "topic string, comment_id string, s float")
    assert rows(A.share_below(df, "topic", "s", -0.8)) == [("t", 3, 1, 1 / 3 * 100)]


def test_merge_aliases(spark):
    df = spark.createDataFrame([("Reuters", 5, 1), ("reuter", 2, 1), ("youtu", 1, 7), ("bbc", 1, 1)], "source string, n long, s long")
    got = sorted(rows(A.merge_aliases(df, "source", {"reuter": "reuters", "youtu": "youtube"}, ["n", "s"])))
    assert got == [("bbc", 1, 1), ("reuters", 7, 2), ("youtube", 1, 7)]


def test_period_summary(spark):
    df = spark.createDataFrame(
        [("w", "p1", "c1", 0.5, 0.25, True), ("w", "p1", "c2", -0.25, 0.25, False), ("v", "p2", "c3", 1.0, 0.0, None)],
        "year_week string, id string, comment_id string, vader_score double, textblob_score double, misinfo_class boolean")
    assert sorted(rows(A.period_summary(df, "year_week"))) == [("v", 1.0, 0.0, 1, 1, 0), ("w", 0.25, 0.5, 1, 2, 1)]
    assert rows(A.period_summary(df, "year_week", flagged_only=True)) == [("w", 0.5, 0.25, 1, 1)]


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    assert sorted(rows(A.confusion_matrix(df, "y", "p", [0, 1]))) == [(0, 1, 1), (1, 0, 2)]


def test_filters(spark):
    df = spark.createDataFrame(
        [("News", "u", "bbc"), ("news", "", "cnn"), ("worldnews", "u", None), ("news", "u", "reddit"), ("news", None, "x")],
        "subreddit string, url string, source string")
    assert parse_values(" a, b ,,c") == ["a", "b", "c"]
    assert filter_values(df, "subreddit", "news, other").count() == 3
    assert filter_values(df, "subreddit", ["NEWS"], case_insensitive=True).count() == 4
    assert rows(drop_missing_source(df)) == [("News", "u", "bbc")]
    assert exclude_containing(df, "source", ["bb", "cn"]).count() == 2
    assert rows(table_shape(df)) == [(5, 3)]
    scores = spark.createDataFrame([(-0.1, True), (-0.1, False), (0.1, True), (None, True)], "vader_score float, misinfo_class boolean")
    assert negative_flagged(scores).count() == 1


def test_distinct(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"))
    assert A.distinct_values(df, "k").count() == 3
    assert rows(A.distinct_count(df, "k")) == [(3,)]
