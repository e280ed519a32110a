"""Properties of fitted models and evaluation measures."""

import math

import pytest
from conftest import MEDIUM, rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from threadlens import constants as K
from threadlens.catalog import views as V
from threadlens.constants import TOPIC_NAMES
from threadlens.operators import classify as M
from threadlens.operators import stats as S
from threadlens.operators.cluster import cluster_titles
from threadlens.operators.topics import assign_topic, describe_topics, fit_topics, idf_table, vocabulary
from threadlens.plans import articles as R


@pytest.fixture(scope="module")
def posts(spark):
    return V.posts(spark, MEDIUM).cache()


@pytest.fixture(scope="module")
def model(posts):
    return fit_topics(posts, "title", max_iter=5, min_df=2)


def test_topic_distribution(model, posts):
    mixed = model.transform(posts).select("id", "tokens", vector_to_array("topicDistribution").alias("d")).collect()
    assert len(mixed) == posts.count() == len({r["id"] for r in mixed})
    known = set(model.vocabulary)
    for r in mixed:  # a title without a known word belongs to no topic
        assert len(r["d"]) == 8 and sum(r["d"]) == pytest.approx(1 if known & set(r["tokens"]) else 0)


def test_topics_repeat_with_seed(model, posts):
    again = fit_topics(posts.repartition(3), "title", max_iter=5, min_df=2)
    assert again.vocabulary == model.vocabulary
    for a, b in zip(rows(describe_topics(model)), rows(describe_topics(again))):
        assert a[1] == b[1]
        assert a[2] == pytest.approx(b[2])


def test_assigned_topics_keep_the_post_columns(model, posts):
    topics = assign_topic(model, posts)
    assert topics.columns == [*posts.columns, "topic_num", "topic"]
    assert {r["topic"] for r in topics.select("topic").distinct().collect()} <= {None, *TOPIC_NAMES.values()}
    assert {r[0] for r in rows(topics.select("topic_num").distinct())} <= {None, *range(8)}
    assert topics.count() == posts.count()


def test_posts_without_title_or_known_word_stay_without_topic(model, posts):
    odd = posts.limit(2).withColumn("title", F.lit(None).cast("string")).unionByName(posts.limit(1).withColumn("title", F.lit("zzzz qqqq")))
    got = assign_topic(model, odd).collect()
    assert [(r["topic_num"], r["topic"]) for r in got] == [(None, None)] * 3 and [r["title"] for r in got] == [None, None, "zzzz qqqq"]


def test_vocabulary_and_idf(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],)], "t array<string>")
    assert rows(vocabulary(df, "t", 10, 1)) == [("a", 3, 2), ("b", 1, 1)]
    assert rows(vocabulary(df, "t", 10, 2)) == [("a", 3, 2)]
    import math

    got = {r[0]: r[2] for r in rows(idf_table(df, "t"))}
    assert got == pytest.approx({"a": math.log(4 / 3), "b": math.log(2)})


def test_clusters(spark):
    titles = V.posts_with_topic(spark, MEDIUM)
    got = rows(cluster_titles(titles, k=4))
    kept = titles.filter(~F.col("topic").isin("demographic info", "tv shows")).count()
    assert len(got) == kept == len({r[0] for r in got})
    assert {r[1] for r in got} <= set(range(4)) and all(r[2] is not None and r[3] is not None for r in got)
    assert sorted(got) == sorted(rows(cluster_titles(titles, k=4)))


def test_classifier_beats_or_meets_the_majority(spark):
    articles = R.article_labels(V.posts_with_topic(spark, MEDIUM), V.flagged_comments(spark, MEDIUM))
    training, test, validation = R.classified_articles(articles, ["us", "new", "man"])
    assert training.count() + test.count() + validation.count() == articles.count()
    right = M.accuracy(training, "label", "predictedMisinfo").first()["accuracy"]
    counts = [r["count"] for r in R.label_counts(training).collect()]
    assert right >= max(counts) / sum(counts) - 1e-9
    report = R.classifier_report(training)
    assert report.agg(F.sum(F.col("true label") + F.col("false label"))).first()[0] == training.count()


def test_auc(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.round(F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.0) + (F.col("id") * 7919 % 100) / 100, 1).alias("s"))
    want = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="s", numBins=0).evaluate(df.withColumn("y", F.col("y").cast("double")))
    assert M.auc(df, "y", "s").first()[0] == pytest.approx(want)
    hard = df.select("y", (F.col("s") > 0.5).cast("int").alias("p"))
    want = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(hard.select(F.col("y").cast("double"), F.col("p").cast("double")))
    assert M.auc_of_predictions(hard, "y", "p").first()[0] == pytest.approx(want)


def test_regression(spark):
    df = spark.range(50).select((F.col("id") * 2 + 1 + F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("y"), F.col("id").alias("x"), (F.col("id") % 7).alias("z"))
    one = S.simple_regression(df, "y", "x").first()
    assert one["slope"] == pytest.approx(2, abs=0.01) and one["mse"] == pytest.approx(1, abs=0.01)
    single = S.series_regression(df, "y", ["x"]).first()
    assert (single["mse"], single["r2"]) == pytest.approx((one["mse"], one["r2"]))
    assert S.series_regression(df, "y", ["x", "z"]).first()["r2"] >= single["r2"]


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([(1, 2), (2, 4), (3, None), (4, 8)], "a long, b long")
    got = {(r["x"], r["y"]): r["corr"] for r in S.correlation_matrix(df, ["a", "b"]).collect()}
    assert len(got) == 4 and got[("a", "b")] == pytest.approx(1) and got[("b", "a")] == got[("a", "b")]


def test_cooccurrence_against_brute_force(spark, posts):
    terms = ["th", "ou", "er", "eau", "zzz"]
    titles = [r["title"] for r in posts.select("title").collect()]
    want = {}
    for i, a in enumerate(sorted(terms)):
        for b in sorted(terms)[i + 1:]:
            n = sum(a in t and b in t for t in titles)
            if n:
                want[(a, b)] = n
    got = {(r["a"], r["b"]): r["count"] for r in S.term_cooccurrence(posts, "title", terms).collect()}
    assert got == want and got


def test_summaries(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "s double")
    assert rows(S.describe_scores(df, ["s"])) == [("s", 2, 2.0, pytest.approx(2 ** 0.5), 1.0, 3.0)]
    assert [r["summary"] for r in S.score_summary(df, "s").collect()] == ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"]


def test_classifier_is_measured_on_its_own_predictions(spark):
    rng = __import__("random").Random(3)
    data = [(str(i), rng.choice(K.ARTICLE_LABELS), rng.choice(K.ARTICLE_LABELS), Vectors.dense([1 - p, p])) for i in range(200) for p in [round(rng.random(), 1)]]
    predicted = spark.createDataFrame(data, ["id", "label", "predictedMisinfo", "probability"])
    got = {(r["part"], r["measure"]): r["value"] for r in R.classifier_metrics({"a": predicted, "b": predicted.limit(200)}).collect()}
    true = [x[1] == K.PERCEIVED for x in data]
    hard = [x[2] == K.PERCEIVED for x in data]
    score = [float(x[3][1]) for x in data]
    right = sum(t == h for t, h in zip(true, hard)) / 200
    rate = lambda v: sum(h == v for t, h in zip(true, hard) if t == v) / sum(t == v for t in true)
    pairs = [(p > n) + (p == n) / 2 for p, t in zip(score, true) if t for n, u in zip(score, true) if not u]
    want = {"accuracy": right, "error": 1 - right, "auc_of_predictions": (rate(True) + rate(False)) / 2, "auc_of_scores": sum(pairs) / len(pairs)}
    for part in "ab":
        assert {m: v for (p, m), v in got.items() if p == part} == pytest.approx(want)


def test_summary_has_exact_quartiles(spark):
    rng = __import__("random").Random(4)
    values = [rng.randint(-3, 9) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "score long")
    got = {r["summary"]: r["score"] for r in S.score_summary(df).collect()}
    ranked = sorted(values)
    for name, q in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        assert got[name] == str(ranked[-(-int(q * 100) * len(values) // 100) - 1])
    assert (got["count"], got["min"], got["max"]) == ("997", "-3", "9")


def test_exact_quantiles_of_any_values(spark):
    rng = __import__("random").Random(8)
    huge = [2**62 + k for k in (1, 1, 2, 9)]
    many = [rng.gauss(0, 1) * 10 ** rng.randint(-200, 200) for _ in range(800)] + [0.0, -0.0, float("inf"), float("-inf"), 1.75e308, -1.75e308, 1.76e308] * 30
    near = [1 + k * 2.0**-52 for k in range(60)] * 2
    for values, kind in ((huge, "long"), (many, "double"), (near, "double"), ([5], "int"), ([-3, -3, 4, None], "int")):
        df = spark.createDataFrame([(v,) for v in values] + ([(float("nan"),)] if kind == "double" else []), f"s {kind}")
        shares = {str(q): q for q in (0.01, 0.25, 0.5, 0.75, 1.0)}
        known = sorted(v for v in values if v is not None)
        assert S.exact_quantiles(df, "s", shares) == {n: known[max(0, math.ceil(q * len(known)) - 1)] for n, q in shares.items()}
    assert S.exact_quantiles(spark.createDataFrame([(None,)], "s int"), "s", {"a": 0.5}) == {"a": None}
