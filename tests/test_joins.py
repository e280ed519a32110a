from conftest import MEDIUM, rows
from pyspark.sql import functions as F

from threadlens.catalog import views as V
from threadlens.operators import joins as J
from threadlens.operators import skew
from threadlens.operators.classify import label_articles
from threadlens.plans import articles as R
from threadlens.plans import nlp as N
from threadlens.plans import series as S


def test_comments_without_a_post_drop_out(spark):
    posts = spark.createDataFrame([("a", "title")], "id string, title string")
    comments = spark.sql("SELECT * FROM VALUES ('c1', 't3_a', 'x', 1L), ('c2', 't3_b', 'y', 2L), ('c3', 't1_a', 'z', 3L) t(id, link_id, body, created_utc)")
    assert rows(J.join_posts_comments(posts, comments)) == [("a", "title", 1, "x", "c1")]


def test_missing_side_stays_null(spark):
    a = spark.createDataFrame([(2020, 1, 5), (2020, 2, 6)], "year int, week int, n int")
    b = spark.createDataFrame([(2020, 2, 7), (2020, 3, 8)], "year int, week int, m int")
    assert sorted(rows(J.outer_join_series(a, b, ["year", "week"]))) == [(2020, 1, 5, None), (2020, 2, 6, 7), (2020, 3, None, 8)]
    assert rows(J.join_series(a, b, ["year", "week"])) == [(2020, 2, 6, 7)]


def test_labels_from_counts_equal_labels_from_facts(spark):
    facts = V.facts(spark, MEDIUM)
    slow = J.attach_titles(label_articles(facts), facts)
    fast = R.article_labels(V.posts_with_topic(spark, MEDIUM), V.flagged_comments(spark, MEDIUM))
    assert sorted(rows(slow)) == sorted(rows(fast.select(*slow.columns)))


def test_totals_agree_across_reports(spark):
    """One number of joined comments, however they are counted; the join drops those without a post."""
    posts, comments = V.posts_with_topic(spark, MEDIUM), V.flagged_comments(spark, MEDIUM)
    facts = V.facts(spark, MEDIUM)

    def total(df):
        return df.agg(F.sum("count")).first()[0]

    joined = facts.count()
    assert joined == 850 and comments.count() == 1000
    assert total(N.topic_counts(posts, comments)) == joined
    assert total(N.topic_misinfo_total(posts, comments)) == joined
    assert total(S.period_counts(facts, "week")) == total(S.period_counts(facts, "month")) == joined
    flagged = facts.filter("misinfo_class").count()
    assert total(N.topic_misinfo_counts(posts, comments)) == flagged
    assert total(S.period_misinfo_counts(facts, "week")) == flagged


def test_hot_post_is_split(spark, monkeypatch):
    """A post with a third of the comments: AQE cuts its partition into pieces."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000",
    }
    # One salt only, to see that AQE can still split what the salts leave together.
    monkeypatch.setattr(skew, "_SALTS", 1)
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        posts = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
        comments = spark.range(60000).repartition(6).select(
            F.concat(F.lit("c"), "id").alias("id"),
            F.concat(F.lit("t3_"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3000)).alias("link_id"),
            F.sha2(F.col("id").cast("string"), 512).alias("body"), F.current_timestamp().alias("created_utc"))
        for joined in (
            J.join_posts_comments(posts, comments),
            skew.join_unique(comments, comments.groupBy("link_id").agg(F.count(F.lit(1)).alias("n")), "link_id"),
        ):
            assert len(joined.collect()) == 60000
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "skewed" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
