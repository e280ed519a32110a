"""The jobs from input tables to the reports made of their output."""

from conftest import MEDIUM, rows
from pyspark.sql import functions as F

from threadlens.catalog import views as V
from threadlens.jobs.enrich_comments import enrich
from threadlens.operators.filters import flagged
from threadlens.plans import nlp as N
from threadlens.plans import series as S


def test_enrich_and_report(spark, tmp_path):
    posts, comments = V.posts(spark, MEDIUM), V.comments(spark, MEDIUM)
    table = enrich(spark, posts, comments, V.lexicon(spark, MEDIUM), str(tmp_path / "out"), str(tmp_path / "topics"), min_df=2, max_iter=3)
    assert table.count() == 850
    assert table.select("comment_id").distinct().count() == 850
    years = dict(rows(table.groupBy("year").count()))
    assert years == dict(rows(table.groupBy(F.year("comment_created")).count()))
    assert table.filter("vader_score NOT BETWEEN -1 AND 1").count() == 0
    topics = spark.read.csv(str(tmp_path / "topics"), header=True)
    assert topics.count() == 8 and topics.columns == ["topic", "terms"]

    summary = S.period_summary(table.drop("year"), "month", ts_col="comment_created")
    assert summary.agg(F.sum("comments_count")).first()[0] == 850
    bins = N.sentiment_histogram(table.withColumn("misinfo_class", F.lit(True)))
    assert bins.agg(F.sum("count")).first()[0] == table.filter("vader_score <= 0").count()
    assert flagged(table).count() == table.agg(F.count_if("misinfo_class")).first()[0]


def test_enrich_on_clean_text(spark, tmp_path):
    posts, comments = V.posts(spark, MEDIUM), V.comments(spark, MEDIUM)
    table = enrich(spark, posts, comments, V.lexicon(spark, MEDIUM), str(tmp_path / "out"), wide_phrases=True, clean=True, min_df=2, max_iter=2)
    assert table.filter(F.col("body").rlike("[^a-z0-9\\s]")).count() == 0
    assert table.count() == 850
