"""Article labels, the balanced sample, the classifier's reports, title clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.constants import ARTICLE_LABELS, NOT_PERCEIVED, PERCEIVED, TITLE_TERMS
from threadlens.functions.labels import label_by_count
from threadlens.functions.text import term_dummies
from threadlens.operators import aggregates as A
from threadlens.operators.classify import accuracy, auc, auc_of_predictions, fit_classifier
from threadlens.operators.cluster import cluster_titles
from threadlens.operators.joins import comment_counts_by_post
from threadlens.operators.reshape import hash_split, undersample, unpivot_measures
from threadlens.sources.sinks import store

WRONG = ["incorrectly labeled as misinfo", "incorrectly labeled as no misinfo"]


def article_labels(topic_posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(id, true_count, label, title, topic) of every post with a comment.

    The flagged comments are summed per post first, so the post table is joined once, row to row; no
    comment-sized table is de-duplicated.
    """
    counts = comment_counts_by_post(comments).select("id", "true_count")
    labelled = counts.withColumn("label", label_by_count("true_count", PERCEIVED, NOT_PERCEIVED))
    return labelled.join(topic_posts.select("id", "title", "topic").distinct(), "id")


def label_counts(articles: DataFrame) -> DataFrame:
    """Articles per label."""
    return A.count_by(articles, "label")


def balanced_sample(articles: DataFrame, fraction: float = 0.25) -> DataFrame:
    """All perceived-misinformation articles and a fraction of the others."""
    return undersample(articles, "label", NOT_PERCEIVED, fraction, "id")


def classified_articles(sample: DataFrame, terms=TITLE_TERMS, max_iter: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, test and validation part with the predictions of a classifier fitted on the first.

    The sample has one row per article. It is stored before the fit, so that the passes of the fit and the
    three parts read that table and not the comments behind it.
    """
    features = store(term_dummies(sample, "title", terms), "article-features")
    parts = hash_split(features, "id", [0.8, 0.18, 0.02])
    model = fit_classifier(parts[0], "label", list(dict.fromkeys(terms)), max_iter=max_iter)
    return tuple(model.transform(p) for p in parts)


def classifier_metrics(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, measure, value): accuracy, error, and the ROC areas of the predictions and of the scores, for each part.

    ``parts`` are predicted articles by name, such as the training and the test part. The score is the probability of
    perceived misinformation.
    """
    place = list(ARTICLE_LABELS).index(PERCEIVED)
    out = []
    for name, predicted in parts.items():
        rows = predicted.select(
            (F.col("label") == PERCEIVED).cast("int").alias("label"), (F.col("predictedMisinfo") == PERCEIVED).cast("int").alias("hard"),
            F.get(vector_to_array("probability"), F.lit(place)).alias("score"))
        measures = [accuracy(rows, "label", "hard"), auc_of_predictions(rows, "label", "hard").withColumnRenamed("auc", "auc_of_predictions"),
                    auc(rows, "label", "score").withColumnRenamed("auc", "auc_of_scores")]
        for wide in measures:
            out.append(wide.select(F.lit(name).alias("part"), F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in wide.columns]))))
    return reduce(DataFrame.unionByName, out)


def classifier_report(predicted: DataFrame) -> DataFrame:
    """Right and wrong predictions per topic."""
    return A.prediction_analysis(predicted)


def wrong_predictions(report: DataFrame) -> DataFrame:
    """The two kinds of wrong predictions per topic with their share of the topic's wrong ones."""
    return A.share_of_total(store(unpivot_measures(report, "topic", WRONG), "wrong-predictions"), "value", "topic")


def title_clusters(articles: DataFrame, k: int = 5, seed: int = 13) -> DataFrame:
    """(id, cluster, x, y) of every article whose topic is clustered."""
    return cluster_titles(articles, k, seed)
