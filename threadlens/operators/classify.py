"""Article labels, the logistic-regression classifier, and its evaluation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.constants import ARTICLE_LABELS, NOT_PERCEIVED, PERCEIVED
from threadlens.functions.labels import count_if, flag_to_int, label_by_count
from threadlens.operators.ranking import running_totals


def label_articles(facts: DataFrame) -> DataFrame:
    """Flagged comments per article and the label that follows from their number."""
    return (facts.groupBy("id").agg(F.sum(flag_to_int("misinfo_class")).alias("true_count"))
            .withColumn("label", label_by_count("true_count", PERCEIVED, NOT_PERCEIVED)))


def label_index(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Add the index of a label: 0 for the most frequent, ties in alphabetical order."""
    return StringIndexer(inputCol=col, outputCol=out or f"{col}_index", handleInvalid="keep").fit(df).transform(df)


def index_to_label(df: DataFrame, col: str, out: str, labels=ARTICLE_LABELS) -> DataFrame:
    """Add the label of an index, in the order given."""
    return IndexToString(inputCol=col, outputCol=out, labels=list(labels)).transform(df)


def fit_classifier(
    df: DataFrame, label_col: str = "label", features: list[str] = (), topic_col: str = "topic", max_iter: int = 10,
    labels=ARTICLE_LABELS,
) -> PipelineModel:
    """Logistic regression on the one-hot topic and the given 0/1 columns.

    The label index follows ``labels``, so that prediction 0 always means the first of them, whichever
    class is more frequent in the sample.
    """
    names = list(labels)
    stages = [
        StringIndexerModel.from_labels(names, inputCol=label_col, outputCol="label_index"),
        StringIndexer(inputCol=topic_col, outputCol="topic_ix", handleInvalid="keep"),
        OneHotEncoder(inputCols=["topic_ix"], outputCols=["topic_vec"], handleInvalid="keep"),
        VectorAssembler(inputCols=["topic_vec", *features], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_index", maxIter=max_iter),
        IndexToString(inputCol="prediction", outputCol="predictedMisinfo", labels=names),
    ]
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def accuracy(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """One row with the share of right predictions and of wrong ones."""
    right = F.avg((F.col(label_col) == F.col(pred_col)).cast("double"))
    return df.agg(right.alias("accuracy")).select("accuracy", (1 - F.col("accuracy")).alias("error"))


def auc_of_predictions(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """Area under the ROC of hard 0/1 predictions: the mean of true-positive and true-negative rate."""
    label, pred = F.col(label_col), F.col(pred_col)

    def rate(value: int) -> Column:
        return F.try_divide(count_if((label == value) & (pred == value)), count_if(label == value))

    return df.agg(((rate(1) + rate(0)) / 2).alias("auc"))


def auc(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """Exact area under the ROC of scores: the chance that a positive outranks a negative, ties counting half."""
    label = F.col(label_col)
    positives, negatives = count_if(label == 1), count_if(label == 0)
    below = running_totals(df, score_col, {"_p": positives, "_n": negatives}).select(score_col, "_n")
    here = df.groupBy(score_col).agg(positives.alias("pos"), negatives.alias("neg"))
    won = F.col("pos") * (F.col("_n") - F.col("neg") + F.col("neg") / 2)
    return here.join(below, score_col).agg(
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))
