"""Title clusters: hashed TF-IDF and topic, k-means, two principal components."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.constants import UNCLUSTERED_TOPICS
from threadlens.functions.text import tokenize
from threadlens.operators.filters import exclude_containing
from threadlens.session import partitions_for


def title_features(topic_col: str = "topic", buckets: int = 1000, normalize: bool = False) -> list:
    """Stages from ``words`` and a topic to the vector ``features_combined``."""
    combined = "features_assembled" if normalize else "features_combined"
    stages = [
        HashingTF(inputCol="words", outputCol="raw_features", numFeatures=buckets),
        IDF(inputCol="raw_features", outputCol="features_tfidf"),
        StringIndexer(inputCol=topic_col, outputCol="topic_ix", handleInvalid="keep"),
        OneHotEncoder(inputCols=["topic_ix"], outputCols=["topic_vec"], handleInvalid="keep"),
        VectorAssembler(inputCols=["features_tfidf", "topic_vec"], outputCol=combined),
    ]
    return [*stages, Normalizer(inputCol=combined, outputCol="features_combined")] if normalize else stages


def cluster_titles(
    df: DataFrame, k: int = 5, seed: int = 13, text_col: str = "title", topic_col: str = "topic", id_col: str = "id",
    excluded_topics=UNCLUSTERED_TOPICS, buckets: int = 1000, max_iter: int = 20, normalize: bool = False,
) -> DataFrame:
    """(id, cluster, x, y) for every title whose topic is not excluded.

    The words are placed by id and ordered inside each partition, so a run repeats with the same seed; they
    are kept while the models pass over them. The result is computed from the models, row by row.
    """
    rows = exclude_containing(df.select(id_col, text_col, topic_col), topic_col, excluded_topics)
    rows = rows.filter(F.col(text_col).isNotNull())
    words = (tokenize(rows, text_col, "words").select(id_col, topic_col, "words")
             .repartition(partitions_for(rows), id_col).sortWithinPartitions(id_col).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        model = Pipeline(stages=[
            *title_features(topic_col, buckets, normalize),
            KMeans(featuresCol="features_combined", predictionCol="cluster", k=k, seed=seed, maxIter=max_iter),
            PCA(k=2, inputCol="features_combined", outputCol="features_pca"),
        ]).fit(words)
    finally:
        words.unpersist()
    place = vector_to_array("features_pca")
    return model.transform(words).select(id_col, "cluster", F.get(place, F.lit(0)).alias("x"), F.get(place, F.lit(1)).alias("y"))
