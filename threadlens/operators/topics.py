"""Vocabulary, document frequencies, and LDA topics of short texts."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import inf

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.constants import TITLE_STOP_WORDS, TOPIC_NAMES, TOPIC_SEEDS
from threadlens.functions.labels import argmax, indices_to_terms, map_labels
from threadlens.functions.text import normalize_tokens, remove_stop_words
from threadlens.operators.ranking import top_k
from threadlens.session import partitions_for


def english_stop_words(extra=TITLE_STOP_WORDS) -> list[str]:
    """Spark's English list with further words."""
    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *extra})


def title_tokens(df: DataFrame, text_col: str, stop_words: list[str] | None = None, out: str = "tokens") -> DataFrame:
    """Normalised words of a text without stop words."""
    words = english_stop_words() if stop_words is None else stop_words
    return remove_stop_words(normalize_tokens(df, text_col, out), out, words)


def vocabulary(df: DataFrame, tokens_col: str, size: int = 5000, min_df: int = 25) -> DataFrame:
    """The ``size`` most frequent terms found in at least ``min_df`` texts: (term, term_count, doc_count).

    A text yields each word once per occurrence and once per text; both counts come out of one partial
    aggregation by term, and no (text, term) table is exchanged.
    """
    said = F.transform(tokens_col, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    seen = F.transform(F.array_distinct(tokens_col), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    counts = (df.select(F.inline(F.concat(said, seen)))
              .groupBy("term").agg(F.sum("n").alias("term_count"), F.sum("d").alias("doc_count"))
              .filter(F.col("doc_count") >= min_df))
    return top_k(counts, ["term_count"], size, "term")


def idf_table(df: DataFrame, tokens_col: str, min_df: int = 0) -> DataFrame:
    """(term, doc_count, idf) with idf = ln((N + 1) / (doc_count + 1)), N being the number of texts."""
    counts = (df.select(F.explode(F.array_distinct(tokens_col)).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("doc_count"))
              .filter(F.col("doc_count") >= min_df))
    texts = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("idf", F.log((texts + 1) / (F.col("doc_count") + 1)))


@dataclass(frozen=True)
class TopicModel:
    """A fitted topic pipeline with what is needed to apply it to new texts."""

    pipeline: PipelineModel
    text_col: str
    stop_words: tuple[str, ...]

    @property
    def vocabulary(self) -> list[str]:
        return self.pipeline.stages[0].vocabulary

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its tokens and ``topicDistribution``; a row-by-row step."""
        return self.pipeline.transform(title_tokens(df, self.text_col, list(self.stop_words)))


def fit_topics(
    df: DataFrame, text_col: str = "title", k: int = 8, max_iter: int = 20, seed: int = 13, vocab_size: int = 5000,
    min_df: int = 25, stop_words: list[str] | None = None, id_col: str = "id", partitions: int | None = None, batch_share: float = 1.0,
) -> TopicModel:
    """Fit count vectors, IDF and LDA on the texts.

    Every step of LDA sees ``batch_share`` of the texts; with 1.0 all of them count in each step.

    LDA depends on how rows are spread and on the order of the vocabulary, not only on its seed. So the
    tokens are placed by id and ordered inside each partition, and terms of equal frequency are ordered by
    name. The tokens are kept (memory, then disk) while the stages pass over them; the vocabulary, at most
    ``vocab_size`` terms, is what a count vectorizer too brings to the driver.
    """
    words = english_stop_words() if stop_words is None else list(stop_words)
    texts = df.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    partitions = partitions or partitions_for(texts)
    tokens = (title_tokens(texts, text_col, words)
              .select(id_col, "tokens").repartition(partitions, id_col).sortWithinPartitions(id_col)
              .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        terms = [r["term"] for r in vocabulary(tokens, "tokens", vocab_size, min_df).collect()]
        if not terms:
            raise ValueError(f"no term occurs in {min_df} texts")
        model = Pipeline(stages=[
            CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="raw_features"),
            IDF(inputCol="raw_features", outputCol="features"),
            LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="features", subsamplingRate=batch_share),
        ]).fit(tokens)
    finally:
        tokens.unpersist()
    return TopicModel(model, text_col, tuple(words))


def describe_topics(model: TopicModel, max_terms: int = 10) -> DataFrame:
    """(topic, terms, weights): the heaviest terms of every topic."""
    topics = model.pipeline.stages[-1].describeTopics(max_terms)
    return topics.select("topic", indices_to_terms("termIndices", model.vocabulary).alias("terms"),
                         F.col("termWeights").alias("weights"))


def topic_weights(model: TopicModel) -> DataFrame:
    """(topic, term, weight): the weight of every term of the vocabulary in every topic."""
    topics = describe_topics(model, len(model.vocabulary))
    return topics.select("topic", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))))


def seed_scores(weights: DataFrame, seeds: dict[str, list[str]] = TOPIC_SEEDS) -> DataFrame:
    """(topic, name, score): how much of a name's seed words belongs to each topic.

    A word belongs to a topic by the topic's share of it, with all topics given the same total weight, so common
    words count no more than rare ones; a word that stands in several seed lists is divided among them. Seed words
    that no topic knows count nothing; a pair without a common word scores 0.
    """
    lists = [(name, word) for name, words in seeds.items() for word in dict.fromkeys(words)]
    uses = Counter(word for _, word in lists)
    told = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(word).alias("term"), F.lit(1.0 / uses[word]).alias("part")) for name, word in lists])
    totals = weights.groupBy("topic").agg(F.sum("weight").alias("_total"))
    shares = (weights.where(F.col("term").isin(list(uses))).groupBy("topic", "term").agg(F.sum("weight").alias("weight"))
              .join(totals, "topic").withColumn("share", F.try_divide("weight", "_total")))
    whole = shares.groupBy("term").agg(F.sum("share").alias("_whole"))
    owned = shares.join(whole, "term").withColumn("owned", F.try_divide("share", "_whole"))
    words = F.broadcast(totals.limit(1).select(F.inline(told)))  # the seed lists
    scores = owned.join(words, "term").groupBy("topic", "name").agg(F.sum(F.col("owned") * F.col("part")).alias("score"))
    every = totals.select("topic", F.explode(F.array(*[F.lit(n) for n in seeds])).alias("name"))
    return every.join(scores, ["topic", "name"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_assignment(scores: list[list[float]]) -> list[int]:
    """For every row a column of its own so that the sum of the scores is the largest (as many columns as rows).

    Shortest augmenting paths with potentials: cubic in the number of rows.
    """
    n = len(scores)
    row_price, column_price = [0.0] * n, [0.0] * n
    owner = [-1] * n
    for row in range(n):
        least, came, done = [inf] * n, [-1] * n, [False] * n
        column, at = -1, row
        while True:
            for c in range(n):
                if not done[c]:
                    slack = -scores[at][c] - row_price[at] - column_price[c]
                    if slack < least[c]:
                        least[c], came[c] = slack, column
            nearest = min((c for c in range(n) if not done[c]), key=lambda c: least[c])
            step = least[nearest]
            row_price[row] += step
            for c in range(n):
                if done[c]:
                    row_price[owner[c]] += step
                    column_price[c] -= step
                else:
                    least[c] -= step
            done[nearest], column = True, nearest
            if owner[nearest] < 0:
                break
            at = owner[nearest]
        while column >= 0:
            owner[column] = owner[came[column]] if came[column] >= 0 else row
            column = came[column]
    return [owner.index(row) for row in range(n)]


def match_topics(weights: DataFrame, seeds: dict[str, list[str]] = TOPIC_SEEDS) -> dict[int, str]:
    """Names for fitted topics: the one-to-one choice of names that gives the largest sum of :func:`seed_scores`.

    Only topics times names numbers come to the driver. With more topics than names the rest stay without; with more names
    than topics some are not used.
    """
    found = {(r["topic"], r["name"]): r["score"] for r in seed_scores(weights, seeds).collect()}
    topics, names = sorted({t for t, _ in found}), list(seeds)
    size = max(len(topics), len(names))
    square = [[found.get((t, n), 0.0) for n in names] + [0.0] * (size - len(names)) for t in topics]
    square += [[0.0] * size for _ in range(size - len(topics))]
    taken = best_assignment(square)
    return {t: names[c] for t, c in zip(topics, taken) if c < len(names)}


def assign_topic(model: TopicModel, df: DataFrame, names: dict[int, str] = TOPIC_NAMES) -> DataFrame:
    """``df`` with ``topic_num`` and ``topic`` of every text; NULL where there is no text or no known word in it.

    ``names`` are those of the model's topic numbers; after a new fit take them from :func:`match_topics`.
    The columns of ``df`` stay, so the posts need no join back to themselves; the vectors do not.
    """
    texts = df.withColumn("_given", F.col(model.text_col)).withColumn(model.text_col, F.coalesce(model.text_col, F.lit("")))
    scored = model.transform(texts).withColumn(model.text_col, F.col("_given"))
    share = vector_to_array("topicDistribution")
    number = F.when(F.array_max(share) > 0, argmax(share))
    return scored.select(*df.columns, number.alias("topic_num")).withColumn("topic", map_labels("topic_num", names))
