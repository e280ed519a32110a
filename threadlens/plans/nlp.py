"""Topics, comments under topics, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.constants import MISINFO_PHRASES
from threadlens.functions.text import clean_text, flag_phrases
from threadlens.operators import aggregates as A
from threadlens.operators.filters import flagged
from threadlens.operators.joins import comment_counts_by_post, join_posts_comments
from threadlens.operators.sentiment import ValenceRules, score_both
from threadlens.sources.readers import read_table
from threadlens.sources.sinks import write_by_year

HISTOGRAM_EDGES = [i / 10 - 1 for i in range(11)]


def enriched_comments(
    topic_posts: DataFrame, comments: DataFrame, lexicon: DataFrame, phrases=MISINFO_PHRASES, clean: bool = False,
    rules: ValenceRules = ValenceRules(),
) -> DataFrame:
    """One row per comment: its post's title and topic, its flag and both sentiment scores.

    Flag and scores are made before the join: scoring is a row-by-row step on the scan, and the tasks of a
    scan are of even size, while those after a join are not. ``clean`` strips the text first.
    """
    rows = clean_text(comments) if clean else comments
    if clean:
        rules = ValenceRules(rules.negators, rules.strengtheners, rules.weakeners, rules.contrast, emphasis=False)
    rows = flag_phrases(rows, "body", phrases)
    rows = score_both(rows, "body", lexicon, rules)
    mini = topic_posts.select("id", "created_utc", "title", "topic")
    return join_posts_comments(mini, rows, "misinfo_class", "vader_score", "textblob_score")


def save_enriched(enriched: DataFrame, path: str, rebalance: bool = False) -> DataFrame:
    """Write the enriched comments by year of the comment and return the table read back.

    Reports that follow read columns from here and never repeat the join or the scoring. The tasks of the
    join write their rows as they are; ``rebalance`` trades a further exchange of all texts for fewer files.
    """
    write_by_year(enriched, "comment_created", path, rebalance)
    return read_table(enriched.sparkSession, path)


def _per_topic(topic_posts: DataFrame, comments: DataFrame) -> DataFrame:
    per_post = comment_counts_by_post(comments)
    joined = topic_posts.select("id", "topic").join(per_post, "id")
    return joined.groupBy("topic").agg(F.sum("comments").alias("comments"), F.sum("true_count").alias("hits"))


def topic_counts(topic_posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments per topic. Comments are counted per post before they meet the posts."""
    return _per_topic(topic_posts, comments).select("topic", F.col("comments").alias("count"))


def topic_misinfo_counts(topic_posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Flagged comments per topic."""
    hits = _per_topic(topic_posts, comments).select("topic", F.col("hits").alias("count"))
    return hits.filter(F.col("count") > 0)


def topic_misinfo_total(topic_posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments per topic and flag."""
    both = _per_topic(topic_posts, comments)
    rows = F.array(
        F.struct(F.lit(True).alias("misinfo_class"), F.col("hits").alias("count")),
        F.struct(F.lit(False).alias("misinfo_class"), (F.col("comments") - F.col("hits")).alias("count")))
    return both.select("topic", F.inline(rows)).filter(F.col("count") > 0)


def negative_share_by_topic(enriched: DataFrame, threshold: float = -0.8) -> DataFrame:
    """Share of the flagged comments of a topic whose score lies under ``threshold``."""
    return A.share_below(flagged(enriched), "topic", "vader_score", threshold)


def sentiment_histogram(enriched: DataFrame) -> DataFrame:
    """Flagged comments per tenth of the negative half of the score range."""
    return A.binned_histogram(A.score_histogram(flagged(enriched)), "vader_score", "count", HISTOGRAM_EDGES)
