"""Sources, authors, activity and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.constants import MISINFO_PHRASES, SOURCE_ALIASES
from threadlens.functions.labels import with_thousands
from threadlens.functions.text import flag_phrases, news_source
from threadlens.operators import aggregates as A
from threadlens.operators.filters import drop_missing_source
from threadlens.operators.joins import weekday_activity
from threadlens.operators.ranking import rank_max, top_k, top_n_per_group
from threadlens.operators.stats import score_summary


def sourced_posts(posts: DataFrame) -> DataFrame:
    """Posts that point at a news source, with the ``source``."""
    return drop_missing_source(posts.withColumn("source", news_source("url")))


def top_sources(posts: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` sources with most posts, then most score."""
    return top_k(A.source_totals(sourced_posts(posts)), ["frequency", "total_score"], n, "source")


def top_sources_per_community(posts: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` first sources of every community with their rank."""
    totals = A.source_totals(sourced_posts(posts), ["source", "subreddit"])
    return top_n_per_group(totals, "subreddit", ["frequency", "total_score"], n, "source")


def source_rankings(
    posts: DataFrame, by: str = "frequency", top: int = 100, shown: int = 10, aliases: dict[str, str] = SOURCE_ALIASES
) -> DataFrame:
    """The first ``shown`` of the ``top`` sources by frequency or score, with their rank by the other measure.

    The ranks are taken inside the list of ``top`` sources, so one small window is enough.
    """
    names = {"frequency": ("score rank", "total_score"), "total_score": ("frequency rank", "frequency")}
    rank_name, rank_col = names[by]
    listed = A.merge_aliases(top_sources(posts, top), "source", aliases, ["frequency", "total_score"])
    ranked = listed.withColumn(rank_name, rank_max(rank_col))
    first = top_k(ranked, [by], shown, "source")
    return first.select(
        "source", with_thousands("frequency").alias("frequency"),
        with_thousands("total_score").alias("karma_score"), rank_name)


def top_authors(posts: DataFrame, community: str, min_count: int = 5000, n: int = 11, skip: int = 0) -> DataFrame:
    """The busiest authors of a community; ``skip=1`` leaves out the first, usually ``[deleted]``."""
    inside = posts.filter(F.col("subreddit") == community)
    return top_k(A.active_authors(inside, min_count), ["submission_count"], n, "author", skip)


def activity_by_year(rows: DataFrame) -> DataFrame:
    """Posts or comments per year."""
    return A.count_by_calendar(rows, "created_utc", "year").orderBy("year")


def activity_by_weekday(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments and posts per day of the week."""
    return weekday_activity(comments, posts)


def phrase_counts(comments: DataFrame, phrases=MISINFO_PHRASES) -> DataFrame:
    """Comments with and without a phrase, and their percentage."""
    return A.share_of_total(A.count_by(flag_phrases(comments, "body", phrases), "misinfo_class"), "count")


def phrase_hits(comments: DataFrame, phrases=MISINFO_PHRASES) -> DataFrame:
    """Comments per phrase."""
    return A.phrase_hits(comments, "body", phrases)


def misinfo_rate_by_year(comments: DataFrame, phrases=MISINFO_PHRASES) -> DataFrame:
    """Share of flagged comments per year."""
    flagged = flag_phrases(comments, "body", phrases)
    return A.flag_rate(flagged, "misinfo_class", F.year("created_utc").alias("year"))


def comment_score_summary(comments: DataFrame) -> DataFrame:
    """Summary of the comment scores."""
    return score_summary(comments, "score")
