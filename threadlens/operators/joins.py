"""Equi-joins. Catalyst and AQE choose the strategy from measured sizes; none is forced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.calendar import day_name
from threadlens.functions.text import post_id
from threadlens.operators.aggregates import weekday_counts


def comment_columns(comments: DataFrame, *extra: str) -> DataFrame:
    """Comments under the post's ``id``, with their own id and time as ``comment_id``, ``comment_created``."""
    return comments.select(
        F.col("created_utc").alias("comment_created"), "body", *extra,
        F.col("id").alias("comment_id"), post_id("link_id").alias("id"),
    )


def join_posts_comments(posts: DataFrame, comments: DataFrame, *extra: str) -> DataFrame:
    """One row per comment with its post's columns; comments without a known post drop out.

    Comments whose link names no post (an empty id) go before the exchange. ``extra`` names further comment columns to keep. A post with very many comments makes one large
    partition on the comment side only; AQE splits it and repeats the few post rows per piece.
    """
    return posts.join(comment_columns(comments, *extra).filter(F.col("id") != ""), "id")


def comment_counts_by_post(comments: DataFrame, flag_col: str = "misinfo_class") -> DataFrame:
    """Comments and flagged comments per post, from the comment table alone.

    Summing before the join shrinks a busy post to one row per map task, so neither the exchange nor
    the join sees its size.
    """
    return comments.groupBy(post_id("link_id").alias("id")).agg(
        F.count(F.lit(1)).alias("comments"),
        F.count_if(F.col(flag_col)).alias("true_count"),
    )


def join_saved_topics(topics: DataFrame, comments: DataFrame) -> DataFrame:
    """Saved topic rows and freshly cleaned comments, matched on comment and post id.

    The text, flag and times of the saved rows give way to those of ``comments``.
    """
    stale = [c for c in ("body", "created_utc", "misinfo_class", "comment_created") if c in topics.columns]
    fresh = comments.select(
        "created_utc", "body", "misinfo_class", F.col("created_utc").alias("comment_created"),
        F.col("id").alias("comment_id"), post_id("link_id").alias("id"),
    )
    return topics.drop(*stale).join(fresh, ["comment_id", "id"])


def outer_join_series(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All periods of both series; the measures of an absent side are NULL."""
    return left.join(right, keys, "full_outer")


def join_series(discussion: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """Periods that both series have."""
    return discussion.join(external, keys)


def weekday_activity(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments and posts per day of the week, by day number, with the day's name."""
    per_day = weekday_counts(comments, "created_utc", "comments_count").join(
        weekday_counts(posts, "created_utc", "submissions_count"), "day")
    return (per_day.orderBy("day")
            .select(day_name("day").alias("day"), "comments_count", "submissions_count"))


def attach_titles(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """Article labels with title and topic, one row per article.

    ``facts`` has one row per comment; its (id, title, topic) are made distinct before the join, so the
    join does not fan out again to one row per comment.
    """
    return labels.join(facts.select("id", "title", "topic").distinct(), "id")
