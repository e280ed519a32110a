"""Weekly and monthly series of the discussion and of external daily data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.constants import EPIDEMIOLOGY_MEASURES, VACCINATION_MEASURES
from threadlens.functions.calendar import add_period_labels, add_time_columns, period_label, period_to_date
from threadlens.functions.labels import strip_prefix, zero_to_null
from threadlens.operators import aggregates as A
from threadlens.operators.joins import comment_counts_by_post, join_series, outer_join_series
from threadlens.operators.stats import correlation_matrix, series_regression

DISCUSSION_MEASURES = ("comments_count", "misinfo_count")


def with_periods(df: DataFrame, ts_col: str) -> DataFrame:
    """``df`` with year, month, week and both period labels."""
    return add_period_labels(add_time_columns(df, ts_col))


def period_counts(facts: DataFrame, grain: str, ts_col: str = "created_utc") -> DataFrame:
    """Comments per ``week`` or ``month`` of their post (or of another time column)."""
    return A.period_counts(with_periods(facts, ts_col), f"year_{grain}")


def period_misinfo_counts(facts: DataFrame, grain: str, ts_col: str = "created_utc") -> DataFrame:
    """Flagged comments per period."""
    return A.period_counts(with_periods(facts, ts_col), f"year_{grain}", flagged_only=True)


def commented_period_counts(posts: DataFrame, comments: DataFrame, grain: str, flagged_only: bool = False) -> DataFrame:
    """Comments, or flagged comments, per period of their post, from both tables.

    Comments are counted per post before the join, so neither the exchange nor the join sees a busy post.
    """
    number = "true_count" if flagged_only else "comments"
    per_post = posts.select("id", "created_utc").join(comment_counts_by_post(comments).filter(F.col(number) > 0), "id")
    return with_periods(per_post, "created_utc").groupBy(f"year_{grain}").agg(F.sum(number).alias("count"))


def period_post_counts(posts: DataFrame, grain: str) -> DataFrame:
    """Posts per period."""
    return A.period_counts(with_periods(posts, "created_utc"), f"year_{grain}")


def period_summary(enriched: DataFrame, grain: str, misinfo_only: bool = False, ts_col: str = "created_utc") -> DataFrame:
    """Score sums and distinct posts and comments per (year, ``grain``)."""
    return A.period_summary(add_time_columns(enriched, ts_col), ["year", grain], misinfo_only)


def epidemiology_rollup(daily: DataFrame, grain: str) -> DataFrame:
    """Cases and deaths per (year, ``grain``)."""
    return A.rollup_sums(add_time_columns(daily), EPIDEMIOLOGY_MEASURES, grain)


def vaccination_rollup(daily: DataFrame, grain: str) -> DataFrame:
    """Vaccinations per (year, ``grain``)."""
    return A.rollup_sums(add_time_columns(daily), VACCINATION_MEASURES, grain)


def covid_joined(epidemiology: DataFrame, vaccinations: DataFrame, grain: str) -> DataFrame:
    """Both roll-ups side by side; a period that only one of them has stays."""
    return outer_join_series(epidemiology_rollup(epidemiology, grain), vaccination_rollup(vaccinations, grain), ["year", grain])


def covid_series(epidemiology: DataFrame, vaccinations: DataFrame) -> DataFrame:
    """The monthly series for plotting: first day of the month, short names, zeros as gaps."""
    monthly = covid_joined(epidemiology, vaccinations, "month")
    dated = monthly.withColumn("date", period_to_date(period_label("year", "month"))).drop("year", "month")
    short = strip_prefix(dated, "sum_new_")
    measures = [c for c in short.columns if c != "date"]
    return zero_to_null(short, measures).select("date", *measures)


def discussion_series(comments: DataFrame, grain: str, ts_col: str = "created_utc") -> DataFrame:
    """Comments and flagged comments per (year, ``grain``)."""
    return add_time_columns(comments, ts_col).groupBy("year", grain).agg(
        F.count(F.lit(1)).alias("comments_count"), F.count_if("misinfo_class").alias("misinfo_count"))


def joined_series(comments: DataFrame, epidemiology: DataFrame, vaccinations: DataFrame, grain: str) -> DataFrame:
    """Discussion and external measures of the periods both have."""
    return join_series(discussion_series(comments, grain), covid_joined(epidemiology, vaccinations, grain), ["year", grain])


def series_measures() -> list[str]:
    """Every measure of :func:`joined_series`."""
    return [*DISCUSSION_MEASURES, *(f"sum_{c}" for c in EPIDEMIOLOGY_MEASURES + VACCINATION_MEASURES)]


def series_correlation(series: DataFrame) -> DataFrame:
    """Correlation of every pair of measures."""
    return correlation_matrix(series, series_measures())


def misinfo_regression(series: DataFrame) -> DataFrame:
    """How well the external measures explain the number of flagged comments."""
    return series_regression(series, "misinfo_count", [m for m in series_measures() if m.startswith("sum_")])
