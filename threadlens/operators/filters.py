"""Row filters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.constants import EXCLUDED_SOURCES


def parse_values(text: str) -> list[str]:
    """'a, b' -> ['a', 'b']."""
    return [v.strip() for v in text.split(",") if v.strip()]


def filter_values(df: DataFrame, col: str, values: str | list[str], case_insensitive: bool = False) -> DataFrame:
    """Rows whose ``col`` is one of ``values`` (a list, or a comma-separated string).

    The plain form reaches the Parquet scan as a pushed filter. Without case both sides are lowered,
    which a scan cannot use.
    """
    wanted = parse_values(values) if isinstance(values, str) else list(values)
    if case_insensitive:
        return df.filter(F.lower(col).isin([v.lower() for v in wanted]))
    return df.filter(F.col(col).isin(wanted))


def drop_missing_source(
    df: DataFrame, url_col: str = "url", source_col: str = "source", excluded=EXCLUDED_SOURCES
) -> DataFrame:
    """Rows with a URL and with a source that is neither empty nor in ``excluded``; NULLs go too."""
    source = F.coalesce(F.col(source_col), F.lit(""))  # named once: the source may be a costly expression
    return df.filter((F.col(url_col) != "") & ~source.isin("", *excluded))


def exclude_containing(df: DataFrame, col: str, substrings) -> DataFrame:
    """Rows whose text holds none of the substrings; NULL texts go, as with any negated test."""
    return df.filter(~reduce(or_, [F.contains(F.col(col), F.lit(s)) for s in substrings]))


def negative_flagged(df: DataFrame, score_col: str = "vader_score", flag_col: str = "misinfo_class") -> DataFrame:
    """Flagged rows with a negative score.

    The flag is tested first, and the score in a form to which Spark adds no test for NULL in front: where
    the score is still an expression, it is computed for flagged rows only and once.
    """
    return df.filter(F.col(flag_col) & F.coalesce(F.col(score_col) < 0, F.lit(False)))


def flagged(df: DataFrame, flag_col: str = "misinfo_class") -> DataFrame:
    """Rows whose flag is TRUE."""
    return df.filter(F.col(flag_col))


def keep(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition holds."""
    for condition in conditions:
        df = df.filter(condition)
    return df


def table_shape(df: DataFrame) -> DataFrame:
    """One row with the number of rows and the number of columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))
