"""Calendar columns and period labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.constants import DAY_NAMES
from threadlens.functions.labels import map_labels


def add_time_columns(df: DataFrame, date_col: str = "date", iso: bool = False) -> DataFrame:
    """Add ``year``, ``month`` and ``week`` of ``date_col``.

    The week is the ISO week. The year is the calendar year, so the last days of December can read
    (2019, week 1); with ``iso=True`` it is the year the ISO week belongs to.
    """
    year = F.extract(F.lit("YEAROFWEEK"), F.col(date_col)) if iso else F.year(date_col)
    return df.withColumns({
        "year": year.cast("int"),
        "month": F.month(date_col),
        "week": F.weekofyear(date_col),
    })


def period_label(year: str | Column, part: str | Column) -> Column:
    """'YYYY/MM' or 'YYYY/WW'; NULL if either number is NULL."""
    year = F.col(year) if isinstance(year, str) else year
    part = F.col(part) if isinstance(part, str) else part
    return F.concat(year.cast("string"), F.lit("/"), F.lpad(part.cast("string"), 2, "0"))


def add_period_labels(df: DataFrame) -> DataFrame:
    """Add ``year_month`` and ``year_week`` next to the columns of :func:`add_time_columns`."""
    return df.withColumns({
        "year_month": period_label("year", "month"),
        "year_week": period_label("year", "week"),
    })


def period_to_date(col: str | Column) -> Column:
    """First day of a 'YYYY/MM' label."""
    col = F.col(col) if isinstance(col, str) else col
    return F.to_date(F.concat(col, F.lit("/01")), "yyyy/MM/dd")


def day_name(col: str | Column) -> Column:
    """Name of a day number, 1 being Sunday."""
    return map_labels(col, DAY_NAMES)
