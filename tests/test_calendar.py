from conftest import column, rows
from pyspark.sql import functions as F

from threadlens.functions import calendar as C


def days(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "d string").select(F.to_date("d").alias("date")).coalesce(1)


def test_calendar_year_with_iso_week(spark):
    got = rows(C.add_time_columns(days(spark, "2019-12-30", "2021-01-02", "2023-01-01")).select("year", "month", "week"))
    assert got == [(2019, 12, 1), (2021, 1, 53), (2023, 1, 52)]


def test_iso_year(spark):
    got = rows(C.add_time_columns(days(spark, "2019-12-30", "2021-01-02"), iso=True).select("year", "week"))
    assert got == [(2020, 1), (2020, 53)]


def test_labels_and_back(spark):
    df = C.add_period_labels(C.add_time_columns(days(spark, "2022-03-05", None)))
    assert rows(df.select("year_month", "year_week", C.period_to_date("year_month").cast("string"))) == [
        ("2022/03", "2022/09", "2022-03-01"), (None, None, None)]


def test_day_names(spark):
    df = days(spark, "2023-01-01", "2023-01-07")
    assert column(df.select(C.day_name(F.dayofweek("date")))) == ["Sunday", "Saturday"]
    assert column(df.limit(1).select(C.day_name(F.lit(9)))) == [None]
