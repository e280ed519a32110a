import pytest
from conftest import rows
from pyspark.sql import functions as F

from threadlens import schemas
from threadlens.sources.checked import quarantine, read_checked_csv, reason_counts, required

LINES = [
    "date,new_confirmed,new_deceased", "2021-01-01,5,1", "2021-01-02,x,1", "2021-01-03,7", "2021-01-04,8,2,9", "yesterday,1,1",
    "2021-01-05,,3", ",4,4", "2021-01-06,-2,0", '2021-01-07,"9",',
]


@pytest.fixture
def broken(tmp_path):
    (tmp_path / "daily.csv").write_text("\n".join(LINES) + "\n")
    return str(tmp_path)


def test_a_broken_csv_gives_good_rows_and_a_table_of_bad_ones(spark, broken):
    rules = {**required("date"), "negative": F.coalesce(F.col("new_confirmed") >= 0, F.lit(True))}
    good, bad = read_checked_csv(spark, broken, schemas.EPIDEMIOLOGY, rules)
    assert good.schema == schemas.EPIDEMIOLOGY
    assert sorted((str(d), c, n) for d, c, n in rows(good)) == [("2021-01-01", 5, 1), ("2021-01-05", None, 3), ("2021-01-07", 9, None)]
    assert sorted(r.line for r in bad.collect() if r.line) == sorted(LINES[2:6])
    assert dict(rows(reason_counts(bad))) == {"malformed": 4, "date missing": 1, "negative": 1}


def test_a_line_is_bad_whatever_columns_are_read(spark, broken):
    good, bad = read_checked_csv(spark, broken, schemas.EPIDEMIOLOGY)
    assert good.count() == good.select("date").count() == good.select("new_deceased").count() == len(good.collect()) == 5
    assert bad.count() == bad.select("reasons").count() == 4


def test_every_row_is_in_one_of_the_two(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (None, None), (1, "a")], "id int, name string")
    good, bad = quarantine(df, {**required("id", "name"), "small": F.col("id") < 2})
    assert rows(good) == [(1, "a"), (1, "a")]
    assert {(r.id, r.name): r.reasons for r in bad.collect()} == {
        (2, None): ["name missing", "small"], (None, "b"): ["id missing", "small"], (None, None): ["id missing", "name missing", "small"]}
    good, bad = quarantine(df, {})
    assert good.count() == 5 and bad.count() == 0
    assert reason_counts(quarantine(df.limit(0), required("id"))[1]).count() == 0
    with pytest.raises(ValueError):
        quarantine(df.withColumn("reasons", F.lit(1)), required("id"))
