import pytest
from conftest import rows
from pyspark.sql import functions as F

from threadlens import schemas, session
from threadlens.jobs import filter_table as job
from threadlens.session import drop_scratch, scratch_path
from threadlens.sources import readers as I
from threadlens.sources import sinks as O


def dated(spark, *stamps):
    return spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "n int, s string").select("n", F.to_timestamp("s").alias("ts"))


def test_year_sink_replaces_only_years_it_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    O.write_by_year(dated(spark, "2021-05-01", "2022-05-01"), "ts", path)
    O.write_by_year(dated(spark, "2022-06-01", "2022-07-01"), "ts", path, rebalance=True, only_years=True)
    assert dict(rows(I.read_table(spark, path).groupBy("year").count())) == {2021: 1, 2022: 2}


def test_year_sink_replaces_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    O.write_by_year(dated(spark, "2021-05-01", "2022-05-01"), "ts", path)
    O.write_by_year(dated(spark, "2022-06-01"), "ts", path)
    assert dict(rows(I.read_table(spark, path).groupBy("year").count())) == {2022: 1}


class Bare:
    """What ``scratch_path`` asks of a session."""

    def __init__(self, master, setting=None, given=None):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master, self.getCheckpointDir = master, lambda: given


def test_scratch_folder_is_the_shared_one(monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    assert scratch_path(Bare("yarn", "hdfs:///a/"), "x").startswith("hdfs:///a/threadlens/x-")
    assert scratch_path(Bare("yarn", None, "hdfs:///b"), "x").startswith("hdfs:///b/threadlens/x-")
    assert "/run-" in scratch_path(Bare("local[2]"), "x")
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch_path(Bare(master), "x")


def test_scratch_tables_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    kept = O.store(spark.range(3), "numbers")
    assert kept.count() == 3
    assert drop_scratch(spark) > 0
    with pytest.raises(Exception):
        kept.count()


def test_partition_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    O.write_by_year(dated(spark, "2021-05-01", "2022-05-01"), "ts", path)
    read = I.read_table(spark, path).filter("year = 2021")
    assert "PartitionFilters: [isnotnull(year" in read._jdf.queryExecution().executedPlan().toString()
    only = I.read_table(spark, f"{path}/year=2022", base_path=path, file_glob="*.parquet")
    assert rows(only.select("n", "year")) == [(1, 2022)]


def test_parquet_sink_replaces_everything(spark, tmp_path):
    path = str(tmp_path / "t")
    O.write_table(spark.range(5), path)
    O.write_table(spark.range(3), path)
    assert I.read_table(spark, path).count() == 3


def test_csv_sink(spark, tmp_path):
    path = tmp_path / "c"
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 3)], "topic string, count long").repartition(3)
    O.write_csv(df, str(path), files=1, order_by=["count"])
    parts = list(path.glob("part-*"))
    assert len(parts) == 1
    assert parts[0].read_text().splitlines() == ["topic,count", "a,1", "b,2", '"",3'] or parts[0].read_text().splitlines() == ["topic,count", "a,1", "b,2", ",3"]
    assert sorted(rows(I.read_csv_table(spark, str(path), schemas.TOPIC_COUNTS)), key=str) == sorted([("a", 1), ("b", 2), (None, 3)], key=str)
    O.write_csv(df, str(tmp_path / "d"), header=False)
    assert I.read_csv_table(spark, str(tmp_path / "d"), schemas.TOPIC_COUNTS, header=False).count() == 3


def test_store_returns_the_same_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(rows(O.store(df, "numbers"))) == sorted(rows(df))


def test_views(spark):
    I.register_views(spark, {"tl_numbers": spark.range(4)})
    assert spark.sql("SELECT count(*) FROM tl_numbers").first()[0] == 4


def test_filter_job(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    O.write_table(spark.createDataFrame([("news",), ("News",), ("x",)], "subreddit string"), source)
    assert job.filter_table(spark, source, target, "subreddit", "worldnews, news") == 1
    assert job.filter_table(spark, source, target, "subreddit", "NEWS", case_insensitive=True) == 2
    assert I.read_table(spark, target).count() == 2


def test_validate(spark):
    good = spark.createDataFrame([], schemas.TOPIC_COUNTS)
    assert schemas.validate(good, schemas.TOPIC_COUNTS) is good
    with pytest.raises(ValueError, match="missing columns \\['count'\\]"):
        schemas.validate(good.drop("count"), schemas.TOPIC_COUNTS)
    with pytest.raises(ValueError, match="count: string instead of bigint"):
        schemas.validate(good.withColumn("count", F.lit("1")), schemas.TOPIC_COUNTS)
    stamps = spark.sql("SELECT 'a' id, 't3_b' link_id, '' parent_id, '' body, '' author, '' subreddit, 1L score, timestamp_ntz'2021-01-01 00:00:00' created_utc")
    schemas.validate(stamps, schemas.COMMENTS)
