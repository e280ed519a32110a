from conftest import rows
from pyspark.sql import functions as F

from threadlens.operators import reshape as U


def labelled(spark, n=20000):
    return spark.range(n).select(F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, "few").otherwise("many").alias("label"))


def test_sample_keeps_minority_and_fraction_of_majority(spark):
    sample = dict(rows(U.undersample(labelled(spark), "label", "many", 0.25, "id").groupBy("label").count()))
    assert sample["few"] == 4000
    assert abs(sample["many"] / 16000 - 0.25) < 0.02


def test_small_fractions_and_rows_without_label(spark):
    df = spark.range(100_000).select(F.col("id").cast("string"), F.when(F.col("id") % 100 != 0, "many").alias("label"))
    sample = dict(rows(U.undersample(df, "label", "many", 0.0004, "id").groupBy("label").count()))
    assert sample[None] == 1000 and 15 < sample["many"] < 75


def test_sample_and_split_do_not_depend_on_partitions(spark):
    a = labelled(spark, 2000)
    b = a.repartition(7).sortWithinPartitions(F.desc("id"))
    assert sorted(rows(U.undersample(a, "label", "many", 0.3, "id"))) == sorted(rows(U.undersample(b, "label", "many", 0.3, "id")))


def test_split_is_a_partition_in_proportion(spark):
    df = labelled(spark)
    parts = [set(r[0] for r in rows(p.select("id"))) for p in U.hash_split(df, "id", [0.8, 0.18, 0.02])]
    assert sum(map(len, parts)) == 20000 and len(set.union(*parts)) == 20000
    assert [round(len(p) / 20000, 2) for p in parts] == [0.8, 0.18, 0.02]


def test_split_of_a_sample_is_independent_of_it(spark):
    kept = U.undersample(labelled(spark), "label", "many", 0.25, "id").filter("label = 'many'")
    train, test, _ = (p.count() for p in U.hash_split(kept, "id", [0.8, 0.18, 0.02]))
    assert abs(train / (train + test) - 0.8163) < 0.03


def test_union_by_name_and_unpivot(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    assert sorted(rows(U.union_rows(a, b))) == [(1, "x"), (2, "y")]
    wide = spark.createDataFrame([("t", 1, 2)], "k string, m long, n long")
    assert rows(U.unpivot_measures(wide, "k", ["m", "n"])) == [("t", "m", 1), ("t", "n", 2)]
