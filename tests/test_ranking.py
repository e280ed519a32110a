"""Ranks and running totals against brute force, with one value holding a third of the rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from threadlens.operators import ranking as R
from threadlens.operators.skew import join_unique


def skewed(spark, n=3000, seed=5):
    rng = random.Random(seed)
    data = [(i, 7 if rng.random() < 0.34 else rng.randint(-500, 500), rng.choice("abc")) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, v long, g string").repartition(5)


def test_rank_of_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3)], "k string, v long")
    assert dict(rows(df.select("k", R.rank_max("v")))) == {"a": 2, "b": 2, "c": 3}
    assert {r["k"]: r["rank"] for r in R.add_rank_max(df, "v").collect()} == {"a": 2, "b": 2, "c": 3}
    assert {r["k"]: r["rank"] for r in R.add_rank_max(df, "v", descending=False).collect()} == {"a": 3, "b": 3, "c": 1}


def test_rank_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", None)], "k string, v long")
    assert {r["k"]: r["rank"] for r in R.add_rank_max(df, "v").collect()} == {"a": 2, "b": 2, "c": None}
    assert R.add_rank_max(df.filter("v > 100"), "v").count() == 0


def test_null_and_nan_have_no_rank(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", float("nan")), ("c", None), ("d", 1.0)], "k string, v double")
    want = {"a": 1, "b": None, "c": None, "d": 2}
    assert dict(rows(df.select("k", R.rank_max("v")))) == want
    assert {r["k"]: r["rank"] for r in R.add_rank_max(df, "v").collect()} == want


def test_sums_keep_their_fractions(spark):
    df = spark.createDataFrame([(1, 0.25), (1, 0.25), (2, 0.75)], "v long, x double")
    assert dict(rows(R.running_totals(df, "v", {"t": F.sum("x")}))) == {1: 0.5, 2: 1.25}


def test_more_ranges_give_the_same_totals(spark, monkeypatch):
    monkeypatch.setattr(R, "_PER_RANGE", 20)
    data, df = skewed(spark)
    got = dict(rows(R.running_totals(df, "v", {"n": F.count("*")})))
    assert got == {v: sum(w <= v for _, w, _ in data) for _, v, _ in data}


def test_join_unique_takes_equal_rows_and_maps_apart(spark):
    same = spark.range(1000).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    one = spark.createDataFrame([(1, "x")], "k int, n string")
    assert join_unique(same, one, "k").count() == 1000


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_match_brute_force(spark, descending):
    data, df = skewed(spark)
    got = {r["id"]: r["rank"] for r in R.add_rank_max(df, "v", descending=descending).collect()}
    values = [v for _, v, _ in data]
    want = {i: sum(w >= v if descending else w <= v for w in values) for i, v, _ in data}
    assert got == want


def test_running_totals_of_fractions(spark):
    df = spark.createDataFrame([(0.1, 1), (0.1, 2), (-3.5, 4), (9.0, 8), (None, 16), (float("nan"), 32)], "s double, n long")
    got = dict(rows(R.running_totals(df, "s", {"t": F.sum("n")})))
    assert got == {-3.5: 4, 0.1: 7, 9.0: 15}


@pytest.mark.parametrize("threshold", ["1000", "3"])
def test_top_n_per_group(spark, threshold):
    data, df = skewed(spark)
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        got = rows(R.top_n_per_group(df, "g", ["v"], 20, "id").select("g", "rank", "id"))
    finally:
        spark.conf.set(key, before)
    want = []
    for g in "abc":
        ordered = sorted((-v, i) for i, v, h in data if h == g)
        want += [(g, n + 1, i) for n, (_, i) in enumerate(ordered[:20])]
    assert sorted(got) == sorted(want)


def test_skip_top_and_top_k(spark):
    data, df = skewed(spark)
    ordered = [i for _, i in sorted((-v, i) for i, v, _ in data)]
    assert [r[0] for r in rows(R.top_k(df, ["v"], 5, "id", skip=2))] == ordered[2:7]
    left = {r[0] for r in rows(R.skip_top(df, ["v"], "id", 3))}
    assert left == set(ordered[3:])


def test_join_unique_keeps_every_row_of_a_hot_key(spark):
    data, df = skewed(spark)
    names = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = join_unique(df, names, "v").groupBy("v", "n").count()
    assert all(n == count for _, n, count in rows(got))
    missing = join_unique(df, names.filter("v <> 7"), "v", "left")
    assert missing.count() == len(data) and missing.filter("n is null").count() == sum(v == 7 for _, v, _ in data)
