"""Pairs of items of a document table against counting by hand, with hot documents and hot items."""

import random
from collections import Counter
from itertools import combinations

import pytest

from threadlens.operators.cooccurrence import cooccurrence


def counted(rows, least=1):
    held = {}
    for doc, item in rows:
        if doc is not None and item is not None:
            held.setdefault(doc, set()).add(item)
    pairs = Counter(p for items in held.values() for p in combinations(sorted(items), 2))
    return {p: n for p, n in pairs.items() if n >= least}


def result(df):
    got = {(r.a, r.b): r["count"] for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.mark.parametrize("least,block", [(1, 128), (1, 3), (2, 7), (4, 1)])
def test_random_documents(spark, least, block):
    rng = random.Random(least)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *"abcdefghijklmnopqé"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc int, item string")
    want = counted(rows, least)
    assert want and result(cooccurrence(df, "doc", "item", least, block)) == want


def test_one_document_holds_a_third_of_all_rows_and_one_item_is_everywhere(spark):
    rng = random.Random(1)
    rows = [("hot", i) for i in range(700)] + [(f"d{d}", i) for d in range(230) for i in (0, *rng.sample(range(1, 5000), 5))]
    df = spark.createDataFrame(rows, "doc string, item int")
    found = cooccurrence(df, "doc", "item", block=64)
    assert result(found) == counted(rows)


def test_no_row_holds_a_whole_hot_document(spark):
    df = spark.range(1500).selectExpr("1 AS doc", "id AS item")
    found = cooccurrence(df, "doc", "item", block=100)
    assert found.count() == 1500 * 1499 // 2
    assert found.where("count <> 1 OR a >= b").count() == 0


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a"), (2, None)], "a int, b string")
    assert cooccurrence(df, "a", "b").count() == 0
    assert cooccurrence(df.limit(0), "a", "b").columns == ["a", "b", "count"]
    own = spark.createDataFrame([(1, "x", 5), (1, "y", 6)], "doc int, item string, blocks int")
    assert result(cooccurrence(own, "doc", "item")) == {("x", "y"): 1}


def test_pairs_are_counted_as_numbers(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "é")], "doc int, item string")
    found = cooccurrence(df, "doc", "item")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    counted = [line for line in plan.splitlines() if "Aggregate" in line and "shiftleft" in line]
    assert counted or "shiftleft" in plan
    assert result(found) == {("a", "b"): 2, ("a", "é"): 1, ("b", "é"): 1}
