import numpy as np
import pytest
from conftest import rows

from threadlens.operators.regression import linear_regression, regression_terms


def table_of(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 1e4, 1e-3] + [5, 1e6, 0]
    y = 3 + x @ [2.0, -1e-4, 50.0] + rng.normal(size=n)
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    data = [(str(g), *map(float, r), float(t)) for g, r, t in zip(group, x, y)]
    return data, spark.createDataFrame(data, "kind string, x double, y double, z double, t double")


def solved(data, columns=(1, 2, 3)):
    x = np.array([[r[c] for c in columns] for r in data])
    y = np.array([r[4] for r in data])
    full = np.c_[np.ones(len(x)), x]
    scale = np.abs(full).max(axis=0)
    b = np.linalg.lstsq(full / scale, y, rcond=None)[0] / scale
    rest = y - full @ b
    inverse = np.linalg.inv((full / scale).T @ (full / scale)) / np.outer(scale, scale)
    return b, rest @ rest / len(y), np.sqrt(rest @ rest / (len(y) - full.shape[1]) * np.diag(inverse))


def test_each_group_equals_a_dense_solver(spark):
    data, df = table_of(spark)
    found = {r.kind: r for r in linear_regression(df.repartition(7), "t", ["x", "y", "z"], ["kind"]).collect()}
    assert found.keys() == {"hot", "a", "b"}
    for kind, row in found.items():
        mine = [r for r in data if r[0] == kind]
        b, mse, errors = solved(mine)
        assert row.n == len(mine) and row.mse == pytest.approx(mse, rel=1e-8)
        assert [row.intercept, *(t.coefficient for t in row.terms)] == pytest.approx(list(b), rel=1e-6)
        assert [t.std_error for t in row.terms] == pytest.approx(list(errors[1:]), rel=1e-6)
    whole = linear_regression(df, "t", ["x", "y", "z"]).first()
    assert whole.n == len(data) and whole.mse == pytest.approx(solved(data)[1], rel=1e-8)


def test_features_without_new_information_are_left_out(spark):
    data, df = table_of(spark)
    wide = df.selectExpr("*", "2 * x - 1 AS twice", "7.0 AS same")
    alone, more = linear_regression(df, "t", ["x", "y"]).first(), linear_regression(wide, "t", ["x", "same", "twice", "y"]).first()
    assert more.mse == pytest.approx(alone.mse) and more.intercept == pytest.approx(alone.intercept)
    terms = {t.feature: t for t in more.terms}
    assert terms["same"].coefficient == terms["twice"].coefficient == 0 and terms["twice"].std_error is None
    assert terms["y"].coefficient == pytest.approx(alone.terms[1].coefficient)


def test_defined_cases(spark):
    _, df = table_of(spark, 50)
    odd = df.unionByName(df.selectExpr("kind", "CAST(NULL AS DOUBLE) AS x", "y", "z", "t")).unionByName(
        df.selectExpr("kind", "CAST('NaN' AS DOUBLE) AS x", "y", "z", "t")).unionByName(df.selectExpr("kind", "CAST('Infinity' AS DOUBLE) AS x", "y", "z", "t"))
    assert linear_regression(odd, "t", ["x"]).first().n == 50
    none = linear_regression(df.limit(0), "t", ["x"]).first()
    assert none.n == 0 and none.intercept is None and none.mse is None and none.r2 is None
    assert linear_regression(df.limit(0), "t", ["x"], ["kind"]).count() == 0
    one = linear_regression(df.limit(1), "t", ["x"]).first()
    assert one.mse == 0 and one.r2 is None and one.terms[0].std_error is None
    flat = linear_regression(df.selectExpr("x", "1.0 AS t"), "t", ["x"]).first()
    assert flat.mse == 0 and flat.r2 is None and flat.intercept == 1
    assert rows(regression_terms(linear_regression(df, "t", []))) == []


def test_rows_are_read_once(spark):
    _, df = table_of(spark)
    plan = linear_regression(df, "t", ["x", "y", "z"], ["kind"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
