import numpy as np
import pytest
from conftest import MEDIUM

from threadlens.llm.common import table
from threadlens.llm.queries import QUERIES
from threadlens.llm.whitening import deviations, fit_list, fit_whitening, whiten, whole_vectors


def whitened(vectors, kept):
    """x, deviation, whitened coordinates (up to signs), shares and values by a dense solver."""
    x = np.floor(256 * np.asarray(vectors, float)) + 0.0
    once = np.unique(x, axis=0)
    n, mean = len(once), once.mean(axis=0)
    cov = (once - mean).T @ (once - mean) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:kept], axes[:, ::-1][:, :kept]
    whole, sums = x.astype(int).tolist(), once.astype(int).sum(axis=0).tolist()
    apart = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in whole]
    return n, apart, (x - mean) @ axes / np.sqrt(np.where(values > 0, values, np.nan)), values / np.trace(cov)


def test_whole_table_against_a_dense_solver(spark):
    rows = table(spark, MEDIUM, "embeddings").collect()
    n, apart, white, shares = whitened([r.embedding for r in rows], 4)
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, MEDIUM).collect()}
    assert len(got) == 4 * len(rows)
    mine = np.array([[got[r.vec_id, c].whitened for c in (1, 2, 3, 4)] for r in rows])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-9
    for r, far in zip(rows, apart):
        for c in (1, 2, 3, 4):
            one = got[r.vec_id, c]
            assert (one.n, one.deviation) == (n, far) and one.explained == pytest.approx(shares[c - 1], rel=1e-10)
            assert one.identity_error < 1e-9 and one.residual < 1e-13


def test_subspace_smaller_than_the_spectrum(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 40)) * np.linspace(1, 3, 40)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    fit = fit_whitening(fit_list(whole_vectors(df)), components=3, block=8)
    assert np.allclose(fit.values / fit.trace, whitened(vectors, 3)[3], rtol=1e-10) and fit.passes > 10


def odd(spark, rows, extra="n long, x string, row string, width int"):
    return spark.createDataFrame([(i, v, 7, "x", "r", 1) for i, v in rows], "vec_id long, embedding array<float>, " + extra)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25, 0.0]), (2, [0.1, -0.3, 1.0]), (2, [0.1, -0.3, 1.0]), (None, [3.0, 0.0, -2.0]), (4, [1.0, 1.0, 1.0]), (5, [0.0, 0.0, 0.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 0.0, 0.0]), (9, [inf, 0.0, 0.0]), (10, []), (11, [1.0]), (12, [1e30, 0.0, 0.0])]
    got = whiten(odd(spark, good + bad)).collect()
    assert sorted((r.id or 0, r.component) for r in got) == sorted((i or 0, c) for i, _ in good for c in (1, 2, 3))
    n, apart, white, _ = whitened([np.float32(v).astype(float) for _, v in good], 3)
    assert {r.n for r in got} == {n} == {5}
    assert {r.id: r.deviation for r in got} == {i: d for (i, _), d in zip(good, apart)}
    first = {r.id: abs(r.whitened) for r in got if r.component == 1}
    assert first == pytest.approx({i: abs(w[0]) for (i, _), w in zip(good, white)}, abs=1e-9)


def test_too_few_vectors_and_empty_tables(spark):
    flat = whiten(odd(spark, [(1, [0.0, 1.0, 0.0]), (2, [0.0, 2.0, 0.0])])).collect()
    assert [(r.id, r.component, r.whitened is None) for r in sorted(flat, key=lambda r: (r.id, r.component))] == [(i, c, c > 1) for i in (1, 2) for c in (1, 2, 3)]
    assert {r.explained for r in flat if r.component > 1} == {0.0}
    one = whiten(odd(spark, [(1, [0.5]), (2, [0.5])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2
    assert whiten(odd(spark, [(1, [0.5])]).limit(0)).count() == 0 and whiten(odd(spark, [(1, None)])).count() == 0


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert deviations(x, 10**6, [5, 6]) == [None, (3 * 10**6 - 5) ** 2 + (4 * 10**6 - 6) ** 2]
