import numpy as np
import pytest
from conftest import MEDIUM

from threadlens.llm.common import table
from threadlens.llm.neighbours import SLACK, balanced_parts, fit_router, nearest_neighbours, nearest_rows
from threadlens.llm.queries import QUERIES

EVERY_20TH = "id % 20 = 0"


def exact(rows, k, is_query=lambda i: i is not None and i % 20 == 0):
    """Query -> its k best (score, id) by all pairs, sums in the order of components."""
    out = {}
    for q, vector in rows:
        if is_query(q):
            scored = []
            for i, other in rows:
                if i != q:
                    total = 0.0
                    for a, b in zip(vector, other):
                        total += float(np.float32(a)) * float(np.float32(b))
                    scored.append((-total, i is None, i or 0))
            out[q] = [(None if late else i, -s) for s, late, i in sorted(scored)[:k]]
    return out


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r[2], r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("sf", [MEDIUM, "/root/testdata/sf0.1"])
def test_recall_and_scores_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    matrix, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    asks = np.flatnonzero(ids % 20 == 0)
    scores = matrix[asks] @ matrix.T
    scores[np.arange(len(asks)), asks] = -np.inf
    got = found(QUERIES["op13_neighbours"](spark, sf))
    assert sorted(got) == sorted(ids[asks].tolist()) and all(len(v) == 20 for v in got.values())
    place = {i: k for k, i in enumerate(ids.tolist())}
    hit = 0
    for line, ask in zip(scores, asks):
        mine = got[ids[ask]]
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0])) and np.allclose([s for _, s in mine], [line[place[i]] for i, _ in mine], atol=1e-12)
        hit += len({i for i, _ in mine} & set(ids[np.argsort(-line, kind="stable")[:20]].tolist()))
    assert hit >= 0.92 * 20 * len(asks)


def test_one_part_is_exact_with_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(1, 300)]
    rows = [(i, v if any(v) else [1.0] * 5) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(nearest_neighbours(df, EVERY_20TH, k=7, parts=1, block=40)) == exact(rows, 7)


def test_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.5, 0.25, 0.0] if i % 3 == 0 else rng.standard_normal(4).astype(np.float32).tolist()) for i in range(1, 1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = found(nearest_neighbours(df, EVERY_20TH, k=5, parts=4, block=100)), exact(rows, 5)
    same = sum(got[q] == want[q] for q in want)
    assert sorted(got) == sorted(want) and same >= 0.9 * len(want)


def test_parts_are_balanced_and_keep_neighbours_together():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 16)) * 3
    vectors = np.concatenate([c + rng.standard_normal((100, 16)) * 0.3 for c in centres])
    near = nearest_rows(vectors, vectors, 10, own=True)
    labels = balanced_parts(vectors, near, 8)
    assert np.bincount(labels, minlength=8).min() >= 100 * (1 - SLACK) - 1 and np.bincount(labels).max() <= 100 * (1 + SLACK) + 1
    assert (labels[near] == labels[:, None]).mean() > 0.9
    router = fit_router(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), 8)
    assert router.visited(vectors).sum(axis=1).mean() < 4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(20, [1.0, 0.0]), (40, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 1.0]), (60, [-1.0, 0.5])]
    bad = [(80, None), (100, [0.0, 0.0]), (120, [nan, 1.0]), (140, [inf, 1.0]), (160, [None, 1.0]), (180, []), (200, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "p") for i, v in good + bad], "vec_id long, embedding array<float>, part int, rank int, id string")
    got = found(nearest_neighbours(df.drop("id"), EVERY_20TH, k=20))
    assert got == exact(good, 20) and [i for i, _ in got[20]] == [2, 3, 3, None, 40, 60]
    assert found(nearest_neighbours(df, EVERY_20TH, k=20)) == got
    assert nearest_neighbours(df.limit(0), EVERY_20TH).count() == 0
    assert nearest_neighbours(df.where("vec_id > 60"), EVERY_20TH).count() == 0
