"""Names of fitted topics: the best assignment, and the same names after another fit."""

import random
from itertools import permutations

import pytest

from threadlens.operators.topics import assign_topic, best_assignment, fit_topics, match_topics, seed_scores, topic_weights

SUBJECTS = {
    "space": "rocket orbit moon launch planet star".split(),
    "food": "bread butter cheese salt pepper oven".split(),
    "sport": "ball goal match league coach team".split(),
    "money": "bank loan credit market price stock".split(),
}
SEEDS = {name: words[:3] + ["unseen"] for name, words in SUBJECTS.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_assignment_against_all_permutations(n):
    rng = random.Random(n)
    for _ in range(40):
        scores = [[rng.choice([0.0, 0.5, rng.random(), -1.0]) for _ in range(n)] for _ in range(n)]
        taken = best_assignment(scores)
        assert sorted(taken) == list(range(n))
        best = max(sum(scores[r][c] for r, c in enumerate(p)) for p in permutations(range(n)))
        assert sum(scores[r][c] for r, c in enumerate(taken)) == pytest.approx(best)


def test_greedy_choice_would_lose(spark):
    # Topic 1 fits "a" best, but topic 0 fits nothing else.
    weights = spark.createDataFrame([(0, "x", 5.0), (0, "z", 5.0), (1, "x", 6.0), (1, "y", 4.0)], "topic int, term string, weight double")
    assert match_topics(weights, {"a": ["x"], "b": ["y"]}) == {0: "a", 1: "b"}


def test_scores_by_hand_and_other_numbers_of_names(spark):
    weights = spark.createDataFrame([(0, "x", 1.0), (0, "y", 3.0), (1, "x", 30.0), (1, "y", 10.0), (2, "q", 1.0)], "topic int, term string, weight double")
    got = {(r.topic, r.name): r.score for r in seed_scores(weights, {"a": ["x", "x", "none"], "b": ["y", "x"]}).collect()}
    assert got == pytest.approx({(0, "a"): 0.125, (1, "a"): 0.375, (2, "a"): 0, (0, "b"): 0.875, (1, "b"): 0.625, (2, "b"): 0})
    assert match_topics(weights, {"a": ["x"], "b": ["y"]}) == {0: "b", 1: "a"}
    assert match_topics(weights.where("topic = 1"), {"a": ["x"], "b": ["y"]}) == {1: "a"}
    assert match_topics(weights.limit(0), {"a": ["x"]}) == {}


def test_same_names_after_a_fit_with_another_seed_and_partitioning(spark):
    rng = random.Random(6)
    titles = [(str(i), " ".join(rng.choices(SUBJECTS[name], k=6))) for i, name in enumerate(rng.choices(list(SUBJECTS), k=400))]
    truth = {i: next(n for n, words in SUBJECTS.items() if t.split()[0] in words) for i, t in titles}
    df = spark.createDataFrame(titles, "id string, title string")
    for seed, parts in ((13, 2), (99, 8)):
        model = fit_topics(df.repartition(parts), "title", k=4, max_iter=30, seed=seed, min_df=2, partitions=parts)
        named = assign_topic(model, df, match_topics(topic_weights(model), SEEDS)).collect()
        assert sum(r.topic == truth[r.id] for r in named) >= 0.97 * len(named)
