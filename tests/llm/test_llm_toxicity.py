import random

import numpy as np
from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from threadlens.llm.common import table
from threadlens.llm.toxicity import ToxicityModel, drop_toxic, fit_toxicity, held_out, maximal_segments, score_toxicity


def brute_segments(scores):
    """The best segment, then the same to the left and right of it; shortest and first of ties."""
    def best(lo, hi):
        options = [(sum(scores[i : j + 1]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i, hi)]
        if not options or max(options)[0] <= 0:
            return []
        *_, i, j = max(options)
        return best(lo, i) + [(i, j)] + best(j + 1, hi)

    return best(0, len(scores))


def test_segments_against_the_definition():
    rng = random.Random(11)
    for _ in range(500):
        n, other = rng.randint(0, 14), -0.37
        places = [i for i in range(n) if rng.random() < 0.4]
        scores = [round(rng.uniform(0.1, 2), 3) for _ in places]
        line = [other] * n
        for p, s in zip(places, scores):
            line[p] = s
        got = maximal_segments(places, scores, other)
        assert [(f, e) for f, e, _ in got] == brute_segments(line)
        assert all(abs(s - sum(line[f : e + 1])) < 1e-9 for f, e, s in got)


def test_planted_documents_are_caught_and_clean_ones_are_not(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(30, 300))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vile", "grim", "foul", "rotten"]) + rng.choice(["", "ly", "er"]) for _ in range(6)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, marks.where(~held_out(F.col("doc_id"))))
    got = {r.id: r for r in score_toxicity(docs, model).collect()}
    held = [i for i in range(600) if _crc(i) % 3 == 1]
    caught = [got[i].score >= 0.7 for i in held if labels[i][1]]
    assert np.mean(caught) > 0.9 and not any(got[i].score >= 0.7 for i in held if not labels[i][1])
    for i in held:
        for p in got[i].passages:
            assert p.expected < 0.01 and any(w in rows[i][1][p.start : p.end] for w in ("vile", "grim", "foul", "rotten")) or not labels[i][1]
    kept = {r.doc_id for r in drop_toxic(docs, marks).collect()}
    assert kept == {i for i in got if got[i].score < 0.7}


def _crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def test_accuracy_on_rows_held_out(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = score_toxicity(docs, model).join(labels.where(held_out(F.col("doc_id"))), F.col("id") == F.col("doc_id")).select("score", "toxic").collect()
    good, bad = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.85
    assert np.mean([b >= 0.7 for b in bad]) < 0.05


def test_odd_rows(spark, odd_docs, no_docs):
    model = ToxicityModel({"fox": 3.0}, -0.1, 0.5, -2.0, 1.0)
    rows = score_toxicity(odd_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and score_toxicity(no_docs, model).collect() == []
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert fit_toxicity(odd_docs, none).units == {}
    assert drop_toxic(odd_docs, none).count() == 10 and drop_toxic(no_docs, none).columns == no_docs.columns
    one_kind = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert fit_toxicity(odd_docs, one_kind).units == {}
