from collections import Counter

from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401

from threadlens.llm.common import table
from threadlens.llm.mixing import fill_targets, mix_documents, mixing_plan


def brute_targets(sizes, weights, share=1.5, most=2.0):
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target | {s: most * sizes[s] for s in capped}
        capped |= over


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "d": 5, "e": 300}
    weights = dict(zip("abcde", (3.0, 1.0, 2.0, 3.0, 1.0)))
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r.source: r.target for r in fill_targets(df, 1.5, 2.0).collect()}
    want = brute_targets(sizes, weights)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_taken_words_come_near_the_targets(spark):
    rows = mixing_plan(table(spark, MEDIUM, "documents")).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.05
    again = {r.id: r.copies for r in mixing_plan(table(spark, MEDIUM, "documents").repartition(5)).collect()}
    assert again == {r.id: r.copies for r in rows}


def test_mix_follows_the_plan(spark):
    docs = table(spark, MEDIUM, "documents")
    want = {r.id: r.copies for r in mixing_plan(docs).collect() if r.copies}
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == want


def test_odd_rows(odd_docs, no_docs):
    rows = mixing_plan(odd_docs).collect()
    assert len(rows) == 10
    assert {r.size for r in rows if r.id in (3, 4, 6)} == {0}
    assert mix_documents(odd_docs).columns == odd_docs.columns
    assert mixing_plan(no_docs).collect() == [] and mix_documents(no_docs).collect() == []
    empty = mixing_plan(odd_docs.where("text IS NULL")).collect()
    assert [(r.target, r.copies) for r in empty] == [(0.0, 0)] * 2
