import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401

from threadlens.llm.common import table
from threadlens.llm.queries import QUERIES
from threadlens.llm.spelling import affected, counted_words, near_pairs, roots, spelling_groups


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def grouped(counts, dominance=5):
    """word, form, root, n, n_near, form_n by comparing all words."""
    around = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= dominance * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(around[w]), counts.get(form.get(w))) for w, n in counts.items()}


def table_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("frequent,tile", [(200, 500), (3, 4), (0, 50)])
def test_words_over_few_letters_against_all_pairs(spark, frequent, tile):
    rng = random.Random(frequent)
    counts = {"".join(rng.choices("abé", k=rng.randint(6, 9))): rng.choice([5, 6, 30, 31, 200, 2000]) for _ in range(250)}
    assert result(spelling_groups(table_of(spark, counts), frequent=frequent, tile=tile)) == grouped(counts)


def test_edits_at_every_place(spark):
    base = "straßeöffnung"
    words = {base} | {base[:k] + base[k + 1 :] for k in range(len(base))} | {base[:k] + "x" + base[k:] for k in range(len(base) + 1)} | {base[:k] + "y" + base[k + 1 :] for k in range(len(base))}
    got = {(r.a, r.b) for r in near_pairs(table_of(spark, dict.fromkeys(words, 5)), frequent=2).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_whole_table_against_all_words(spark):
    n, upper = Counter(), {i: i + 32 for i in range(65, 91)}
    for doc_id, text in table(spark, MEDIUM, "documents").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(upper)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            n[word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    counts = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    got = result(QUERIES["op12_spelling_variants"](spark, MEDIUM))
    assert {r[0]: r[3] for r in got} == counts
    # All pairs of 7,000 words by their patterns with one letter left out.
    near = {w: set() for w in counts}
    holes = {}
    for w in counts:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
            if (short := w[:k] + w[k + 1 :]) in counts:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    assert {r[0]: r[4] for r in got} == {w: len(v) for w, v in near.items()}
    forms = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    forms = {w: f for w, f in forms.items() if counts[f] >= 5 * counts[w]}
    assert {r[0]: r[1] for r in got if r[1]} == forms and len(forms) > 100
    assert {r[0]: r[5] for r in got if r[1]} == {w: counts[f] for w, f in forms.items()}


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("other", "w3")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w20" for w, _ in chain}
    assert roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_affected_grams():
    assert affected(np.array([0, 1, 2]), np.array([3, 2, 2])) == 3
    assert affected(np.array([0]), np.array([2])) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {r.word: r.n for r in counted_words(odd_docs, min_length=4, min_count=1).collect()}
    assert rows["lorem"] == 20_000 and rows["quick"] == 3 and rows["password"] == 1 and rows["jumps"] == 3
    long = "z" * 200_000
    words = {long: 5, long[:-1]: 50, "lorems": 5, "loremz": 5}
    assert result(spelling_groups(table_of(spark, words))) == {
        (long, long[:-1], long[:-1], 5, 1, 50), (long[:-1], None, long[:-1], 50, 1, None), ("lorems", None, "lorems", 5, 1, None), ("loremz", None, "loremz", 5, 1, None)}
    assert spelling_groups(counted_words(no_docs)).count() == 0
    assert counted_words(odd_docs.withColumn("text", odd_docs.source)).count() == 0
    with pytest.raises(ValueError):
        near_pairs(table_of(spark, {"ab": 5}))
