import hashlib

import numpy as np
from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from threadlens.llm.common import table
from threadlens.llm.fingerprints import (K, compare_fingerprints, containment, distinct_count, edit_study, edited_text, fingerprint_documents, from_text,
                                         merge_fingerprints, resemblance, shingle_sketch, to_text)


def exact(a, b):
    def shingles(x):
        w = x.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_study_against_whole_texts(spark):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, MEDIUM, "documents").select("doc_id", "text").collect())
    got = {r.id: r for r in edit_study(table(spark, MEDIUM, "documents")).collect()}
    assert len(got) == len(docs)
    errors = []
    for (doc_id, text), (next_id, following) in zip(docs, docs[1:] + docs[:1]):
        r, edit = got[doc_id], edited_text(text, following)
        assert (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert r.fingerprint == to_text(shingle_sketch(text)) and r.edited_fingerprint == to_text(shingle_sketch(edit))
        assert abs(r.near_next - resemblance(from_text(r.fingerprint), from_text(got[next_id].fingerprint))) < 1e-12
        errors += [r.near_edited - exact(text, edit), r.near_next - exact(text, following)]
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25


def test_sketch_holds_the_smallest_hashes_of_texts_full_of_repeats():
    texts = ["a b c d e f " * 2000, " ".join(str(i % 700) for i in range(9000)), "x", "a b c"]
    for text in texts:
        assert np.array_equal(shingle_sketch(text), shingle_sketch(text, k=10**6)[:K])
        assert np.array_equal(from_text(to_text(shingle_sketch(text))), shingle_sketch(text))
    part, whole = texts[1], texts[1] + " " + " ".join(f"n{i}" for i in range(3000))
    a, b = shingle_sketch(part), shingle_sketch(whole)
    assert containment(a, b) > 0.8 and abs(containment(b, a) - 700 / 3704) < 0.1
    assert abs(distinct_count(b) / 3704 - 1) < 0.3


def test_parts_merge_into_the_whole(spark):
    texts = [" ".join(f"w{i * 7 % 97}" for i in range(k, k + 60)) for k in range(0, 200, 20)]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)] + [(99, None, 2)], "doc_id long, text string, g int")
    prints = fingerprint_documents(df).join(df.select(F.col("doc_id").alias("id"), "g"), "id")
    merged = {r.g: r.fingerprint for r in merge_fingerprints(prints, ["g"]).collect()}
    for g in (0, 1):
        every = np.unique(np.concatenate([shingle_sketch(t, k=10**6) for i, t in enumerate(texts) if i % 2 == g]))[:K]
        assert merged[g] == to_text(every)
    assert merged[2] == ""
    same = prints.select(compare_fingerprints(F.col("fingerprint"), F.col("fingerprint")).alias("c")).collect()
    assert all(r.c.resemblance == r.c.containment == 1.0 for r in same)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = edit_study(odd_docs).collect()
    assert len(rows) == 10 and sorted(r.n_chars for r in rows)[:3] == [0, 0, 0]
    assert edit_study(no_docs).collect() == [] and fingerprint_documents(no_docs).collect() == []
    one = edit_study(odd_docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
