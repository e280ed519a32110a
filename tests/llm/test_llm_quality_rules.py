import random
import re
from collections import Counter

from llm_cases import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from threadlens.llm.quality_rules import bucket_floor, bucket_of, judge_quality, measure, merge_sketches, quartiles, sketch


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def test_counts_of_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "\n", "c d e f g\n", "#", "é", "\U0001F600", "\x1c", "a b c d e "]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in measure(df).collect():
        assert tuple(r)[3:] == (*brute(texts[r.id])[:1], *brute(texts[r.id])[1:]), texts[r.id]


def test_buckets(spark):
    values = [*range(0, 300), 10**6, 2**40 + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket_of(F.col("v")).alias("b")).withColumn("low", bucket_floor(F.col("b"))).orderBy("v").collect()
    assert all(r.low <= r.v <= r.low * 33 / 32 and (r.v >= 64 or r.low == r.v) for r in got)
    assert [r.b for r in got] == sorted(r.b for r in got)


def test_merged_sketches_give_the_quartiles_of_all_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice("xyz"), int(rng.expovariate(0.002))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "lang string, source string, m long")
    merged = {r.lang: r for r in quartiles(merge_sketches(sketch(df, ["lang", "source"], ["m"]), ["lang"]), ["lang"]).collect()}
    for lang, r in merged.items():
        values = sorted(v for x, _, v in rows if x == lang)
        assert r.rows == len(values)
        for q, want in ((r.q1, values[-(-len(values) // 4) - 1]), (r.q3, values[-(-3 * len(values) // 4) - 1])):
            assert want * 31 / 32 - 1 <= q <= want


def test_fences_follow_the_group(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8)))
    plain = [(i, " ".join(word() for _ in range(40)), "en", f"s{i % 2}") for i in range(400)]
    symbols = [(1000 + i, " ".join(word() + "#" for _ in range(40)), "en", "s0") for i in range(5)]
    markup = [(2000 + i, " ".join(word() + "#" for _ in range(40)), "md", "s9") for i in range(300)]
    df = spark.createDataFrame(plain + symbols + markup, "doc_id long, text string, lang string, source string")
    kept = {r.id: r.kept for r in judge_quality(df).collect()}
    assert all(kept[i] for i, *_ in plain) and not any(kept[i] for i, *_ in symbols) and all(kept[i] for i, *_ in markup)


def test_odd_rows(odd_docs, no_docs):
    rows = judge_quality(odd_docs).collect()
    assert len(rows) == 10 and all(r.kept is not None for r in rows)
    assert [(r.n_words, r.kept) for r in rows if r.id in (3, 4, 6)] == [(0, False)] * 3
    long = next(r for r in rows if r.id == 5)
    assert long.n_words == long.n_repeat_words == 60_000 and not long.kept
    assert judge_quality(no_docs).collect() == []
