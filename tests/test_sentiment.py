"""Scores worked out by hand, and the inline form against the joined one."""

import math

import pytest
from conftest import MEDIUM, column, rows
from pyspark.sql import functions as F

from threadlens.catalog import views as V
from threadlens.operators.sentiment import Lexicon, ValenceRules, score_both, score_sentiment

WORDS = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("sad", -2.1)]


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(WORDS, "word string, valence double").cache()


def score(spark, lexicon, texts, method="valence", **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string").coalesce(1)
    out = score_sentiment(df, "body", lexicon, method, out="s", **options)
    return [None if v is None else round(v, 4) for v in column(out.orderBy("id").select(F.col("s").cast("double")))]


CASES = {
    "good": 1.9,
    "it is good": 1.9,
    "not good": 1.9 * -0.74,
    "isn't good": 1.9 * -0.74,
    "not a very good day": (1.9 + 0.293) * -0.74,
    "not one two three good": 1.9,
    "very good": 1.9 + 0.293,
    "very a good": 1.9 + 0.293 * 0.95,
    "slightly bad": -2.5 + 0.293,
    "very bad": -2.5 - 0.293,
    "very very good": 1.9 + 0.293 + 0.293 * 0.95,
    "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
    "GOOD day": 1.9 + 0.733,
    "GOOD DAY": 1.9,
    "good!!": 1.9 + 2 * 0.292,
    "bad!!!!!!": -2.5 - 4 * 0.292,
    "good??": 1.9 + 2 * 0.18,
    "sad?????": -2.1 - 0.96,
    "good, bad; great.": 1.9 - 2.5 + 3.1,
}


@pytest.mark.parametrize("limit", [20_000, 1])
def test_valence_by_hand(spark, lexicon, limit):
    got = score(spark, lexicon, list(CASES), inline_limit=limit)
    assert got == [compound(v) for v in CASES.values()]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_texts_without_words(spark, lexicon, limit):
    assert score(spark, lexicon, ["", None, "nothing here!", "very"], inline_limit=limit) == [0.0, None, 0.0, 0.0]


def test_cleaned_text_takes_no_emphasis(spark, lexicon):
    assert score(spark, lexicon, ["GOOD day!!"], rules=ValenceRules(emphasis=False)) == [compound(1.9)]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_polarity_is_the_mean(spark, lexicon, limit):
    got = score(spark, lexicon, ["Good BAD good", "none", "", None], "polarity", inline_limit=limit)
    assert got == [round((1.9 - 2.5 + 1.9) / 3, 4), 0.0, 0.0, None]


def test_equal_and_missing_ids_do_not_matter(spark, lexicon):
    df = spark.createDataFrame([(1, "good"), (1, "bad"), (None, "good"), (2, None), (3, "good")], "id int, body string")
    for method in ("valence", "polarity"):
        inline, joined = (sorted(rows(score_sentiment(df, "body", lexicon, method, "s", inline_limit=n).select("id", "body", "s")), key=repr) for n in (20_000, 1))
        assert inline == joined and len(joined) == 5


def test_inline_and_joined_agree_on_whole_table(spark):
    rows, words = V.comments(spark, MEDIUM), V.lexicon(spark, MEDIUM)
    inline = score_sentiment(rows, "body", words, "valence", "a", V.RULES)
    joined = score_sentiment(rows.select("id", "body"), "body", words, "valence", "b", V.RULES, inline_limit=10)
    both = inline.select("id", "a").join(joined.select("id", "b"), "id")
    assert both.count() == rows.count()
    assert both.filter("a <> b").count() == 0
    assert both.filter("a <> 0").count() > 0


IDIOMS = [("cut", -1.0), ("mustard", 0.5), ("cut the mustard", 2.0), ("the mustard", -3.0), ("kind", 2.4), ("kind of", -0.2), ("very bad day", 1.5), ("bad", -2.5)]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_idioms_by_hand(spark, limit):
    lexicon = Lexicon.of(spark.createDataFrame(IDIOMS, "word string, valence double"), limit, phrase_words=3)
    cases = {
        "cut the mustard": (2.0, 2.0),
        "not cut the mustard": (2.0 * -0.74, 2.0),
        "cut the": (-1.0, -1.0),
        "the mustard cut the mustard": (-3.0 + 2.0, -0.5),
        "cut cut the mustard mustard": (-1.0 + 2.0 + 0.5, 0.5),
        "a very bad day": (1.5, 1.5),
        "a very bad morning": (-2.5 - 0.293, -2.5),
        "kind of kind": (-0.2 + 2.4, 1.1),
        "it is kind, of course": (-0.2, -0.2),
        "CUT the mustard today": (2.0 + 0.733, 2.0),
        "": (0.0, 0.0),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "id int, body string").coalesce(1)
    got = {r["id"]: (r["vader_score"], r["textblob_score"]) for r in score_both(df, "body", lexicon).collect()}
    for i, (valence, mean) in enumerate(cases.values()):
        assert got[i] == (pytest.approx(compound(valence), abs=1e-4), pytest.approx(mean, abs=1e-6)), list(cases)[i]
    assert got[99] == (None, None)


def test_random_idioms_against_a_scan(spark):
    import random

    rng = random.Random(2)
    entries = {" ".join(rng.choices("abcd", k=rng.choice([1, 2, 3, 4]))): rng.randint(-20, 20) / 10 for _ in range(40)}
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 40))) for _ in range(120)]

    def mean(text):
        words, found, i = text.split(), [], 0
        while i < len(words):
            n = next((n for n in (4, 3, 2, 1) if i + n <= len(words) and " ".join(words[i : i + n]) in entries), 0)
            if n:
                found.append(entries[" ".join(words[i : i + n])])
            i += n or 1
        return sum(found) / len(found) if found else 0.0

    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    table = spark.createDataFrame(list(entries.items()), "word string, valence double")
    for limit in (20_000, 0):
        got = score_sentiment(df, "body", Lexicon.of(table, limit, phrase_words=4), "polarity", out="s").orderBy("id").collect()
        assert [r["s"] for r in got] == pytest.approx([mean(t) for t in texts], abs=1e-6)


def test_both_scores_read_the_words_once(spark, lexicon):
    df = spark.createDataFrame([(1, "not good but GREAT!")], "id int, body string")
    both = score_both(df, "body", lexicon)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    single = score_sentiment(score_sentiment(df, "body", lexicon, "valence"), "body", lexicon, "polarity")
    assert rows(both) == rows(single)


@pytest.mark.parametrize("limit", [20_000, 0])
def test_a_run_of_words_does_not_copy_its_text(spark, limit):
    lexicon = Lexicon.of(spark.createDataFrame(IDIOMS, "word string, valence double"), limit, phrase_words=3)
    both = score_both(spark.createDataFrame([(1, "cut the mustard")], "id int, body string"), "body", lexicon)
    assert "slice(" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_a_joined_word_travels_without_its_text(spark, lexicon, monkeypatch):
    from threadlens.operators import sentiment

    df = spark.createDataFrame([(1, "not good"), (2, "very GOOD day!")], "id int, body string")
    sent = score_sentiment(df, "body", lexicon, "valence", "s", inline_limit=1).select("id", "s")
    monkeypatch.setattr(sentiment, "BROADCAST_LIMIT", 1)
    exchanged = score_sentiment(df, "body", lexicon, "valence", "s", inline_limit=1).select("id", "s")
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "strategy=broadcast" in plan
    assert "strategy=broadcast" not in exchanged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(rows(sent)) == sorted(rows(exchanged)) and len(rows(sent)) == 2
