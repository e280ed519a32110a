from conftest import column, rows
from pyspark.sql import functions as F

from threadlens.constants import TITLE_TERMS
from threadlens.functions import labels as L
from threadlens.functions import text as X
from threadlens.operators import aggregates as A


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)


def sources(spark, *urls, **options):
    return column(texts(spark, *urls).select(X.news_source("t", **options)))


def test_news_source_rules(spark):
    cases = {
        "https://www.bbc.co.uk/x": "bbc",
        "https://amp.cnn.com/a": "cnn",
        "https://NYTimes.com/a?x=//y": "nytimes",
        "https://twitter.com/Reuters/status/1": "Reuters",
        "https://mobile.twitter.com/AP?s=20": "AP",
        "https://twitter.com": "twitter",
        "https://twitter.com/": "",
        "https://www.google.com/amp/s/www.npr.org/x": "npr",
        "https://www.google.com/amp/s/amp.theguardian.com/world/amp/s/2": "theguardian",
        "https://www.google.com/url?q=1&url=apnews.com/a": "apnews",
        "https://www.google.com/search": None,
        "http://u:p@site.com:80/": "u:p@site",
        "//cdn.example.org/x": "cdn",
        "example.org/x": "",
        "": "",
        None: None,
        "https://www": None,
        "http://[broken/x": None,
    }
    assert sources(spark, *cases) == list(cases.values())


def test_nested_scheme_is_removed_unless_asked(spark):
    url = "https://www.google.com/url?url=https://www.cnn.com/a"
    assert sources(spark, url) == ["cnn"]
    assert sources(spark, url, strip_nested_scheme=False) == ["https:"]


def test_clean_text(spark):
    got = column(X.clean_text(texts(spark, "  It's FAKE-news!! ", None, "end\n", "Ça va 9"), "t").select("t"))
    assert got == ["its fakenews", None, "end\n", "a va 9"]


def test_flag_phrases(spark):
    df = texts(spark, None, "fakenews", "misinformed", "some fake news here", "Fake news", "")
    got = column(X.flag_phrases(df, "t", ("fake news", "misinfo"), "f").select("f"))
    assert got == [False, False, True, True, False, False]


def test_phrases_may_be_patterns(spark):
    df = texts(spark, "deep state", "deeep state", "dp state", "wake up")
    assert column(df.select(X.matches_any("t", ("de+p state", "wake up")))) == [True, True, False, True]


def test_post_id(spark):
    assert column(texts(spark, "t3_ab", "t1_ab", "").select(X.post_id("t"))) == ["ab", "", ""]


def test_term_dummies(spark):
    df = X.term_dummies(texts(spark, "industry", "US", None), "t", TITLE_TERMS)
    assert len(df.columns) == 2 + 72
    assert [(r["us"], r["industry"]) for r in df.collect()] == [(1, 1), (0, 0), (0, 0)]


def test_tokenize_keeps_inner_empty_words(spark):
    df = texts(spark, "A  b\tC ", "", "   ", None, " x")
    assert column(X.tokenize(df, "t", "w").select("w")) == [["a", "", "b", "c"], [""], [], None, ["", "x"]]


def test_normalize_and_stop_words(spark):
    df = X.normalize_tokens(texts(spark, "The U.S. economy -- in 2021, the THE", None), "t", "w")
    assert column(df.select("w")) == [["the", "us", "economy", "in", "the", "the"], None]
    assert column(X.remove_stop_words(df, "w", ["The", "in"]).select("w")) == [["us", "economy"], None]
    # repeats of other words stay
    repeated = X.normalize_tokens(texts(spark, "war the war"), "t", "w")
    assert column(X.remove_stop_words(repeated, "w", ["the"]).select("w")) == [["war", "war"]]


def test_only_letters_are_left(spark):
    df = X.normalize_tokens(texts(spark, "c++ + a 1+1", "Über-Straße"), "t", "w")
    assert column(df.select("w")) == [["c", "a"], ["überstraße"]]


def test_lemmatize_inline_and_joined_agree(spark):
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run"), ("ran", "ran")], "form string, lemma string")
    df = X.normalize_tokens(texts(spark, "cats ran far", "", None, "far cats cats"), "t", "w")
    want = [["cat", "run", "far"], [], None, ["far", "cat", "cat"]]
    assert column(X.lemmatize(df, "w", lemmas).select("lemmas")) == want
    assert column(X.lemmatize(df, "w", lemmas, inline_limit=0).orderBy("i").select("lemmas")) == want


def test_labels(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4], 3.0), ([1.0], 9.0)], "a array<double>, f float").coalesce(1)
    got = rows(df.select(L.argmax("a"), L.map_labels(F.col("f"), {3: "tv shows"})))
    assert got == [(1, "tv shows"), (0, None)]
    assert rows(df.limit(1).select(L.indices_to_terms(F.array(F.lit(1), F.lit(0)), ["x", "y"]))) == [(["y", "x"],)]


def test_numbers(spark):
    df = spark.createDataFrame([(1234567, 0, 2.0), (-5, 4, 0.0)], "n long, d long, z double").coalesce(1)
    assert rows(df.select(L.with_thousands("n"), L.parse_thousands(L.with_thousands("n")))) == [("1,234,567", 1234567), ("-5", -5)]
    assert rows(df.select(L.ratio("n", "d"), L.ratio("n", "d", 100))) == [(None, None), (-1.25, -125.0)]
    assert rows(L.zero_to_null(df, ["d", "z"]).select("d", "z")) == [(None, 2.0), (4, None)]
    assert L.strip_prefix(df.withColumnRenamed("n", "sum_new_n"), "sum_new_").columns == ["n", "d", "z"]
    assert rows(df.select(L.label_by_count("d", "yes", "no"), L.below("z", 1))) == [("no", 0), ("yes", 1)]


def test_unit_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").coalesce(1)
    assert column(df.select(L.unit_vector("v"))) == [[0.6, 0.8], [0.0, 0.0]]


def test_many_phrases_as_one_by_one(spark):
    rng = __import__("random").Random(4)
    phrases = list(dict.fromkeys("".join(rng.choices("abé ", k=rng.randint(1, 5))) for _ in range(200))) + ["é\U0001F600a", "\U0001F600", "(a|b)c", "a.b"]
    texts = ["".join(rng.choices("abécd \U0001F600", k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "a" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    import re

    holds = {p: [t is not None and re.search(p, t) is not None for t in texts] for p in phrases}
    assert len(X.part_phrases(phrases)[0]) > X.TOGETHER and X.part_phrases(phrases)[1] == phrases[-4:]
    dummies = X.term_dummies(df, "t", [p for p in phrases if "." not in p]).orderBy("id").collect()
    for p in phrases:
        if "." not in p:
            assert [r[p] for r in dummies] == [int(h) for h in holds[p]], p
    assert {r["phrase"]: r["count"] for r in A.phrase_hits(df, "t", phrases).collect()} == {p: sum(h) for p, h in holds.items()}
    flags = X.flag_phrases(df, "t", [p for p in phrases if len(p) > 3]).orderBy("id").collect()
    assert [r["misinfo_class"] for r in flags] == [any(holds[p][i] for p in phrases if len(p) > 3) for i in range(len(texts))]


def test_phrases_share_a_tree():
    assert X.phrase_pattern(["ab"]) == "ab"
    assert X.phrase_pattern(["abc", "abd", "ab", "x"]) == "(?:ab(?:c|d)?|x)"
