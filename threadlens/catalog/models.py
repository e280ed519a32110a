"""Topics, sentiment, statistics, classifier and clusters (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens import constants as K
from threadlens.catalog import views as V
from threadlens.catalog.registry import normal_equations, query
from threadlens.catalog.relational import labelled
from threadlens.functions.calendar import add_time_columns
from threadlens.functions.labels import map_labels
from threadlens.functions.text import term_dummies
from threadlens.operators import aggregates as A
from threadlens.operators import classify as M
from threadlens.operators import stats as S
from threadlens.operators.cluster import cluster_titles
from threadlens.operators.cooccurrence import cooccurrence
from threadlens.operators.joins import join_series
from threadlens.operators.regression import linear_regression
from threadlens.operators.reshape import split_column
from threadlens.operators.sentiment import WORDS, Lexicon, score_both, score_sentiment
from threadlens.operators.skew import join_unique
from threadlens.operators.topics import assign_topic, describe_topics, fit_topics, match_topics, seed_scores, title_tokens, topic_weights


def topic_model(spark, sf):
    # The given titles are few; 25 of them rarely share a word.
    return fit_topics(V.posts(spark, sf), "title", min_df=2)


@query("l1_fit_topics")
def l1(spark, sf):
    model = topic_model(spark, sf)
    mixed = model.transform(V.posts(spark, sf))
    from pyspark.ml.functions import vector_to_array

    spread = F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight")
    return mixed.select("id", spread).groupBy("topic").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("titles"))


@query("l2_describe_topics")
def l2(spark, sf):
    return describe_topics(topic_model(spark, sf))


@query("l3_assign_topic")
def l3(spark, sf):
    return assign_topic(topic_model(spark, sf), V.posts(spark, sf)).select("id", "created_utc", "title", "topic_num", "topic")


#: Words of the invented titles by which four groups of posts are told.
SEEDS = {"first": ["th", "ti", "er"], "second": ["la", "de", "ou", "th"], "third": ["st", "on", "de"], "fourth": ["qu", "in", "an", "re"]}
_SEED_ROWS = ", ".join(f"('{name}', '{w}', 1e0 / {sum(w in ws for ws in SEEDS.values())})" for name, words in SEEDS.items() for w in words)
_SEED_SCORES = f"""(SELECT t.topic, s.name, coalesce(sum(o.owned * s.part), 0e0) AS score
    FROM (SELECT DISTINCT CAST(id AS BIGINT) % 4 AS topic FROM title_parts) t CROSS JOIN (VALUES {_SEED_ROWS}) s(name, term, part)
    LEFT JOIN (SELECT topic, term, share / sum(share) OVER (PARTITION BY term) AS owned FROM
        (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS share FROM
            (SELECT CAST(id AS BIGINT) % 4 AS topic, term, CAST(count(*) AS DOUBLE) AS n FROM title_parts GROUP BY ALL))) o
    ON o.topic = t.topic AND o.term = s.term GROUP BY t.topic, s.name)"""


@query("l3_match_topics", f"""
    SELECT unnest([0, 1, 2, 3])::BIGINT AS topic, unnest([a, b, c, d]) AS name, round(unnest([sa, sb, sc, sd]), 6) AS score
    FROM (SELECT w.name AS a, x.name AS b, y.name AS c, z.name AS d, w.score AS sa, x.score AS sb, y.score AS sc, z.score AS sd
          FROM {_SEED_SCORES} w JOIN {_SEED_SCORES} x ON w.topic = 0 AND x.topic = 1 AND x.name <> w.name
          JOIN {_SEED_SCORES} y ON y.topic = 2 AND y.name NOT IN (w.name, x.name)
          JOIN {_SEED_SCORES} z ON z.topic = 3 AND z.name NOT IN (w.name, x.name, y.name)
          ORDER BY sa + sb + sc + sd DESC LIMIT 1)""", "title_parts")
def l3_match(spark, sf):
    """Four groups of titles named by their seed words, one name each."""
    parts = F.regexp_extract_all(F.lower("title"), F.lit("[a-zà-ÿ]{2}"), F.lit(0))
    weights = V.posts(spark, sf).select((F.col("id").cast("long") % 4).alias("topic"), F.explode(parts).alias("term")).withColumn("weight", F.lit(1.0))
    names = match_topics(weights, SEEDS)
    scores = seed_scores(weights, SEEDS)
    return scores.where(map_labels("topic", names) == F.col("name")).withColumn("score", F.round("score", 6))


@query("l3_named_topics")
def l3_named(spark, sf):
    """Titles by fitted topic, named by seed words in place of the topic's number."""
    model = topic_model(spark, sf)
    names = match_topics(topic_weights(model))
    return assign_topic(model, V.posts(spark, sf), names).select("id", "topic_num", "topic")


@query("l4_valence_sentiment", "SELECT id, round(CAST(vader_score AS DOUBLE), 4) AS vader_score FROM scores", "scores")
def l4(spark, sf):
    rows = score_sentiment(V.spread_comments(spark, sf), "body", V.lexicon(spark, sf), "valence", rules=V.RULES)
    return rows.select("id", F.round(F.col("vader_score").cast("double"), 4).alias("vader_score"))


@query("l4_valence_joined", "SELECT id, round(CAST(vader_score AS DOUBLE), 4) AS vader_score FROM scores", "scores")
def l4_joined(spark, sf):
    rows = score_sentiment(V.comments(spark, sf), "body", V.lexicon(spark, sf), "valence", rules=V.RULES, inline_limit=0)
    return rows.select("id", F.round(F.col("vader_score").cast("double"), 4).alias("vader_score"))


@query("l5_polarity_joined", "SELECT id, round(CAST(textblob_score AS DOUBLE), 5) AS textblob_score FROM scores", "scores")
def l5_joined(spark, sf):
    rows = score_sentiment(V.comments(spark, sf), "body", V.lexicon(spark, sf), "polarity", inline_limit=0)
    return rows.select("id", F.round(F.col("textblob_score").cast("double"), 5).alias("textblob_score"))


@query("l5_polarity_sentiment", "SELECT id, round(CAST(textblob_score AS DOUBLE), 5) AS textblob_score FROM scores", "scores")
def l5(spark, sf):
    rows = score_sentiment(V.spread_comments(spark, sf), "body", V.lexicon(spark, sf), "polarity")
    return rows.select("id", F.round(F.col("textblob_score").cast("double"), 5).alias("textblob_score"))


def scored_comments(spark, sf):
    return V.scored(spark, sf, V.spread_comments(spark, sf))


@query("l6_describe_scores", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev,
           round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM scores"""
    for c in ("vader_score", "textblob_score")), "scores")
def l6(spark, sf):
    stats = S.describe_scores(scored_comments(spark, sf), ["vader_score", "textblob_score"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "min", "max")})


_IDIOM_SQL = """
    SELECT c.id, round(CAST(CAST(greatest(-1e0, least(1e0, round(t / sqrt(t * t + 15e0), 4))) AS FLOAT) AS DOUBLE), 4) AS vader_score,
           round(CAST(CAST(coalesce(p.m, 0e0) AS FLOAT) AS DOUBLE), 4) AS textblob_score
    FROM (SELECT c.id, s + sign(s) * (least(bangs, 4) * 0.292e0 + CASE WHEN asks <= 1 THEN 0e0 WHEN asks <= 3 THEN asks * 0.18e0 ELSE 0.96e0 END) AS t
          FROM (SELECT c.id, coalesce(v.s, 0e0) AS s, length(body) - length(replace(body, '!', '')) AS bangs, length(body) - length(replace(body, '?', '')) AS asks
                FROM comments c LEFT JOIN (SELECT id, sum(v ORDER BY pos) AS s FROM idiom_valence GROUP BY id) v ON v.id = c.id) c) c
    LEFT JOIN (SELECT id, sum(valence ORDER BY pos) / count(*) AS m FROM idiom_chain GROUP BY id) p ON p.id = c.id"""


def idiom_scores(spark, sf, comments, inline_limit):
    words = Lexicon.of(V.idiom_lexicon(spark, sf), inline_limit, phrase_words=3)
    rows = score_both(comments, "body", words, V.RULES)
    return rows.select("id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("vader_score", "textblob_score")])


@query("l4_idiom_scores", _IDIOM_SQL, ("comments", "idiom_valence", "idiom_chain"))
def l4_idioms(spark, sf):
    """Both scores with a lexicon that holds entries of two and three words."""
    return idiom_scores(spark, sf, V.spread_comments(spark, sf), 20_000)


@query("l4_idiom_scores_joined", _IDIOM_SQL, ("comments", "idiom_valence", "idiom_chain"))
def l4_idioms_joined(spark, sf):
    return idiom_scores(spark, sf, V.comments(spark, sf), 0)


@query("l7_correlation", "SELECT round(corr(CAST(vader_score AS DOUBLE), CAST(textblob_score AS DOUBLE)), 6) AS corr FROM scores", "scores")
def l7(spark, sf):
    return S.correlation(scored_comments(spark, sf), "vader_score", "textblob_score").select(F.round("corr", 6).alias("corr"))


_SUMMARY_SQL = """
    SELECT 'count' AS summary, CAST(count(score) AS DOUBLE) AS score FROM comments
    UNION ALL SELECT 'mean', round(avg(score), 6) FROM comments
    UNION ALL SELECT 'stddev', round(stddev_samp(score), 6) FROM comments
    UNION ALL SELECT 'min', min(score) FROM comments
    UNION ALL SELECT '25%', quantile_disc(score, 0.25) FROM comments
    UNION ALL SELECT '50%', quantile_disc(score, 0.5) FROM comments
    UNION ALL SELECT '75%', quantile_disc(score, 0.75) FROM comments
    UNION ALL SELECT 'max', max(score) FROM comments"""


def numeric_summary(spark, sf):
    rows = S.score_summary(V.comments(spark, sf), "score")
    return rows.select("summary", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("l8_score_summary", _SUMMARY_SQL, "comments")
def l8(spark, sf):
    return numeric_summary(spark, sf)


def weekly_series(spark, sf):
    """Discussion and external measures by calendar week, the external days moved into the comments' years."""
    daily = V.epidemiology(spark, sf).withColumn("date", F.expr("date + make_dt_interval(9131)"))
    external = A.rollup_sums(add_time_columns(daily), K.EPIDEMIOLOGY_MEASURES, "week")
    dated = add_time_columns(V.flagged_comments(spark, sf), "created_utc")
    discussion = dated.groupBy("year", "week").agg(
        F.count(F.lit(1)).alias("comments_count"), F.count_if("misinfo_class").alias("misinfo_count"))
    return join_series(discussion, external, ["year", "week"])


SERIES = ["comments_count", "misinfo_count", "sum_new_confirmed", "sum_new_deceased"]
SERIES_SQL = """(SELECT * FROM
    (SELECT year(created_utc) AS year, week(created_utc) AS week, count(*) AS comments_count,
            count(*) FILTER (misinfo_class) AS misinfo_count FROM flagged GROUP BY 1, 2)
    JOIN (SELECT year(date) AS year, week(date) AS week, sum(new_confirmed) AS sum_new_confirmed, sum(new_deceased) AS sum_new_deceased
          FROM (SELECT date + to_days(9131) AS date, new_confirmed, new_deceased FROM epi) GROUP BY 1, 2) USING (year, week))"""
MATRIX_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM {SERIES_SQL}"
    for a in SERIES for b in SERIES)


@query("l9_correlation_matrix", MATRIX_SQL, ("flagged", "epi"))
def l9(spark, sf):
    return S.correlation_matrix(weekly_series(spark, sf), SERIES).withColumn("corr", F.round("corr", 6))


_Y, _X1, _X2 = (f"CAST({c} AS DOUBLE)" for c in ("comments_count", "sum_new_confirmed", "sum_new_deceased"))


@query("l10_simple_regression", f"""
    SELECT round(regr_slope({_Y}, {_X2}), 6) AS slope, round(regr_intercept({_Y}, {_X2}), 6) AS intercept,
           round(regr_r2({_Y}, {_X2}), 6) AS r2,
           round((1 - regr_r2({_Y}, {_X2})) * regr_syy({_Y}, {_X2}) / regr_count({_Y}, {_X2}), 6) AS mse FROM {SERIES_SQL}""", ("flagged", "epi"))
def l10(spark, sf):
    fit = S.simple_regression(weekly_series(spark, sf), "comments_count", "sum_new_deceased")
    return fit.select(*[F.round(c, 6).alias(c) for c in fit.columns])


# Two-feature least squares in closed form: R² from the three pairwise correlations.
_R2 = "((ry1 * ry1 + ry2 * ry2 - 2 * ry1 * ry2 * r12) / (1 - r12 * r12))"


@query("l10_series_regression", f"""
    SELECT round((1 - {_R2}) * v, 4) AS mse, round({_R2}, 6) AS r2
    FROM (SELECT corr({_Y}, {_X1}) AS ry1, corr({_Y}, {_X2}) AS ry2, corr({_X1}, {_X2}) AS r12, var_pop({_Y}) AS v FROM {SERIES_SQL})""", ("flagged", "epi"))
def l10_two(spark, sf):
    fit = S.series_regression(weekly_series(spark, sf), "comments_count", ["sum_new_confirmed", "sum_new_deceased"])
    return fit.select(F.round("mse", 4).alias("mse"), F.round("r2", 6).alias("r2"))


_YEARLY = "(SELECT year(date) AS year, new_deceased, new_confirmed, dayofyear(date) AS day FROM epi)"


@query("l10_regression_by_year", f"""
    SELECT year, n, feature, round(coefficient, 6) AS coefficient, round(intercept, 4) AS intercept, round(r2, 6) AS r2
    FROM (SELECT *, 'new_confirmed' AS feature, b0 AS coefficient FROM {normal_equations(_YEARLY, "new_deceased", ["new_confirmed", "day"], "year")}
          UNION ALL SELECT *, 'day', b1 FROM {normal_equations(_YEARLY, "new_deceased", ["new_confirmed", "day"], "year")})""", "epi")
def l10_by_year(spark, sf):
    daily = V.epidemiology(spark, sf).select(F.year("date").cast("long").alias("year"), "new_deceased", "new_confirmed", F.dayofyear("date").alias("day"))
    fit = linear_regression(daily, "new_deceased", ["new_confirmed", "day"], ["year"])
    return fit.select("year", "n", "intercept", "r2", F.inline("terms")).select(
        "year", "n", "feature", *[F.round(c, d).alias(c) for c, d in (("coefficient", 6), ("intercept", 4), ("r2", 6))])


def classified(spark, sf):
    """Articles with their predicted label, fitted on the training part."""
    articles = term_dummies(labelled(spark, sf), "title", K.TITLE_TERMS)
    part = split_column("id", [0.8, 0.18, 0.02])
    terms = list(dict.fromkeys(K.TITLE_TERMS))
    rows = articles.withColumn("part", part)
    model = M.fit_classifier(rows.filter(F.col("part") == 0), "label", terms)
    return model.transform(rows)


@query("l11_classifier")
def l11(spark, sf):
    return classified(spark, sf).select("id", "part", "label", "predictedMisinfo")


@query("l12_accuracy", "SELECT round(avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(1 - avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END), 6) AS error FROM predictions", "predictions")
def l12(spark, sf):
    return M.accuracy(V.predictions(spark, sf), "label", "prediction").select(F.round("accuracy", 6).alias("accuracy"), F.round("error", 6).alias("error"))


@query("l13_auc_of_predictions", """
    SELECT round((count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (label = 1)
                + count(*) FILTER (label = 0 AND prediction = 0) / count(*) FILTER (label = 0)) / 2, 6) AS auc FROM predictions""", "predictions")
def l13(spark, sf):
    return M.auc_of_predictions(V.predictions(spark, sf), "label", "prediction").select(F.round("auc", 6).alias("auc"))


@query("l13_auc_of_scores", """
    SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
                 / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)), 6) AS auc
    FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r
          FROM (SELECT CAST(misinfo_class AS INTEGER) AS y, score FROM flagged))""", "flagged")
def l13_scores(spark, sf):
    rows = V.flagged_comments(spark, sf).withColumn("y", F.col("misinfo_class").cast("int"))
    return M.auc(rows, "y", "score").select(F.round("auc", 6).alias("auc"))


@query("l14_title_clusters")
def l14(spark, sf):
    return cluster_titles(V.posts_with_topic(spark, sf)).groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))


@query("l15_cooccurrence", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS count FROM posts WHERE contains(title, '{a}') AND contains(title, '{b}') HAVING count(*) > 0"
    for a in sorted(V.TERMS) for b in sorted(V.TERMS) if a < b), "posts")
def l15(spark, sf):
    return S.term_cooccurrence(V.posts(spark, sf), "title", list(V.TERMS))


def _pairs_sql(words: str, least: int) -> str:
    return (f"SELECT x.word AS a, y.word AS b, count(*) AS count FROM ({words}) x JOIN ({words}) y ON x.id = y.id AND x.word < y.word "
            f"GROUP BY ALL HAVING count(*) >= {least}")


@query("l15_item_pairs", _pairs_sql("SELECT DISTINCT id, unnest(tokens) AS word FROM title_words", 2), "title_words")
def l15_items(spark, sf):
    words = title_tokens(V.posts(spark, sf), "title", list(V.STOP_WORDS)).select("id", F.explode("tokens").alias("word"))
    return cooccurrence(words, "id", "word", min_count=2)


@query("l15_text_word_pairs", _pairs_sql(
    "SELECT DISTINCT c.id, w.word FROM (SELECT id, lower(raw) AS word FROM body_words) c JOIN lexicon w USING (word)", 20), ("body_words", "lexicon"))
def l15_text_words(spark, sf):
    """Words of the lexicon that stand together in at least 20 comments."""
    said = V.spread_comments(spark, sf).select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(WORDS), F.lit(0)))).alias("word"))
    listed = V.lexicon(spark, sf).select("word")
    return cooccurrence(join_unique(said, listed, "word"), "id", "word", min_count=20)
