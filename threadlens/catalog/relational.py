"""Projections, predicates, joins, aggregates, ranks and reshaping (P, J, A, W, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens import constants as K
from threadlens.catalog import views as V
from threadlens.catalog.registry import query
from threadlens.functions.calendar import add_period_labels, add_time_columns
from threadlens.functions.labels import below, count_if, flag_to_int, label_by_count
from threadlens.functions.text import flag_phrases, news_source, term_dummies
from threadlens.operators import aggregates as A
from threadlens.operators import joins as J
from threadlens.operators import reshape as U
from threadlens.operators.classify import label_articles
from threadlens.operators.filters import (
    drop_missing_source, exclude_containing, flagged, keep, negative_flagged, table_shape)
from threadlens.operators.ranking import add_rank_max, skip_top, top_k, top_n_per_group
from threadlens.sources.sinks import store

_PHRASE_RE = "|".join(V.PHRASES)


def sourced(spark, sf):
    return drop_missing_source(V.posts(spark, sf).withColumn("source", news_source("url")))


def labelled(spark, sf):
    """Article labels next to their topic."""
    return J.attach_titles(label_articles(V.facts(spark, sf)), V.facts(spark, sf))


_LABELS = """
    SELECT id, CAST(sum(CASE WHEN misinfo_class THEN 1 ELSE 0 END) AS BIGINT) AS true_count,
           CASE WHEN sum(CASE WHEN misinfo_class THEN 1 ELSE 0 END) > 0 THEN 'perceived misinfo'
                ELSE 'no perceived misinfo' END AS label, any_value(title) AS title, any_value(topic) AS topic
    FROM facts GROUP BY id"""


def _bucket(col: str, salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}:' || CAST({col} AS VARCHAR)), 1, 8) AS BIGINT))"


# Projections and predicates ---------------------------------------------------------------------

@query("p1_projection", "SELECT title, url, subreddit, score, num_comments FROM posts", "posts")
def p1(spark, sf):
    return V.posts(spark, sf).select("title", "url", "subreddit", "score", "num_comments")


@query("p2_add_column", "SELECT id, CAST(year(created_utc) AS INTEGER) AS year, upper(subreddit) AS subreddit FROM posts", "posts")
def p2(spark, sf):
    return V.posts(spark, sf).withColumns({"year": F.year("created_utc"), "subreddit": F.upper("subreddit")}).select("id", "year", "subreddit")


@query("p3_rename", "SELECT id, created_utc AS posts_created FROM posts", "posts")
def p3(spark, sf):
    return V.posts(spark, sf).select("id", "created_utc").withColumnRenamed("created_utc", "posts_created")


@query("p4_drop", "SELECT id, author, score, created_utc FROM comments", "comments")
def p4(spark, sf):
    return V.comments(spark, sf).drop("body", "link_id", "source")


@query("p5_equality_or", "SELECT id, subreddit FROM posts WHERE subreddit = 'news' OR subreddit = 'worldnews'", "posts")
def p5(spark, sf):
    return keep(V.posts(spark, sf), (F.col("subreddit") == "news") | (F.col("subreddit") == "worldnews")).select("id", "subreddit")


@query("p6_year_not_equal", """SELECT subreddit, CAST(year(created_utc) AS INTEGER) AS year, count(*) AS count FROM posts
    WHERE year(created_utc) <> 2022 GROUP BY 1, 2""", "posts")
def p6(spark, sf):
    dated = V.posts(spark, sf).withColumn("year", F.year("created_utc"))
    return A.count_by(dated.filter(F.col("year") != 2022), "subreddit", "year")


@query("p7_missing_source", "SELECT id, source FROM sourced", "sourced")
def p7(spark, sf):
    return sourced(spark, sf).select("id", "source")


@query("p8_exclude_containing", "SELECT id, topic FROM topic_posts WHERE NOT (contains(topic, 'demographic info') OR contains(topic, 'tv shows'))", "topic_posts")
def p8(spark, sf):
    return exclude_containing(V.posts_with_topic(spark, sf), "topic", K.UNCLUSTERED_TOPICS).select("id", "topic")


@query("p9_boolean_filter", "SELECT id FROM flagged WHERE misinfo_class", "flagged")
def p9(spark, sf):
    return flagged(V.flagged_comments(spark, sf)).select("id")


@query("p10_negative_flagged", "SELECT comment_id FROM scored_facts WHERE vader_score < 0 AND misinfo_class", "scored_facts")
def p10(spark, sf):
    return negative_flagged(V.scored_facts(spark, sf)).select("comment_id")


@query("p11_phrase_flag", f"SELECT id, coalesce(regexp_matches(body, '{_PHRASE_RE}'), false) AS misinfo_class FROM comments", "comments")
def p11(spark, sf):
    return flag_phrases(V.comments(spark, sf), "body", V.PHRASES).select("id", "misinfo_class")


@query("p12_flag_to_int", "SELECT id, CAST(misinfo_class AS INTEGER) AS flag FROM flagged", "flagged")
def p12(spark, sf):
    return V.flagged_comments(spark, sf).select("id", flag_to_int("misinfo_class").alias("flag"))


@query("p13_threshold_flag", "SELECT id, CAST(score < 100 AS INTEGER) AS low FROM comments", "comments")
def p13(spark, sf):
    return V.comments(spark, sf).select("id", below("score", 100).alias("low"))


@query("p14_label_from_count", """SELECT link_id, CASE WHEN count(*) FILTER (misinfo_class) > 0 THEN 'perceived misinfo'
    ELSE 'no perceived misinfo' END AS label FROM flagged GROUP BY link_id""", "flagged")
def p14(spark, sf):
    counts = V.flagged_comments(spark, sf).groupBy("link_id").agg(count_if(F.col("misinfo_class")).alias("n"))
    return counts.select("link_id", label_by_count("n", K.PERCEIVED, K.NOT_PERCEIVED).alias("label"))


_DUMMY_TERMS = list(dict.fromkeys(K.TITLE_TERMS))


@query("p15_term_dummies", "SELECT id, " + ", ".join(
    f"CAST(contains(title, '{t}') AS INTEGER) AS \"{t}\"" for t in _DUMMY_TERMS) + " FROM posts", "posts")
def p15(spark, sf):
    return term_dummies(V.posts(spark, sf).select("id", "title"), "title", K.TITLE_TERMS).drop("title")


@query("p16_table_shape", "SELECT count(*) AS rows, CAST(8 AS INTEGER) AS columns FROM posts", "posts")
def p16(spark, sf):
    return table_shape(V.posts(spark, sf))


# Joins -----------------------------------------------------------------------------------------

@query("j1_posts_topic", "SELECT id, created_utc, title, topic FROM topic_posts", "topic_posts")
def j1(spark, sf):
    return V.posts_with_topic(spark, sf).select("id", "created_utc", "title", "topic")


@query("j2_posts_comments", "SELECT id, comment_id, title, comment_created, misinfo_class, length(body) AS chars FROM facts", "facts")
def j2(spark, sf):
    return V.facts(spark, sf).select("id", "comment_id", "title", "comment_created", "misinfo_class", F.length("body").cast("long").alias("chars"))


@query("j3_saved_topics", """SELECT f.comment_id, f.id, f.topic, c.created_utc,
    length(trim(regexp_replace(lower(c.body), '[^a-zA-Z0-9\\s]', '', 'g'), ' ')) AS chars
    FROM facts f JOIN comments c ON f.comment_id = c.id AND f.id = regexp_extract(c.link_id, 't3_(.*)$', 1)""", "facts")
def j3(spark, sf):
    from threadlens.functions.text import clean_text

    saved = V.facts(spark, sf).drop("body")
    cleaned = flag_phrases(clean_text(V.comments(spark, sf)), "body", V.PHRASES)
    return J.join_saved_topics(saved, cleaned).select("comment_id", "id", "topic", "created_utc", F.length("body").cast("long").alias("chars"))


@query("j4_outer_series", """
    SELECT year, month, CAST(e.c AS DOUBLE) AS sum_new_confirmed, CAST(v.d AS DOUBLE) AS sum_new_vaccine_doses_administered
    FROM (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, sum(new_confirmed) AS c FROM epi GROUP BY 1, 2) e
    FULL JOIN (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
                      sum(new_vaccine_doses_administered) AS d FROM vac GROUP BY 1, 2) v USING (year, month)""", ("epi", "vac"))
def j4(spark, sf):
    left = A.rollup_sums(add_time_columns(V.epidemiology(spark, sf)), ["new_confirmed"], "month")
    right = A.rollup_sums(add_time_columns(V.vaccinations(spark, sf)), ["new_vaccine_doses_administered"], "month")
    both = J.outer_join_series(left, right, ["year", "month"])
    return both.select("year", "month", F.col("sum_new_confirmed").cast("double"), F.col("sum_new_vaccine_doses_administered").cast("double"))


@query("j5_totals_with_flagged", """
    SELECT year_month, total_posts, misinfo_posts
    FROM (SELECT strftime(created_utc, '%Y/%m') AS year_month, count(*) AS total_posts FROM flagged GROUP BY 1) t
    FULL JOIN (SELECT strftime(created_utc, '%Y/%m') AS year_month, count(*) AS misinfo_posts FROM flagged
               WHERE misinfo_class GROUP BY 1) m USING (year_month)""", "flagged")
def j5(spark, sf):
    dated = add_period_labels(add_time_columns(V.flagged_comments(spark, sf), "created_utc"))
    totals = A.period_counts(dated, "year_month").withColumnRenamed("count", "total_posts")
    hits = A.period_counts(dated, "year_month", flagged_only=True).withColumnRenamed("count", "misinfo_posts")
    return J.outer_join_series(totals, hits, ["year_month"])


@query("j6_weekday_join", """
    SELECT dayname(DATE '2023-01-01' + CAST(day AS INTEGER)) AS day, comments_count, submissions_count
    FROM (SELECT dayofweek(created_utc) AS day, count(*) AS comments_count FROM comments GROUP BY 1)
    JOIN (SELECT dayofweek(created_utc) AS day, count(*) AS submissions_count FROM posts GROUP BY 1) USING (day)""", ("comments", "posts"))
def j6(spark, sf):
    return J.weekday_activity(V.comments(spark, sf), V.posts(spark, sf))


@query("j7_labels_titles", _LABELS, "facts")
def j7(spark, sf):
    return labelled(spark, sf)


@query("j8_series_join", """
    SELECT year, week, comments_count, CAST(n AS DOUBLE) AS sum_value
    FROM (SELECT CAST(year(created_utc) AS INTEGER) AS year, CAST(week(created_utc) AS INTEGER) AS week,
                 count(*) AS comments_count FROM comments GROUP BY 1, 2)
    JOIN (SELECT CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week, sum(new_confirmed) AS n
          FROM (SELECT date + to_days(9131) AS date, new_confirmed FROM epi) GROUP BY 1, 2) USING (year, week)""", ("comments", "epi"))
def j8(spark, sf):
    daily = V.epidemiology(spark, sf).withColumn("date", F.expr("date + make_dt_interval(9131)"))
    external = A.rollup_sums(add_time_columns(daily), ["new_confirmed"], "week")
    dated = add_time_columns(V.comments(spark, sf), "created_utc")
    series = A.count_by(dated, "year", "week").withColumnRenamed("count", "comments_count")
    return J.join_series(series, external, ["year", "week"]).select(
        "year", "week", "comments_count", F.col("sum_new_confirmed").cast("double").alias("sum_value"))


# Aggregates ------------------------------------------------------------------------------------

@query("a1_source_totals", "SELECT source, count(source) AS frequency, CAST(sum(score) AS BIGINT) AS total_score FROM sourced GROUP BY source", "sourced")
def a1(spark, sf):
    return A.source_totals(sourced(spark, sf))


@query("a2_source_community_totals", "SELECT * FROM totals_by_community", "totals_by_community")
def a2(spark, sf):
    return A.source_totals(sourced(spark, sf), ["source", "subreddit"])


@query("a3_count_by_keys", "SELECT topic, misinfo_class, count(*) AS count FROM facts GROUP BY 1, 2", "facts")
def a3(spark, sf):
    return A.count_by(V.facts(spark, sf), "topic", "misinfo_class")


@query("a4_count_by_calendar", """
    SELECT 'year' AS part, CAST(year(created_utc) AS INTEGER) AS value, count(*) AS count FROM comments GROUP BY 1, 2
    UNION ALL SELECT 'day', CAST(dayofweek(created_utc) + 1 AS INTEGER), count(*) FROM comments GROUP BY 1, 2""", "comments")
def a4(spark, sf):
    rows = V.comments(spark, sf)
    years = A.count_by_calendar(rows, "created_utc", "year").select(F.lit("year").alias("part"), F.col("year").alias("value"), "count")
    days = A.count_by_calendar(rows, "created_utc", "day").select(F.lit("day").alias("part"), F.col("day").alias("value"), "count")
    return U.union_rows(years, days)


@query("a5_active_authors", "SELECT author, count(*) AS submission_count FROM posts GROUP BY author HAVING count(*) > 14", "posts")
def a5(spark, sf):
    return A.active_authors(V.posts(spark, sf), 14)


@query("a7_rollup_sums", """
    SELECT CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
           CAST(sum(new_confirmed) AS DOUBLE) AS sum_new_confirmed, CAST(sum(new_deceased) AS BIGINT) AS sum_new_deceased
    FROM epi GROUP BY 1, 2""", "epi")
def a7(spark, sf):
    sums = A.rollup_sums(add_time_columns(V.epidemiology(spark, sf)), K.EPIDEMIOLOGY_MEASURES, "week")
    return sums.withColumn("sum_new_confirmed", F.col("sum_new_confirmed").cast("double"))


_SUMMARY = """
    SELECT CAST(year(comment_created) AS VARCHAR) || '/' || lpad(CAST({part}(comment_created) AS VARCHAR), 2, '0') AS {label},
           CAST(sum(CAST(vader_score AS DECIMAL(12,6))) AS DOUBLE) AS sum_vader_score,
           CAST(sum(CAST(textblob_score AS DECIMAL(12,6))) AS DOUBLE) AS sum_textblob_score,
           count(DISTINCT id) AS posts_count, count(DISTINCT comment_id) AS comments_count{extra}
    FROM scored_facts {where} GROUP BY 1"""
_MISINFO_SUM = ", CAST(sum(CASE WHEN misinfo_class THEN 1 ELSE 0 END) AS BIGINT) AS misinfo_count"


def scored_periods(spark, sf):
    dated = add_period_labels(add_time_columns(V.scored_facts(spark, sf), "comment_created"))
    return dated.withColumns({c: V.exact(c) for c in ("vader_score", "textblob_score")})


def as_doubles(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("sum_vader_score", "sum_textblob_score")})


@query("a8_period_summary", _SUMMARY.format(part="week", label="year_week", extra=_MISINFO_SUM, where=""), "scored_facts")
def a8(spark, sf):
    return as_doubles(A.period_summary(scored_periods(spark, sf), "year_week"))


@query("a9_flagged_summary", _SUMMARY.format(part="month", label="year_month", extra="", where="WHERE misinfo_class"), "scored_facts")
def a9(spark, sf):
    return as_doubles(A.period_summary(scored_periods(spark, sf), "year_month", flagged_only=True))


@query("a10_period_distinct", """
    SELECT strftime(comment_created, '%Y/%m') AS year_month, count(DISTINCT comment_id) AS count FROM facts GROUP BY 1""", "facts")
def a10(spark, sf):
    dated = add_period_labels(add_time_columns(V.facts(spark, sf), "comment_created"))
    return A.period_counts(dated, "year_month", distinct_col="comment_id")


@query("a11_conditional_count", "SELECT source, count(*) FILTER (misinfo_class) AS hits FROM flagged GROUP BY source", "flagged")
def a11(spark, sf):
    return V.flagged_comments(spark, sf).groupBy("source").agg(count_if(F.col("misinfo_class")).alias("hits"))


_SHARE = """
    SELECT topic, count(comment_id) AS total_comments,
           CAST(sum(CASE WHEN vader_score < {t} THEN 1 ELSE 0 END) AS BIGINT) AS {n},
           round(sum(CASE WHEN vader_score < {t} THEN 1 ELSE 0 END) / count(comment_id) * 100, 6) AS {p}
    FROM scored_facts WHERE misinfo_class GROUP BY topic"""


@query("a12_share_below", _SHARE.format(t="0", n="negative_vader_count", p="percentage_neg_vader"), "scored_facts")
def a12(spark, sf):
    shares = A.share_below(flagged(V.scored_facts(spark, sf)), "topic", "vader_score", 0, "negative_vader_count", "percentage_neg_vader")
    return shares.withColumn("percentage_neg_vader", F.round("percentage_neg_vader", 6))


@query("a13_score_histogram", """SELECT round(CAST(vader_score AS DOUBLE), 4) AS vader_score, count(*) AS count
    FROM scored_facts WHERE misinfo_class GROUP BY 1""", "scored_facts")
def a13(spark, sf):
    exact_scores = A.score_histogram(flagged(V.scored_facts(spark, sf)))
    return exact_scores.withColumn("vader_score", F.round(F.col("vader_score").cast("double"), 4))


BIN_EDGES = [i / 10 - 1 for i in range(11)]
BIN_SQL = """
    SELECT CAST(i AS INTEGER) AS bin, printf('[%.1f~%.1f]', (i - 10) / 10, (i - 9) / 10) AS binned, CAST(coalesce(n, 0) AS BIGINT) AS count
    FROM range(10) AS r(i) LEFT JOIN (
      SELECT greatest(0, CAST(ceil(round((round(CAST(vader_score AS DOUBLE), 4) + 1) * 10, 6)) AS BIGINT) - 1) AS b, count(*) AS n
      FROM {view} WHERE vader_score <= 0 GROUP BY 1) ON b = i"""


@query("a14_binned_histogram", BIN_SQL.format(view="scores"), "scores")
def a14(spark, sf):
    exact_scores = A.score_histogram(V.scored(spark, sf, V.spread_comments(spark, sf)))
    return A.binned_histogram(exact_scores, "vader_score", "count", BIN_EDGES)


@query("a15_prediction_analysis", """
    SELECT topic, count(*) FILTER (label = prediction) AS "true label", count(*) FILTER (label <> prediction) AS "false label",
           count(*) FILTER (label <> prediction AND label = 0) AS "incorrectly labeled as misinfo",
           count(*) FILTER (label <> prediction AND label = 1) AS "incorrectly labeled as no misinfo",
           round(count(*) FILTER (label = prediction) / count(*), 6) AS "true ratio",
           round(count(*) FILTER (label <> prediction AND label = 1) / nullif(count(*) FILTER (label <> prediction), 0), 6)
             AS "incorrectly labeled misinfo ratio"
    FROM predictions GROUP BY topic""", "predictions")
def a15(spark, sf):
    table = A.prediction_analysis(V.predictions(spark, sf), "topic", "label", "prediction", 0, 1)
    return table.withColumns({c: F.round(c, 6) for c in ("true ratio", "incorrectly labeled misinfo ratio")})


@query("a16_confusion_matrix", """SELECT label, count(*) FILTER (prediction = 0) AS pred_0, count(*) FILTER (prediction = 1) AS pred_1
    FROM predictions GROUP BY label""", "predictions")
def a16(spark, sf):
    return A.confusion_matrix(V.predictions(spark, sf), "label", "prediction", [0, 1])


@query("a17_share_of_total", """
    SELECT topic, misinfo_class, n AS count, round(n / sum(n) OVER (PARTITION BY topic) * 100, 6) AS share_of_topic,
           round(n / sum(n) OVER () * 100, 6) AS share
    FROM (SELECT topic, misinfo_class, count(*) AS n FROM facts GROUP BY 1, 2)""", "facts")
def a17(spark, sf):
    counts = store(A.count_by(V.facts(spark, sf), "topic", "misinfo_class"), "topic-flags")
    shares = A.share_of_total(A.share_of_total(counts, "count"), "count", "topic", "share_of_topic")
    return shares.withColumns({c: F.round(c, 6) for c in ("share", "share_of_topic")})


@query("a18_phrase_hits", " UNION ALL ".join(
    f"SELECT '{p}' AS phrase, count(*) FILTER (contains(body, '{p}')) AS count FROM comments" for p in V.PHRASES), "comments")
def a18(spark, sf):
    return A.phrase_hits(V.comments(spark, sf), "body", V.PHRASES)


_MANY = "(SELECT unnest([" + ", ".join(f"'{p}'" for p in V.MANY_PHRASES) + "]) AS phrase)"


@query("a18_many_phrases", f"SELECT phrase, count(c.id) AS count FROM {_MANY} LEFT JOIN comments c ON contains(body, phrase) GROUP BY phrase", "comments")
def a18_many(spark, sf):
    """Texts that hold each of 1,100 phrases, found in one pass over the texts."""
    return A.phrase_hits(V.spread_comments(spark, sf), "body", V.MANY_PHRASES)


@query("p11_many_phrases", f"SELECT id, EXISTS (FROM {_MANY} WHERE contains(title, phrase)) AS misinfo_class FROM posts", "posts")
def p11_many(spark, sf):
    return flag_phrases(V.posts(spark, sf), "title", V.MANY_PHRASES).select("id", "misinfo_class")


@query("a19_flag_rate", """
    SELECT CAST(year(created_utc) AS INTEGER) AS year, count(*) AS total, count(*) FILTER (misinfo_class) AS flagged,
           round(count(*) FILTER (misinfo_class) / count(*), 6) AS rate FROM flagged GROUP BY 1""", "flagged")
def a19(spark, sf):
    rates = A.flag_rate(V.flagged_comments(spark, sf), "misinfo_class", F.year("created_utc").alias("year"))
    return rates.withColumn("rate", F.round("rate", 6))


@query("a20_merge_aliases", """
    SELECT source, CAST(sum(frequency) AS BIGINT) AS frequency, CAST(sum(total_score) AS BIGINT) AS total_score
    FROM (SELECT CASE WHEN lower(source) IN ('ththed', 'ththre') THEN 'thther' ELSE lower(source) END AS source, frequency, total_score
          FROM totals_by_community) GROUP BY source""", "totals_by_community")
def a20(spark, sf):
    totals = A.source_totals(sourced(spark, sf), ["source", "subreddit"])
    return A.merge_aliases(totals, "source", {"ththed": "thther", "ththre": "thther"}, ["frequency", "total_score"])


@query("a21_term_weights", "SELECT source, sum(frequency)::BIGINT AS weight FROM totals_by_community GROUP BY source ORDER BY weight DESC, source LIMIT 20", "totals_by_community")
def a21(spark, sf):
    return A.term_weights(A.source_totals(sourced(spark, sf)), "source", "frequency", 20)


@query("a22_distinct", """SELECT topic, (SELECT count(DISTINCT source) FROM comments) AS sources FROM (SELECT DISTINCT topic FROM topic_posts)""", ("topic_posts", "comments"))
def a22(spark, sf):
    topics = A.distinct_values(V.posts_with_topic(spark, sf), "topic")
    return topics.withColumn("sources", A.distinct_count(V.comments(spark, sf), "source").scalar())


# Ranks and top-k -------------------------------------------------------------------------------

@query("w1_top_n_per_group", """
    SELECT source, subreddit, frequency, total_score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY frequency DESC, total_score DESC, source) AS rank
          FROM totals_by_community) WHERE rank <= 20""", "totals_by_community")
def w1(spark, sf):
    totals = A.source_totals(sourced(spark, sf), ["source", "subreddit"])
    return top_n_per_group(totals, "subreddit", ["frequency", "total_score"], 20, "source")


@query("w2_rank_max", """
    SELECT source, frequency, total_score,
           count(*) OVER (ORDER BY frequency DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "frequency rank",
           count(*) OVER (ORDER BY total_score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "score rank"
    FROM (SELECT source, count(*) AS frequency, CAST(sum(score) AS BIGINT) AS total_score FROM sourced GROUP BY source)""", "sourced")
def w2(spark, sf):
    totals = A.source_totals(sourced(spark, sf))
    return add_rank_max(add_rank_max(totals, "frequency", "frequency rank"), "total_score", "score rank")


@query("w3_skip_top", """
    SELECT author, submission_count FROM (
      SELECT *, row_number() OVER (ORDER BY submission_count DESC, author) AS n
      FROM (SELECT author, count(*) AS submission_count FROM posts GROUP BY author)) WHERE n > 1""", "posts")
def w3(spark, sf):
    return skip_top(A.active_authors(V.posts(spark, sf), 0), ["submission_count"], "author")


@query("t1_two_key_top", """SELECT source, count(source) AS frequency, CAST(sum(score) AS BIGINT) AS total_score FROM sourced
    GROUP BY source ORDER BY frequency DESC, total_score DESC, source LIMIT 100""", "sourced")
def t1(spark, sf):
    return top_k(A.source_totals(sourced(spark, sf)), ["frequency", "total_score"], 100, "source")


@query("t2_top_authors", "SELECT author, count(*) AS submission_count FROM posts WHERE subreddit = 'news' GROUP BY author ORDER BY 2 DESC, 1 LIMIT 11", "posts")
def t2(spark, sf):
    news = V.posts(spark, sf).filter(F.col("subreddit") == "news")
    return top_k(A.active_authors(news, 0), ["submission_count"], 11, "author")


@query("t3_ordered", "SELECT CAST(year(created_utc) AS INTEGER) AS year, count(*) AS count FROM comments GROUP BY 1 ORDER BY 1", "comments")
def t3(spark, sf):
    return A.count_by_calendar(V.comments(spark, sf), "created_utc", "year").orderBy("year")


# Set operations, reshaping, samples ------------------------------------------------------------

@query("u1_union_all", "SELECT id, 'post' AS kind, score FROM posts UNION ALL SELECT id, 'comment', score FROM comments", ("posts", "comments"))
def u1(spark, sf):
    left = V.posts(spark, sf).select("id", F.lit("post").alias("kind"), "score")
    right = V.comments(spark, sf).select("score", F.lit("comment").alias("kind"), "id")
    return U.union_rows(left, right)


@query("u2_distinct_rows", "SELECT DISTINCT id, title, topic FROM facts", "facts")
def u2(spark, sf):
    return V.facts(spark, sf).select("id", "title", "topic").distinct()


@query("u3_unpivot", """
    SELECT topic, 'raised' AS variable, count(*) FILTER (label = 0 AND prediction = 1) AS value FROM predictions GROUP BY topic
    UNION ALL SELECT topic, 'missed', count(*) FILTER (label = 1 AND prediction = 0) FROM predictions GROUP BY topic""", "predictions")
def u3(spark, sf):
    wide = A.prediction_analysis(V.predictions(spark, sf), "topic", "label", "prediction", 0, 1).select(
        "topic", F.col("incorrectly labeled as misinfo").alias("raised"), F.col("incorrectly labeled as no misinfo").alias("missed"))
    return U.unpivot_measures(wide, "topic", ["raised", "missed"])


@query("u4_undersample", f"SELECT id, label FROM predictions WHERE label <> 1 OR {_bucket('id', 'undersample')} < 0.25e0 * 4294967296", "predictions")
def u4(spark, sf):
    return U.undersample(V.predictions(spark, sf), "label", 1, 0.25, "id").select("id", "label")


@query("u5_hash_split", f"""
    SELECT id, CAST(CASE WHEN {_bucket('id', 'split')} < 0.8e0 * 4294967296 THEN 0 WHEN {_bucket('id', 'split')} < 0.98e0 * 4294967296 THEN 1 ELSE 2 END AS INTEGER) AS part
    FROM comments""", "comments")
def u5(spark, sf):
    parts = U.hash_split(V.comments(spark, sf).select("id"), "id", [0.8, 0.18, 0.02])
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return U.union_rows(U.union_rows(tagged[0], tagged[1]), tagged[2])
