"""The analyses of the plans package as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens import constants as K
from threadlens.catalog import views as V
from threadlens.catalog.models import _SUMMARY_SQL, numeric_summary, topic_model
from threadlens.catalog.registry import normal_equations, query
from threadlens.catalog.relational import _LABELS, _MISINFO_SUM, _SHARE, BIN_SQL, _bucket, as_doubles
from threadlens.operators import aggregates as A
from threadlens.operators.topics import assign_topic
from threadlens.plans import articles as R
from threadlens.plans import eda as E
from threadlens.plans import nlp as N
from threadlens.plans import series as S

_TOP = """SELECT source, count(source) AS frequency, CAST(sum(score) AS BIGINT) AS total_score FROM sourced
    GROUP BY source ORDER BY frequency DESC, total_score DESC, source LIMIT 100"""


@query("top_sources", _TOP, "sourced")
def top_sources(spark, sf):
    return E.top_sources(V.posts(spark, sf))


@query("top_sources_per_community", """
    SELECT source, subreddit, frequency, total_score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY frequency DESC, total_score DESC, source) AS rank
          FROM totals_by_community) WHERE rank <= 100""", "totals_by_community")
def top_sources_per_community(spark, sf):
    return E.top_sources_per_community(V.posts(spark, sf))


@query("source_rankings", f"""
    SELECT source, format('{{:,}}', f) AS frequency, format('{{:,}}', s) AS karma_score, CAST(r AS INTEGER) AS "score rank"
    FROM (SELECT *, count(*) OVER (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
          FROM (SELECT CASE lower(source) WHEN 'ththed' THEN 'thther' ELSE lower(source) END AS source,
                       CAST(sum(frequency) AS BIGINT) AS f, CAST(sum(total_score) AS BIGINT) AS s FROM ({_TOP}) GROUP BY 1))
    ORDER BY f DESC, source LIMIT 10""", "sourced")
def source_rankings(spark, sf):
    return E.source_rankings(V.posts(spark, sf), aliases={"ththed": "thther"})


@query("source_rankings_by_score", f"""
    SELECT source, format('{{:,}}', f) AS frequency, format('{{:,}}', s) AS karma_score, CAST(r AS INTEGER) AS "frequency rank"
    FROM (SELECT *, count(*) OVER (ORDER BY f DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
          FROM (SELECT lower(source) AS source, CAST(sum(frequency) AS BIGINT) AS f, CAST(sum(total_score) AS BIGINT) AS s FROM ({_TOP}) GROUP BY 1))
    ORDER BY s DESC, source LIMIT 10""", "sourced")
def source_rankings_by_score(spark, sf):
    return E.source_rankings(V.posts(spark, sf), by="total_score")


@query("top_authors", """
    SELECT author, submission_count FROM (
      SELECT *, row_number() OVER (ORDER BY submission_count DESC, author) AS n
      FROM (SELECT author, count(*) AS submission_count FROM posts WHERE subreddit = 'worldnews' GROUP BY author HAVING count(*) > 2))
    WHERE n BETWEEN 2 AND 11""", "posts")
def top_authors(spark, sf):
    return E.top_authors(V.posts(spark, sf), "worldnews", min_count=2, n=10, skip=1)


@query("activity_by_year", "SELECT CAST(year(created_utc) AS INTEGER) AS year, count(*) AS count FROM comments GROUP BY 1", "comments")
def activity_by_year(spark, sf):
    return E.activity_by_year(V.comments(spark, sf))


@query("activity_by_weekday", """
    SELECT dayname(DATE '2023-01-01' + CAST(day AS INTEGER)) AS day, comments_count, submissions_count
    FROM (SELECT dayofweek(created_utc) AS day, count(*) AS comments_count FROM comments GROUP BY 1)
    JOIN (SELECT dayofweek(created_utc) AS day, count(*) AS submissions_count FROM posts GROUP BY 1) USING (day)""", ("comments", "posts"))
def activity_by_weekday(spark, sf):
    return E.activity_by_weekday(V.comments(spark, sf), V.posts(spark, sf))


@query("phrase_counts", """SELECT misinfo_class, count(*) AS count, round(count(*) / (SELECT count(*) FROM flagged) * 100, 6) AS share
    FROM flagged GROUP BY 1""", "flagged")
def phrase_counts(spark, sf):
    return E.phrase_counts(V.comments(spark, sf), V.PHRASES).withColumn("share", F.round("share", 6))


@query("phrase_hits", " UNION ALL ".join(
    f"SELECT '{p}' AS phrase, count(*) FILTER (contains(body, '{p}')) AS count FROM comments" for p in V.PHRASES), "comments")
def phrase_hits(spark, sf):
    return E.phrase_hits(V.comments(spark, sf), V.PHRASES)


@query("misinfo_rate_by_year", """
    SELECT CAST(year(created_utc) AS INTEGER) AS year, count(*) AS total, count(*) FILTER (misinfo_class) AS flagged,
           round(count(*) FILTER (misinfo_class) / count(*), 6) AS rate FROM flagged GROUP BY 1""", "flagged")
def misinfo_rate_by_year(spark, sf):
    return E.misinfo_rate_by_year(V.comments(spark, sf), V.PHRASES).withColumn("rate", F.round("rate", 6))


@query("score_summary", _SUMMARY_SQL, "comments")
def score_summary(spark, sf):
    return numeric_summary(spark, sf)


@query("topic_counts", "SELECT topic, count(*) AS count FROM facts GROUP BY topic", "facts")
def topic_counts(spark, sf):
    return N.topic_counts(V.posts_with_topic(spark, sf), V.flagged_comments(spark, sf))


@query("topic_misinfo_counts", "SELECT topic, count(*) AS count FROM facts WHERE misinfo_class GROUP BY topic", "facts")
def topic_misinfo_counts(spark, sf):
    return N.topic_misinfo_counts(V.posts_with_topic(spark, sf), V.flagged_comments(spark, sf))


@query("topic_misinfo_total", "SELECT topic, misinfo_class, count(*) AS count FROM facts GROUP BY 1, 2", "facts")
def topic_misinfo_total(spark, sf):
    return N.topic_misinfo_total(V.posts_with_topic(spark, sf), V.flagged_comments(spark, sf))


@query("lda_topic_counts")
def lda_topic_counts(spark, sf):
    topics = assign_topic(topic_model(spark, sf), V.posts(spark, sf))
    return N.topic_counts(topics, V.flagged_comments(spark, sf))


def enriched(spark, sf):
    return N.enriched_comments(V.posts_with_topic(spark, sf), V.spread_comments(spark, sf), V.lexicon(spark, sf), V.PHRASES, rules=V.RULES)


@query("negative_share_by_topic", _SHARE.format(t="-0.5", n="count_below", p="percentage_below"), "scored_facts")
def negative_share_by_topic(spark, sf):
    return N.negative_share_by_topic(enriched(spark, sf), -0.5).withColumn("percentage_below", F.round("percentage_below", 6))


@query("sentiment_histogram", BIN_SQL.format(view="(SELECT * FROM scored_facts WHERE misinfo_class)"), "scored_facts")
def sentiment_histogram(spark, sf):
    return N.sentiment_histogram(enriched(spark, sf))


def _period_sql(view: str, where: str = "") -> str:
    return (f"SELECT CAST(year(created_utc) AS VARCHAR) || '/' || lpad(CAST(week(created_utc) AS VARCHAR), 2, '0') AS year_week, "
            f"count(*) AS count FROM {view} {where} GROUP BY 1")


@query("period_counts_week", _period_sql("facts"), "facts")
def period_counts_week(spark, sf):
    return S.commented_period_counts(V.posts(spark, sf), V.flagged_comments(spark, sf), "week")


@query("period_counts_month", "SELECT strftime(created_utc, '%Y/%m') AS year_month, count(*) AS count FROM facts GROUP BY 1", "facts")
def period_counts_month(spark, sf):
    return S.commented_period_counts(V.posts(spark, sf), V.flagged_comments(spark, sf), "month")


@query("period_misinfo_counts_week", _period_sql("facts", "WHERE misinfo_class"), "facts")
def period_misinfo_counts_week(spark, sf):
    return S.commented_period_counts(V.posts(spark, sf), V.flagged_comments(spark, sf), "week", flagged_only=True)


@query("period_misinfo_counts_month", "SELECT strftime(created_utc, '%Y/%m') AS year_month, count(*) AS count FROM facts WHERE misinfo_class GROUP BY 1", "facts")
def period_misinfo_counts_month(spark, sf):
    return S.commented_period_counts(V.posts(spark, sf), V.flagged_comments(spark, sf), "month", flagged_only=True)


@query("period_post_counts_week", _period_sql("posts"), "posts")
def period_post_counts_week(spark, sf):
    return S.period_post_counts(V.posts(spark, sf), "week")


@query("period_post_counts_month", "SELECT strftime(created_utc, '%Y/%m') AS year_month, count(*) AS count FROM posts GROUP BY 1", "posts")
def period_post_counts_month(spark, sf):
    return S.period_post_counts(V.posts(spark, sf), "month")


def _summary_sql(grain: str, flagged: bool) -> str:
    return f"""
    SELECT CAST(year(created_utc) AS INTEGER) AS year, CAST({grain}(created_utc) AS INTEGER) AS {grain},
           CAST(sum(CAST(vader_score AS DECIMAL(12,6))) AS DOUBLE) AS sum_vader_score,
           CAST(sum(CAST(textblob_score AS DECIMAL(12,6))) AS DOUBLE) AS sum_textblob_score,
           count(DISTINCT id) AS posts_count, count(DISTINCT comment_id) AS comments_count{'' if flagged else _MISINFO_SUM}
    FROM scored_facts {'WHERE misinfo_class' if flagged else ''} GROUP BY 1, 2"""


def _summary(spark, sf, grain: str, flagged: bool):
    rows = enriched(spark, sf)
    rows = rows.withColumns({c: V.exact(c) for c in ("vader_score", "textblob_score")})
    return as_doubles(S.period_summary(rows, grain, flagged))


@query("period_summary_week", _summary_sql("week", False), "scored_facts")
def period_summary_week(spark, sf):
    return _summary(spark, sf, "week", False)


@query("period_summary_month", _summary_sql("month", False), "scored_facts")
def period_summary_month(spark, sf):
    return _summary(spark, sf, "month", False)


@query("period_summary_week_flagged", _summary_sql("week", True), "scored_facts")
def period_summary_week_flagged(spark, sf):
    return _summary(spark, sf, "week", True)


@query("period_summary_month_flagged", _summary_sql("month", True), "scored_facts")
def period_summary_month_flagged(spark, sf):
    return _summary(spark, sf, "month", True)


def _rollup_sql(view: str, cols: tuple[str, ...], grain: str) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS sum_{c}" for c in cols)
    return (f"SELECT CAST(year(date) AS INTEGER) AS year, CAST({grain}(date) AS INTEGER) AS {grain}, {sums} "
            f"FROM {view} GROUP BY 1, 2")


def _doubled(df):
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c.startswith("sum_")})


for _grain in ("week", "month"):
    _epi = _rollup_sql("epi", S.EPIDEMIOLOGY_MEASURES, _grain)
    _vac = _rollup_sql("vac", S.VACCINATION_MEASURES, _grain)

    @query(f"epidemiology_rollup_{_grain}", _epi, "epi")
    def epidemiology_rollup(spark, sf, grain=_grain):
        return _doubled(S.epidemiology_rollup(V.epidemiology(spark, sf), grain))

    @query(f"vaccination_rollup_{_grain}", _vac, "vac")
    def vaccination_rollup(spark, sf, grain=_grain):
        return _doubled(S.vaccination_rollup(V.vaccinations(spark, sf), grain))

    @query(f"covid_joined_{_grain}", f"SELECT * FROM ({_epi}) FULL JOIN ({_vac}) USING (year, {_grain})", ("epi", "vac"))
    def covid_joined(spark, sf, grain=_grain):
        return _doubled(S.covid_joined(V.epidemiology(spark, sf), V.vaccinations(spark, sf), grain))


_MONTHLY = (f"(SELECT * FROM ({_rollup_sql('epi', S.EPIDEMIOLOGY_MEASURES, 'month')}) FULL JOIN "
            f"({_rollup_sql('vac', S.VACCINATION_MEASURES, 'month')}) USING (year, month))")


@query("covid_series", "SELECT make_date(year, month, 1) AS date, " + ", ".join(
    f"nullif(sum_{c}, 0) AS {c.removeprefix('new_')}" for c in S.EPIDEMIOLOGY_MEASURES + S.VACCINATION_MEASURES) + f" FROM {_MONTHLY}", ("epi", "vac"))
def covid_series(spark, sf):
    plotted = S.covid_series(V.epidemiology(spark, sf), V.vaccinations(spark, sf))
    return plotted.select("date", *[F.col(c).cast("double").alias(c) for c in plotted.columns if c != "date"])


def joined_months(spark, sf):
    """The monthly series, the external days moved 25 years into the comments' time."""
    def later(df):
        return df.withColumn("date", F.expr("date + make_dt_interval(9131)"))

    return S.joined_series(V.flagged_comments(spark, sf), later(V.epidemiology(spark, sf)), later(V.vaccinations(spark, sf)), "month")


def _later_sql(view: str, cols: tuple[str, ...]) -> str:
    return _rollup_sql(f"(SELECT * REPLACE (date + to_days(9131) AS date) FROM {view})", cols, "month")


_SERIES = f"""(SELECT * FROM
    (SELECT CAST(year(created_utc) AS INTEGER) AS year, CAST(month(created_utc) AS INTEGER) AS month, count(*) AS comments_count,
            count(*) FILTER (misinfo_class) AS misinfo_count FROM flagged GROUP BY 1, 2)
    JOIN (SELECT * FROM ({_later_sql('epi', S.EPIDEMIOLOGY_MEASURES)}) FULL JOIN ({_later_sql('vac', S.VACCINATION_MEASURES)}) USING (year, month))
    USING (year, month))"""


@query("series_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM {_SERIES}"
    for a in S.series_measures() for b in S.series_measures()), ("flagged", "epi", "vac"))
def series_correlation(spark, sf):
    return S.series_correlation(joined_months(spark, sf)).withColumn("corr", F.round("corr", 6))


@query("series_regression", "SELECT round(mse, 4) AS mse, round(r2, 6) AS r2 FROM " + normal_equations(
    _SERIES, "misinfo_count", [m for m in S.series_measures() if m.startswith("sum_")]), ("flagged", "epi", "vac"))
def series_regression(spark, sf):
    return S.misinfo_regression(joined_months(spark, sf)).select(F.round("mse", 4).alias("mse"), F.round("r2", 6).alias("r2"))


def articles(spark, sf):
    return R.article_labels(V.posts_with_topic(spark, sf), V.flagged_comments(spark, sf))


@query("article_labels", _LABELS, "facts")
def article_labels(spark, sf):
    return articles(spark, sf)


@query("label_counts", f"SELECT label, count(*) AS count FROM ({_LABELS}) GROUP BY label", "facts")
def label_counts(spark, sf):
    return R.label_counts(articles(spark, sf))


@query("balanced_sample", f"SELECT label, count(*) AS count FROM ({_LABELS}) WHERE label <> 'no perceived misinfo' OR {_bucket('id', 'undersample')} < 0.25e0 * 4294967296 GROUP BY label", "facts")
def balanced_sample(spark, sf):
    return R.label_counts(R.balanced_sample(articles(spark, sf)))


@query("classifier_report")
def classifier_report(spark, sf):
    training, _, _ = R.classified_articles(R.balanced_sample(articles(spark, sf)))
    return R.classifier_report(training)


@query("classifier_metrics")
def classifier_metrics(spark, sf):
    training, test, _ = R.classified_articles(R.balanced_sample(articles(spark, sf)))
    return R.classifier_metrics({"training": training, "test": test})


@query("classifier_confusion")
def classifier_confusion(spark, sf):
    _, test, _ = R.classified_articles(R.balanced_sample(articles(spark, sf)))
    return A.confusion_matrix(test, "label", "predictedMisinfo", list(K.ARTICLE_LABELS))


@query("wrong_predictions")
def wrong_predictions(spark, sf):
    training, _, _ = R.classified_articles(R.balanced_sample(articles(spark, sf)))
    return R.wrong_predictions(R.classifier_report(training))


@query("title_clusters")
def title_clusters(spark, sf):
    return R.title_clusters(articles(spark, sf))
