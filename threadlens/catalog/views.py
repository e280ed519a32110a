"""Posts, comments, daily series and word tables as views over the given tables, in Spark and in SQL.

Both forms follow one definition, so that every operator runs on data of the shape it is written for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.constants import TOPIC_NAMES
from threadlens.functions.labels import map_labels
from threadlens.functions.text import flag_phrases
from threadlens.operators.joins import join_posts_comments
from threadlens.operators.sentiment import WORDS, ValenceRules, score_both
from threadlens.session import spread

# The invented prose holds no real phrases, so the checks use words that do occur in it.
PHRASES = ("idiot", "stupid", "worthless", "license")
RULES = ValenceRules(negators=("is", "les"), strengtheners=("and", "la"), weakeners=("by", "de"), contrast="this")
_PARTS = ("th", "er", "on", "an", "re", "in", "ti", "ou", "la", "de")
#: A thousand phrases of three syllables, and the hundred of two that they begin with.
MANY_PHRASES = tuple(a + b + c for a in _PARTS for b in _PARTS for c in ("", *_PARTS))
TERMS = ("us", "new", "man", "eu", "th", "age", "net", "war", "top", "report", "ou")
STOP_WORDS = ("the", "of", "and", "la", "de", "que")
START = "timestamp_ntz'2021-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hours_after_start(hours: str) -> Column:
    return F.expr(f"{START} + make_dt_interval(0, cast({hours} AS int))")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, sf, "pages").select(
        n.cast("string").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        "url",
        F.when(n % 3 == 0, "news").when(n % 3 == 1, "worldnews").otherwise("newsbotbot").alias("subreddit"),
        F.when(n % 17 == 0, "[deleted]").otherwise(F.concat(F.lit("u"), (n % 17).cast("string"))).alias("author"),
        ((n * 37) % 1000 - 20).alias("score"),
        (n % 50).alias("num_comments"),
        _hours_after_start("page_id * 61").alias("created_utc"),
    )


def comments(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        n.cast("string").alias("id"),
        F.col("text").alias("body"),
        F.concat(F.lit("t3_"), (n % 300).cast("string")).alias("link_id"),
        F.concat(F.lit("u"), (n % 23).cast("string")).alias("author"),
        (F.col("n_chars") % 500 - 5).alias("score"),
        "source",
        _hours_after_start("doc_id * 17").alias("created_utc"),
    )


def epidemiology(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("new_confirmed"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("new_deceased"),
    )


def vaccinations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").cast("decimal(18,2)").alias("new_persons_vaccinated"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity").cast("decimal(18,2)")).alias("new_persons_fully_vaccinated"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("new_vaccine_doses_administered"),
    )


def posts_with_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with a topic given by their id, for checks that need no fitted model."""
    return posts(spark, sf).withColumn("topic", map_labels(F.col("id").cast("long") % 8, TOPIC_NAMES))


def flagged_comments(spark: SparkSession, sf: str) -> DataFrame:
    return flag_phrases(comments(spark, sf), "body", PHRASES)


def spread_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments on all cores, for steps that work through every word of a text."""
    return spread(comments(spark, sf), "id")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per comment with its post's id, time, title and topic."""
    mini = posts_with_topic(spark, sf).select("id", "created_utc", "title", "topic")
    return join_posts_comments(mini, flagged_comments(spark, sf), "misinfo_class")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Every longer word of the benchmark texts with a valence from -2.0 to 2.0 made from the word."""
    words = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("word")).distinct()
    points = (F.ascii("word") * 7 + F.length("word") * 13) % 41 - 20
    return words.filter(F.length("word") >= 4).select("word", (points / F.lit(10.0)).cast("double").alias("valence"))


def idiom_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`lexicon` with entries of two and three words, taken from every fifth place of the benchmark texts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - 2)), lambda i: F.array_join(
        F.slice("ws", i, F.when(i % 5 == 0, 2).otherwise(3)), " "))
    chosen = F.filter(runs, lambda w, i: ((i + 1) % 5 == 0) | ((i + 1) % 5 == 2))
    idioms = table(spark, sf, "benchmark").select(words.alias("ws")).where("size(ws) > 2").select(F.explode(chosen).alias("word")).distinct()
    points = (F.ascii("word") * 7 + F.length("word") * 13) % 41 - 20
    return lexicon(spark, sf).unionByName(idioms.select("word", (points / F.lit(10.0)).cast("double").alias("valence")))


def lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words that end in -ing, -ed or -s with the word cut short as their lemma."""
    words = lexicon(spark, sf).select(F.col("word").alias("form"))
    return words.filter(F.col("form").rlike("(ing|ed|s)$")).select("form", F.regexp_replace("form", "(ing|ed|s)$", "").alias("lemma"))


def scored(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """``df`` with both sentiment scores of its ``body``."""
    return score_both(df, "body", lexicon(spark, sf), RULES)


def scored_facts(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`facts` with both scores, made on the scan before the join."""
    mini = posts_with_topic(spark, sf).select("id", "created_utc", "title", "topic")
    rows = scored(spark, sf, flag_phrases(spread_comments(spark, sf), "body", PHRASES))
    return join_posts_comments(mini, rows, "misinfo_class", "vader_score", "textblob_score")


def exact(col: str) -> Column:
    """A score as a decimal: sums of decimals do not depend on the order of the rows."""
    return F.col(col).cast("decimal(12,6)")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Any two 0/1 columns serve as label and prediction."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), map_labels(F.col("doc_id") % 8, TOPIC_NAMES).alias("topic"),
        F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


def _sql_words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TOPIC_CASE = "CASE {n} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TOPIC_NAMES.items()) + " END"
_WORD_RE = WORDS.replace("'", "''")


def _step(before: str, word: str, damping: float) -> str:
    add = (f"CASE WHEN {word} IN ({_sql_words(RULES.strengtheners)}) THEN 0.293e0 "
           f"WHEN {word} IN ({_sql_words(RULES.weakeners)}) THEN -0.293e0 ELSE 0e0 END * {damping}e0")
    times = f"CASE WHEN {word} IN ({_sql_words(RULES.negators)}) OR contains({word}, 'n''t') THEN -0.74e0 ELSE 1e0 END"
    return f"({before} + sign({before}) * ({add})) * ({times})"


# name -> (views it reads, definition)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "posts": ((), """
        SELECT CAST(page_id AS VARCHAR) AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url,
               CASE page_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'worldnews' ELSE 'newsbotbot' END AS subreddit,
               CASE WHEN page_id % 17 = 0 THEN '[deleted]' ELSE 'u' || CAST(page_id % 17 AS VARCHAR) END AS author,
               (page_id * 37) % 1000 - 20 AS score, page_id % 50 AS num_comments,
               TIMESTAMP '2021-01-01 00:00:00' + to_hours(CAST(page_id * 61 AS INTEGER)) AS created_utc
        FROM pages"""),
    "comments": ((), """
        SELECT CAST(doc_id AS VARCHAR) AS id, text AS body, 't3_' || CAST(doc_id % 300 AS VARCHAR) AS link_id,
               'u' || CAST(doc_id % 23 AS VARCHAR) AS author, n_chars % 500 - 5 AS score, source,
               TIMESTAMP '2021-01-01 00:00:00' + to_hours(CAST(doc_id * 17 AS INTEGER)) AS created_utc
        FROM documents"""),
    "epi": ((), """
        SELECT o_orderdate AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS new_confirmed,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS new_deceased
        FROM orders"""),
    "vac": ((), """
        SELECT l_shipdate AS date, CAST(l_quantity AS DECIMAL(18,2)) AS new_persons_vaccinated,
               CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_quantity AS DECIMAL(18,2)) END AS new_persons_fully_vaccinated,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS new_vaccine_doses_administered
        FROM lineitem"""),
    "topic_posts": (("posts",), f"SELECT *, {_TOPIC_CASE.format(n='(CAST(id AS BIGINT) % 8)')} AS topic FROM posts"),
    "flagged": (("comments",), f"""
        SELECT *, coalesce(regexp_matches(body, '{"|".join(PHRASES)}'), false) AS misinfo_class FROM comments"""),
    "facts": (("topic_posts", "flagged"), """
        SELECT p.id, p.created_utc, p.title, p.topic, c.created_utc AS comment_created, c.body, c.misinfo_class,
               c.id AS comment_id
        FROM topic_posts p JOIN flagged c ON p.id = regexp_extract(c.link_id, 't3_(.*)$', 1)"""),
    "lexicon": ((), f"""
        SELECT word, CAST((ascii(word) * 7 + length(word) * 13) % 41 - 20 AS DOUBLE) / 10e0 AS valence
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORD_RE}')) AS word FROM benchmark)
        WHERE length(word) >= 4"""),
    "idioms": (("lexicon",), f"""
        SELECT word, valence, 1 AS len FROM lexicon UNION ALL
        SELECT word, CAST((ascii(word) * 7 + length(word) * 13) % 41 - 20 AS DOUBLE) / 10e0 AS valence, len FROM
            (SELECT DISTINCT array_to_string(ws[i:i + len - 1], ' ') AS word, len FROM
                (SELECT ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM (SELECT regexp_extract_all(lower(text), '{_WORD_RE}') AS ws FROM benchmark) WHERE len(ws) > 2),
                (VALUES (2, 0), (3, 2)) kinds(len, rest) WHERE i % 5 = rest)"""),
    "idiom_hits": (("body_words", "idioms"), """
        SELECT r.id, r.pos, max(i.len) AS len, arg_max(i.valence, i.len) AS valence
        FROM (SELECT id, pos, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3]) AS run, unnest([1, 2, 3]) AS len FROM
                 (SELECT id, pos, lower(raw) AS w1, lead(lower(raw), 1) OVER o AS w2, lead(lower(raw), 2) OVER o AS w3
                  FROM body_words WINDOW o AS (PARTITION BY id ORDER BY pos))) r
        JOIN idioms i ON i.word = r.run AND i.len = r.len GROUP BY r.id, r.pos"""),
    "idiom_chain": (("idiom_hits",), """
        WITH RECURSIVE onward AS (SELECT a.id, a.pos, a.len, a.valence, b.pos AS next FROM idiom_hits a ASOF LEFT JOIN idiom_hits b ON a.id = b.id AND a.pos + a.len <= b.pos),
        chain AS (SELECT * FROM onward QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1
                  UNION ALL SELECT o.* FROM chain c JOIN onward o ON o.id = c.id AND o.pos = c.next)
        SELECT id, pos, len, valence FROM chain"""),
    "idiom_valence": (("word_context", "idiom_chain"), f"""
        SELECT id, pos, {_step('v2', 'b3', 0.9)} * CASE WHEN turn IS NULL OR pos = turn THEN 1e0
                 WHEN pos < turn THEN 0.5e0 ELSE 1.5e0 END AS v
        FROM (SELECT *, {_step('v1', 'b2', 0.95)} AS v2
              FROM (SELECT *, {_step('v0', 'b1', 1.0)} AS v1
                    FROM (SELECT c.*, valence + sign(valence) * CASE WHEN is_caps AND shouted > 0 AND shouted < n
                                 THEN 0.733e0 ELSE 0e0 END AS v0
                          FROM word_context c JOIN idiom_chain l ON c.id = l.id AND c.pos = l.pos
                          WHERE len > 1 OR c.w NOT IN ({_sql_words(RULES.strengtheners + RULES.weakeners)}))))"""),
    "lemmas": (("lexicon",), """
        SELECT word AS form, regexp_replace(word, '(ing|ed|s)$', '') AS lemma
        FROM lexicon WHERE regexp_matches(word, '(ing|ed|s)$')"""),
    "body_words": (("comments",), f"""
        SELECT id, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos, len(ws) AS n
        FROM (SELECT id, regexp_extract_all(body, '{_WORD_RE}') AS ws FROM comments)"""),
    "word_context": (("body_words",), f"""
        SELECT id, pos, lower(raw) AS w, (upper(raw) = raw AND lower(raw) <> raw) AS is_caps,
               coalesce(lag(lower(raw), 1) OVER o, '') AS b1, coalesce(lag(lower(raw), 2) OVER o, '') AS b2,
               coalesce(lag(lower(raw), 3) OVER o, '') AS b3, n,
               count(*) FILTER (upper(raw) = raw AND lower(raw) <> raw) OVER (PARTITION BY id) AS shouted,
               min(CASE WHEN lower(raw) = '{RULES.contrast}' THEN pos END) OVER (PARTITION BY id) AS turn
        FROM body_words WINDOW o AS (PARTITION BY id ORDER BY pos)"""),
    "word_valence": (("word_context", "lexicon"), f"""
        SELECT id, pos, {_step('v2', 'b3', 0.9)} * CASE WHEN turn IS NULL OR pos = turn THEN 1e0
                 WHEN pos < turn THEN 0.5e0 ELSE 1.5e0 END AS v
        FROM (SELECT *, {_step('v1', 'b2', 0.95)} AS v2
              FROM (SELECT *, {_step('v0', 'b1', 1.0)} AS v1
                    FROM (SELECT c.*, valence + sign(valence) * CASE WHEN is_caps AND shouted > 0 AND shouted < n
                                 THEN 0.733e0 ELSE 0e0 END AS v0
                          FROM word_context c JOIN lexicon l ON c.w = l.word
                          WHERE c.w NOT IN ({_sql_words(RULES.strengtheners + RULES.weakeners)}))))"""),
    "scores": (("word_valence", "body_words"), """
        SELECT id, CAST(greatest(-1e0, least(1e0, round(t / sqrt(t * t + 15e0), 4))) AS FLOAT) AS vader_score, textblob_score
        FROM (SELECT id, s + sign(s) * (least(bangs, 4) * 0.292e0 + CASE WHEN asks <= 1 THEN 0e0
                       WHEN asks <= 3 THEN asks * 0.18e0 ELSE 0.96e0 END) AS t, textblob_score
              FROM (SELECT c.id, coalesce(v.s, 0e0) AS s, length(body) - length(replace(body, '!', '')) AS bangs,
                           length(body) - length(replace(body, '?', '')) AS asks,
                           CAST(coalesce(p.m, 0e0) AS FLOAT) AS textblob_score
                    FROM comments c
                    LEFT JOIN (SELECT id, sum(v ORDER BY pos) AS s FROM word_valence GROUP BY id) v ON v.id = c.id
                    LEFT JOIN (SELECT id, sum(valence ORDER BY pos) / count(*) AS m
                               FROM body_words JOIN lexicon ON lower(raw) = word GROUP BY id) p ON p.id = c.id))"""),
    "scored_facts": (("facts", "scores"), """
        SELECT f.*, vader_score, textblob_score FROM facts f JOIN scores s ON f.comment_id = s.id"""),
    "predictions": ((), f"""
        SELECT doc_id AS id, {_TOPIC_CASE.format(n='(doc_id % 8)')} AS topic, quality AS label, toxic AS prediction
        FROM labels"""),
    "title_words": (("posts",), f"""
        SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^\\p{{L}}\\s]', '', 'g'), '\\s+'),
                               lambda x: x <> '' AND x NOT IN ({_sql_words(STOP_WORDS)})) AS tokens
        FROM posts"""),
    "title_parts": (("posts",), """
        SELECT id, unnest(regexp_extract_all(lower(title), '[a-zà-ÿ]{2}')) AS term FROM posts"""),
    "sourced": (("posts",), """
        SELECT * FROM (
          SELECT p.*, CASE WHEN first IN ('www', 'amp') THEN lower(string_split(authority, '.')[2]) ELSE lower(first) END AS source
          FROM (SELECT posts.*, authority, split_part(authority, '.', 1) AS first
                FROM posts, LATERAL (SELECT regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS authority)) p)
        WHERE url <> '' AND source <> '' AND source <> 'reddit'"""),
    "totals_by_community": (("sourced",), """
        SELECT source, subreddit, count(source) AS frequency, CAST(sum(score) AS BIGINT) AS total_score
        FROM sourced GROUP BY source, subreddit"""),
}
