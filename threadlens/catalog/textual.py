"""Scalar functions and text features (F, M)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    IDF, PCA, CountVectorizer, HashingTF, OneHotEncoder, StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threadlens import constants as K
from threadlens.catalog import views as V
from threadlens.catalog.registry import query
from threadlens.functions import calendar as C
from threadlens.functions import labels as L
from threadlens.functions import text as X
from threadlens.operators import aggregates as A
from threadlens.operators.classify import index_to_label, label_index
from threadlens.operators.topics import idf_table, title_tokens, vocabulary


@query("f1_clean_text", "SELECT id, trim(regexp_replace(lower(body), '[^a-zA-Z0-9\\s]', '', 'g'), ' ') AS body FROM comments", "comments")
def f1(spark, sf):
    return X.clean_text(V.comments(spark, sf)).select("id", "body")


# Every page URL in eight disguises, so that each rule for news sources meets real rows.
_DISGUISE = """CASE page_id % 8
    WHEN 1 THEN 'https://www.google.com/amp/s/amp.' || regexp_extract(url, '//(.*)$', 1)
    WHEN 2 THEN 'https://www.google.com/url?q=1&url=' || url
    WHEN 3 THEN 'https://twitter.com/User' || CAST(page_id AS {string}) || '/status/1'
    WHEN 4 THEN 'https://mobile.twitter.com'
    WHEN 5 THEN 'https://www.google.com/search?q=' || CAST(page_id AS {string})
    WHEN 6 THEN regexp_extract(url, '//(.*)$', 1)
    WHEN 7 THEN 'http://user:pass@WWW' || CAST(page_id AS {string}) || '.Example.com:8080/x'
    ELSE url END"""


@query("f2_news_source", f"""
    SELECT page_id, CASE
             WHEN label IS NULL THEN NULL
             WHEN contains(domain, 'twitter.com') THEN
               CASE WHEN regexp_matches(url, '^[a-z]+://[^/]*/') THEN regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) ELSE label END
             ELSE lower(label) END AS source
    FROM (SELECT *, CASE WHEN split_part(domain, '.', 1) IN ('www', 'amp') THEN string_split(domain, '.')[2]
                         ELSE split_part(domain, '.', 1) END AS label
          FROM (SELECT page_id, url, CASE WHEN NOT contains(authority, 'www.google.com') THEN authority
                   WHEN contains(url, 'amp/s/') THEN regexp_extract(string_split(url, 'amp/s/')[2], '^([^/?#]*)', 1)
                   WHEN contains(url, 'url=') THEN regexp_extract(regexp_replace(string_split(url, 'url=')[2], '^[a-z]+://', ''), '^([^/?#]*)', 1)
                   END AS domain
                FROM (SELECT page_id, url, regexp_extract(url, '^(?:[a-z]+:)?//([^/?#]*)', 1) AS authority
                      FROM (SELECT page_id, {_DISGUISE.format(string='VARCHAR')} AS url FROM pages))))""")
def f2(spark, sf):
    disguised = V.table(spark, sf, "pages").select("page_id", F.expr(_DISGUISE.format(string="STRING")).alias("url"))
    return disguised.select("page_id", X.news_source("url").alias("source"))


@query("f3_post_id", "SELECT id, regexp_extract(CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN replace(link_id, 't3', 't1') ELSE link_id END, 't3_(.*)$', 1) AS post_id FROM comments", "comments")
def f3(spark, sf):
    link = F.when(F.col("id").cast("long") % 4 == 0, F.replace("link_id", F.lit("t3"), F.lit("t1"))).otherwise(F.col("link_id"))
    return V.comments(spark, sf).select("id", X.post_id(link).alias("post_id"))


@query("f4_time_columns", """SELECT id, CAST(year(created_utc) AS INTEGER) AS year, CAST(month(created_utc) AS INTEGER) AS month,
    CAST(week(created_utc) AS INTEGER) AS week, CAST(isoyear(created_utc) AS INTEGER) AS iso_year,
    CAST(dayofweek(created_utc) + 1 AS INTEGER) AS day FROM comments""", "comments")
def f4(spark, sf):
    rows = V.comments(spark, sf).select("id", "created_utc")
    iso = C.add_time_columns(rows, "created_utc", iso=True).withColumnRenamed("year", "iso_year").drop("month", "week")
    return C.add_time_columns(iso, "created_utc").withColumn("day", F.dayofweek("created_utc")).drop("created_utc")


@query("f5_period_labels", """SELECT id, strftime(created_utc, '%Y/%m') AS year_month,
    CAST(year(created_utc) AS VARCHAR) || '/' || lpad(CAST(week(created_utc) AS VARCHAR), 2, '0') AS year_week FROM comments""", "comments")
def f5(spark, sf):
    return C.add_period_labels(C.add_time_columns(V.comments(spark, sf), "created_utc")).select("id", "year_month", "year_week")


@query("f6_day_name", "SELECT id, dayname(created_utc) AS day FROM comments", "comments")
def f6(spark, sf):
    return V.comments(spark, sf).select("id", C.day_name(F.dayofweek("created_utc")).alias("day"))


@query("f7_map_labels", "SELECT doc_id, " + V._TOPIC_CASE.format(n="(doc_id % 10)") + " AS topic FROM documents")
def f7(spark, sf):
    number = (F.col("doc_id") % 10).cast("float")
    return V.table(spark, sf, "documents").select("doc_id", L.map_labels(number, K.TOPIC_NAMES).alias("topic"))


@query("f8_indices_to_terms", f"""SELECT doc_id, list_transform([doc_id % 4, (doc_id + 1) % 4],
    lambda i: [{V._sql_words(V.PHRASES)}][i + 1]) AS terms FROM documents""")
def f8(spark, sf):
    n = F.col("doc_id")
    places = F.array((n % 4).cast("int"), ((n + 1) % 4).cast("int"))
    return V.table(spark, sf, "documents").select("doc_id", L.indices_to_terms(places, list(V.PHRASES)).alias("terms"))


@query("f9_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS place FROM embeddings")
def f9(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", L.argmax("embedding").alias("place"))


@query("f10_zero_to_null", "SELECT page_id, nullif(page_id % 3, 0) AS a, nullif(page_id % 50, 0) AS b FROM pages")
def f10(spark, sf):
    n = F.col("page_id")
    rows = V.table(spark, sf, "pages").select("page_id", (n % 3).alias("a"), (n % 50).alias("b"))
    return L.zero_to_null(rows, ["a", "b"])


@query("f11_strip_prefix", """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
    CAST(sum(new_deceased) AS BIGINT) AS deceased FROM epi GROUP BY 1, 2""", "epi")
def f11(spark, sf):
    sums = A.rollup_sums(C.add_time_columns(V.epidemiology(spark, sf)), ["new_deceased"], "month")
    return L.strip_prefix(sums, "sum_new_")


@query("f12_period_to_date", "SELECT id, CAST(date_trunc('month', created_utc) AS DATE) AS month_start FROM comments", "comments")
def f12(spark, sf):
    label = C.period_label(F.year("created_utc"), F.month("created_utc"))
    return V.comments(spark, sf).select("id", C.period_to_date(label).alias("month_start"))


@query("f13_thousands", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS shown, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders")
def f13(spark, sf):
    shown = V.table(spark, sf, "orders").select("o_orderkey", L.with_thousands(F.floor("o_totalprice").cast("long")).alias("shown"))
    return shown.withColumn("value", L.parse_thousands("shown"))


@query("f14_ratio", "SELECT page_id, round(CAST(page_id AS DOUBLE) / nullif(page_id % 5, 0) * 100, 6) AS percent FROM pages")
def f14(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.round(L.ratio("page_id", F.col("page_id") % 5, 100), 6).alias("percent"))


# Text features ---------------------------------------------------------------------------------

def tokens(spark, sf):
    return title_tokens(V.posts(spark, sf).select("id", "title"), "title", list(V.STOP_WORDS))


@query("m1_tokenize", "SELECT id, regexp_split_to_array(regexp_replace(lower(body), '\\s+$', ''), '\\s') AS words FROM comments", "comments")
def m1(spark, sf):
    return X.tokenize(V.comments(spark, sf), "body").select("id", "words")


@query("m2_normalize_tokens", r"""SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(body), '[^\p{L}\s]', '', 'g'), '\s+'),
    lambda x: x <> '') AS tokens FROM comments""", "comments")
def m2(spark, sf):
    return X.normalize_tokens(V.comments(spark, sf), "body").select("id", "tokens")


@query("m3_stop_words", "SELECT id, tokens FROM title_words", "title_words")
def m3(spark, sf):
    return tokens(spark, sf).select("id", "tokens")


_VOCABULARY = """
    SELECT term, CAST(sum(n) AS BIGINT) AS term_count, count(*) AS doc_count
    FROM (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(tokens) AS term FROM title_words) GROUP BY 1, 2)
    GROUP BY term HAVING count(*) >= 2 ORDER BY term_count DESC, term LIMIT 5000"""


@query("m4_vocabulary", _VOCABULARY, "title_words")
def m4(spark, sf):
    return vocabulary(tokens(spark, sf), "tokens", 5000, 2)


@query("m4_count_vectors", """
    SELECT id, CAST(coalesce(words, 0) AS BIGINT) AS words, coalesce(terms, 0) AS terms FROM title_words LEFT JOIN (
    SELECT id, CAST(sum(n) AS BIGINT) AS words, count(*) AS terms
    FROM (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(tokens) AS term FROM title_words) GROUP BY 1, 2)
    WHERE term IN (SELECT term FROM (SELECT id, unnest(tokens) AS term FROM title_words) GROUP BY term HAVING count(DISTINCT id) >= 2)
    GROUP BY id) USING (id)""", "title_words")
def m4_vectors(spark, sf):
    rows = tokens(spark, sf)
    counted = CountVectorizer(inputCol="tokens", outputCol="v", vocabSize=5000, minDF=2).fit(rows).transform(rows)
    total = F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x).cast("bigint")
    present = F.size(F.filter(vector_to_array("v"), lambda x: x > 0)).cast("bigint")
    return counted.select("id", total.alias("words"), present.alias("terms"))


@query("m5_idf_table", """
    SELECT term, count(DISTINCT id) AS doc_count,
           round(ln((CAST((SELECT count(*) FROM title_words) AS DOUBLE) + 1) / (count(DISTINCT id) + 1)), 6) AS idf
    FROM (SELECT id, unnest(tokens) AS term FROM title_words) GROUP BY term""", "title_words")
def m5(spark, sf):
    return idf_table(tokens(spark, sf), "tokens").withColumn("idf", F.round("idf", 6))


@query("m6_hashing_tf", "SELECT id, CAST(len(regexp_split_to_array(regexp_replace(lower(title), '\\s+$', ''), '\\s')) AS BIGINT) AS words FROM posts", "posts")
def m6(spark, sf):
    rows = X.tokenize(V.posts(spark, sf).select("id", "title"), "title")
    hashed = HashingTF(inputCol="words", outputCol="v", numFeatures=1000).transform(rows)
    return hashed.select("id", F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("words"))


@query("m7_label_index", """
    SELECT id, topic, CAST(ix AS DOUBLE) AS topic_index
    FROM topic_posts JOIN (SELECT topic, row_number() OVER (ORDER BY count(*) DESC, topic) - 1 AS ix FROM topic_posts GROUP BY topic) USING (topic)""", "topic_posts")
def m7(spark, sf):
    return label_index(V.posts_with_topic(spark, sf), "topic").select("id", "topic", "topic_index")


@query("m8_one_hot", """
    SELECT id, list_transform(range(7), lambda i: CASE WHEN i = ix THEN 1e0 ELSE 0e0 END) AS topic_vec
    FROM topic_posts JOIN (SELECT topic, row_number() OVER (ORDER BY count(*) DESC, topic) - 1 AS ix FROM topic_posts GROUP BY topic) USING (topic)""", "topic_posts")
def m8(spark, sf):
    rows = V.posts_with_topic(spark, sf).select("id", "topic")
    model = Pipeline(stages=[StringIndexer(inputCol="topic", outputCol="ix"), OneHotEncoder(inputCols=["ix"], outputCols=["v"])]).fit(rows)
    return model.transform(rows).select("id", vector_to_array("v").alias("topic_vec"))


@query("m9_assemble", "SELECT id, [CAST(score AS DOUBLE), CAST(contains(title, 'us') AS DOUBLE), CAST(contains(title, 'new') AS DOUBLE)] AS features FROM posts", "posts")
def m9(spark, sf):
    rows = X.term_dummies(V.posts(spark, sf), "title", ["us", "new"])
    return VectorAssembler(inputCols=["score", "us", "new"], outputCol="v").transform(rows).select("id", vector_to_array("v").alias("features"))


@query("m10_index_to_label", "SELECT id, CASE prediction WHEN 0 THEN 'no perceived misinfo' ELSE 'perceived misinfo' END AS name FROM predictions", "predictions")
def m10(spark, sf):
    rows = V.predictions(spark, sf).withColumn("prediction", F.col("prediction").cast("double"))
    return index_to_label(rows, "prediction", "name").select("id", "name")


@query("m11_pca")
def m11(spark, sf):
    rows = tokens(spark, sf)
    model = Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="raw", numFeatures=200), IDF(inputCol="raw", outputCol="features"),
        PCA(k=2, inputCol="features", outputCol="p")]).fit(rows)
    place = vector_to_array("p")
    return model.transform(rows).select("id", F.get(place, F.lit(0)).alias("x"), F.get(place, F.lit(1)).alias("y"))


@query("m12_unit_vector", """
    SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / n, 6)) AS unit
    FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""")
def m12(spark, sf):
    rows = V.table(spark, sf, "embeddings").select("vec_id", L.unit_vector("embedding").alias("unit"))
    return rows.withColumn("unit", F.transform("unit", lambda x: F.round(x, 6)))


_LEMMA_SQL = r"""WITH words AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(body), '[^\p{L}\s]', '', 'g'), '\s+'),
    lambda x: x <> '') AS tokens FROM comments)
    SELECT id, CASE WHEN tokens IS NULL THEN NULL ELSE coalesce(lemmas, []) END AS lemmas FROM words LEFT JOIN (
    SELECT id, list(coalesce(lemma, w) ORDER BY pos) AS lemmas
    FROM (SELECT id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS pos FROM words)
    LEFT JOIN lemmas ON w = form GROUP BY id) USING (id)"""


@query("m13_lemmatize", f"SELECT * FROM ({_LEMMA_SQL})", ("comments", "lemmas"))
def m13(spark, sf):
    rows = X.normalize_tokens(V.spread_comments(spark, sf), "body")
    return X.lemmatize(rows, "tokens", V.lemmas(spark, sf)).select("id", "lemmas")


@query("m13_lemmatize_joined", f"SELECT * FROM ({_LEMMA_SQL})", ("comments", "lemmas"))
def m13_joined(spark, sf):
    rows = X.normalize_tokens(V.comments(spark, sf), "body")
    return X.lemmatize(rows, "tokens", V.lemmas(spark, sf), inline_limit=0).select("id", "lemmas")
