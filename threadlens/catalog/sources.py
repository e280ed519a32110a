"""Scans, sinks and views (S1-S10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens import schemas
from threadlens.catalog import views as V
from threadlens.catalog.registry import query
from threadlens.jobs.filter_table import filter_table
from threadlens.operators.aggregates import community_counts, count_by, source_totals
from threadlens.operators.filters import drop_missing_source, filter_values
from threadlens.functions.text import news_source
from threadlens.session import scratch_path
from threadlens.sources.checked import read_checked_csv, reason_counts, required
from threadlens.sources.readers import read_csv_table, read_table, register_views
from threadlens.sources.sinks import write_by_year, write_csv, write_table


@query("s1_partitioned_scan", "SELECT CAST(year(created_utc) AS INTEGER) AS year, count(*) AS count FROM comments "
       "WHERE year(created_utc) >= 2022 GROUP BY 1", "comments")
def s1(spark, sf):
    path = scratch_path(spark, "comments")
    write_by_year(V.comments(spark, sf), "created_utc", path)
    return count_by(read_table(spark, path).filter(F.col("year") >= 2022), "year")


@query("s2_glob_scan", """
    SELECT CAST(year(created_utc) AS INTEGER) AS year, CAST(month(created_utc) AS INTEGER) AS month,
           CAST(sum(score) AS BIGINT) AS total_score
    FROM comments WHERE year(created_utc) = 2021 GROUP BY 1, 2""", "comments")
def s2(spark, sf):
    path = scratch_path(spark, "comments")
    parts = V.comments(spark, sf).withColumns({"year": F.year("created_utc"), "month": F.month("created_utc")})
    parts.write.partitionBy("year", "month").parquet(path)
    found = read_table(spark, f"{path}/year=2021/month=*", base_path=path, file_glob="*.parquet")
    return found.groupBy("year", "month").agg(F.sum("score").alias("total_score"))


@query("s3_csv_scan", """
    SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(new_deceased) AS BIGINT) AS sum_new_deceased,
           CAST(sum(CAST(floor(new_confirmed) AS BIGINT)) AS BIGINT) AS sum_new_confirmed FROM epi GROUP BY 1""", "epi")
def s3(spark, sf):
    path = scratch_path(spark, "epidemiology")
    daily = V.epidemiology(spark, sf).select(
        F.to_date("date").alias("date"), F.floor("new_confirmed").cast("long").alias("new_confirmed"), "new_deceased")
    write_csv(daily, path)
    rows = schemas.validate(read_csv_table(spark, path, schemas.EPIDEMIOLOGY), schemas.EPIDEMIOLOGY)
    return rows.groupBy(F.year("date").alias("year")).agg(
        F.sum("new_deceased").alias("sum_new_deceased"), F.sum("new_confirmed").alias("sum_new_confirmed"))


@query("s4_parquet_sink", "SELECT id, title, subreddit, score FROM posts", "posts")
def s4(spark, sf):
    path = scratch_path(spark, "posts")
    write_table(V.posts(spark, sf).select("id", "title", "subreddit", "score"), path)
    return read_table(spark, path)


@query("s5_year_sink", "SELECT id, score, CAST(year(created_utc) AS INTEGER) AS year FROM comments", "comments")
def s5(spark, sf):
    path = scratch_path(spark, "comments")
    write_by_year(V.comments(spark, sf).select("id", "score", "created_utc"), "created_utc", path, rebalance=True)
    return read_table(spark, path).select("id", "score", "year")


@query("s6_csv_sink", "SELECT subreddit, count(*) AS count FROM posts GROUP BY subreddit", "posts")
def s6(spark, sf):
    path = scratch_path(spark, "community-counts")
    write_csv(count_by(V.posts(spark, sf), "subreddit"), path, files=1, order_by=["subreddit"])
    return read_csv_table(spark, path, T.StructType([T.StructField("subreddit", T.StringType()), T.StructField("count", T.LongType())]))


@query("s8_sql_views", "SELECT subreddit, count(id) AS count, max(score) AS best FROM posts GROUP BY subreddit", "posts")
def s8(spark, sf):
    register_views(spark, {"threadlens_posts": V.posts(spark, sf)})
    return spark.sql("SELECT subreddit, count(id) AS count, max(score) AS best FROM threadlens_posts GROUP BY subreddit")


@query("s9_result_reload", "SELECT source, count(*) AS frequency, CAST(sum(score) AS BIGINT) AS total_score FROM sourced "
       "GROUP BY source HAVING count(*) > 2", "sourced")
def s9(spark, sf):
    path = scratch_path(spark, "sources")
    posts = drop_missing_source(V.posts(spark, sf).withColumn("source", news_source("url")))
    write_csv(source_totals(posts), path)
    return read_csv_table(spark, path, schemas.TOP_SOURCES).filter(F.col("frequency") > 2)


@query("s10_community_filter", "SELECT id, subreddit, score FROM posts WHERE subreddit IN ('news', 'worldnews')", "posts")
def s10(spark, sf):
    source, target = scratch_path(spark, "all-posts"), scratch_path(spark, "kept-posts")
    write_table(V.posts(spark, sf), source)
    filter_table(spark, source, target, "subreddit", "worldnews, news")
    return read_table(spark, target).select("id", "subreddit", "score")


@query("s10_filter_any_case", "SELECT id, subreddit FROM posts WHERE lower(subreddit) IN ('worldnews', 'newsbotbot')", "posts")
def s10_any_case(spark, sf):
    kept = filter_values(V.posts(spark, sf), "subreddit", "WorldNews, newsbotbot", case_insensitive=True)
    return kept.select("id", "subreddit")


@query("community_counts", "SELECT subreddit, count(id) AS count FROM posts GROUP BY subreddit", "posts")
def community_counts_query(spark, sf):
    register_views(spark, {"threadlens_submissions": V.posts(spark, sf)})
    return community_counts(spark, "threadlens_submissions")


@query("s3_checked_csv", """
    SELECT reason, count(*) AS count FROM (
        SELECT 'malformed' AS reason FROM epi WHERE new_deceased % 11 = 0
        UNION ALL SELECT 'new_deceased missing' FROM epi WHERE new_deceased IS NULL
        UNION ALL SELECT 'few cases' FROM epi WHERE coalesce(new_deceased % 11, 1) <> 0 AND floor(new_confirmed) < 50000
        UNION ALL SELECT 'good' FROM epi WHERE new_deceased % 11 <> 0 AND floor(new_confirmed) >= 50000) GROUP BY reason""", "epi")
def s3_checked(spark, sf):
    path = scratch_path(spark, "epidemiology-raw")
    count = F.floor("new_confirmed").cast("string")
    lost = F.col("new_deceased") % 11 == 0
    write_csv(V.epidemiology(spark, sf).select(
        F.to_date("date").alias("date"), F.when(lost, F.concat(count, F.lit(" cases"))).otherwise(count).alias("new_confirmed"), "new_deceased"), path)
    good, bad = read_checked_csv(spark, path, schemas.EPIDEMIOLOGY, {**required("new_deceased"), "few cases": F.col("new_confirmed") >= 50_000})
    return reason_counts(bad).unionByName(good.agg(F.count("date").alias("count")).select(F.lit("good").alias("reason"), "count").where("count > 0"))
