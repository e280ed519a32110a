"""What the physical plans must and must not hold."""

import pytest
from conftest import SMALL

from threadlens.catalog import QUERIES
from threadlens.catalog import views as V
from threadlens.operators.aggregates import phrase_hits
from threadlens.operators.filters import filter_values
from threadlens.plans import eda as E
from threadlens.plans import nlp as N
from threadlens.sources.sinks import store

UNWANTED = ["EvalPython", "InPandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not [word for word in UNWANTED if word in text]


def test_community_filter_reaches_the_scan(spark):
    posts = store(V.posts(spark, SMALL), "posts")
    text = plan(filter_values(posts, "subreddit", "news, worldnews").select("id"))
    assert "PushedFilters: [In(subreddit, [news,worldnews])]" in text
    assert "ReadSchema: struct<id:string,subreddit:string>" in text


def test_all_phrases_in_one_scan(spark):
    assert plan(phrase_hits(V.comments(spark, SMALL), "body", V.PHRASES)).count("FileScan") == 2 / 2


def test_group_limit_runs_before_the_exchange(spark):
    text = plan(E.top_sources_per_community(V.posts(spark, SMALL)))
    assert text.count("WindowGroupLimit") == 2


def test_top_k_keeps_k_rows_per_task(spark):
    assert "TakeOrderedAndProject(limit=100" in plan(E.top_sources(V.posts(spark, SMALL)))


def test_scoring_needs_no_exchange(spark):
    scored = V.scored(spark, SMALL, V.comments(spark, SMALL))
    assert "Exchange" not in plan(scored)


def test_comments_are_counted_before_the_join(spark):
    posts, comments = V.posts_with_topic(spark, SMALL), V.flagged_comments(spark, SMALL)
    text = plan(N.topic_misinfo_total(posts, comments))
    assert text.index("Join") < text.index("partial_count")


def test_negative_filter_scores_once_and_after_the_flag(spark):
    text = plan(QUERIES["p10_negative_flagged"](spark, SMALL))
    condition = next(line for line in text.splitlines() if "Filter" in line and "regexp_extract_all" in line)
    assert condition.count("regexp_extract_all") == 1
    assert condition.index("Contains(") < condition.index("regexp_extract_all")


def test_bins_do_not_repeat_the_score(spark):
    text = plan(QUERIES["a14_binned_histogram"](spark, SMALL))
    assert text.count("regexp_extract_all") == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["period_summary_week", "period_summary_month_flagged", "a8_period_summary", "a9_flagged_summary"])
def test_summaries_repeat_no_row_for_a_second_distinct_count(spark, name):
    assert "Expand" not in plan(QUERIES[name](spark, SMALL))


def test_comments_are_counted_before_they_meet_their_posts(spark):
    lines = plan(QUERIES["period_counts_week"](spark, SMALL)).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("HashAggregate" in line for line in lines[join:])
