"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 3; the median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame

from threadlens.catalog import QUERIES
from threadlens.session import build_session

HEADLINES = [
    "top_sources", "top_sources_per_community", "source_rankings", "top_authors", "activity_by_year",
    "activity_by_weekday", "phrase_counts", "phrase_hits", "misinfo_rate_by_year", "score_summary",
    "topic_counts", "topic_misinfo_counts", "topic_misinfo_total", "negative_share_by_topic",
    "sentiment_histogram", "period_counts_week", "period_misinfo_counts_month", "period_post_counts_week",
    "period_summary_week", "period_summary_month_flagged", "epidemiology_rollup_week", "vaccination_rollup_month",
    "covid_joined_week", "covid_joined_month", "series_correlation", "series_regression", "article_labels",
    "label_counts", "balanced_sample", "community_counts", "j2_posts_comments", "w2_rank_max", "l4_valence_sentiment",
    "l5_polarity_sentiment", "l15_cooccurrence", "m4_vocabulary", "m13_lemmatize", "l3_assign_topic",
    "classifier_report", "title_clusters",
]


def consume(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINES:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            consume(QUERIES[name](spark, sf_dir))
            if run:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_time_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
