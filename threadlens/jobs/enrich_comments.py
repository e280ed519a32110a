"""Fit topics on post titles and write the enriched comments, one row per comment with a known post.

    spark-submit -m threadlens.jobs.enrich_comments --posts <path> --comments <path> --lexicon <path>
        --output <path> [--topics-csv <path>] [--wide-phrases] [--clean]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens import schemas
from threadlens.constants import MISINFO_PHRASES, MISINFO_PHRASES_WIDE
from threadlens.operators.topics import assign_topic, describe_topics, fit_topics
from threadlens.plans.nlp import enriched_comments, save_enriched
from threadlens.session import build_session
from threadlens.sources.readers import read_csv_table, read_table
from threadlens.sources.sinks import store, write_csv

log = logging.getLogger(__name__)


def enrich(
    spark: SparkSession, posts: DataFrame, comments: DataFrame, lexicon: DataFrame, output: str, topics_csv: str | None = None,
    wide_phrases: bool = False, clean: bool = False, **topic_options,
) -> DataFrame:
    """Write the enriched comments to ``output`` and return the table.

    The posts with their topics are stored before the join: they are small next to the comments, and a
    retried task then reads them back instead of running the model again.
    """
    model = fit_topics(posts, "title", **topic_options)
    if topics_csv:
        topics = describe_topics(model).select("topic", F.concat_ws(" ", "terms").alias("terms"))
        write_csv(topics, topics_csv, files=1, order_by=["topic"])
    topic_posts = store(assign_topic(model, posts.select("id", "created_utc", "title")), "topic-posts")
    phrases = MISINFO_PHRASES_WIDE if wide_phrases else MISINFO_PHRASES
    return save_enriched(enriched_comments(topic_posts, comments, lexicon, phrases, clean), output)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--posts", required=True)
    parser.add_argument("--comments", required=True)
    parser.add_argument("--lexicon", required=True, help="CSV with the columns word, valence")
    parser.add_argument("--output", required=True)
    parser.add_argument("--topics-csv")
    parser.add_argument("--wide-phrases", action="store_true", help="use the longer phrase set")
    parser.add_argument("--clean", action="store_true", help="clean the comment text first")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = build_session("enrich-comments")
    table = enrich(spark, read_table(spark, args.posts), read_table(spark, args.comments),
                   read_csv_table(spark, args.lexicon, schemas.LEXICON), args.output, args.topics_csv,
                   args.wide_phrases, args.clean)
    log.info("wrote %s", ", ".join(table.columns))


if __name__ == "__main__":
    main()
