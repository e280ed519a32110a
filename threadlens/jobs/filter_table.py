"""Keep the rows of a dump that belong to chosen communities.

    spark-submit -m threadlens.jobs.filter_table --input <parquet path or glob> --output <path>
        --column subreddit --values "news, worldnews"
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from threadlens.operators.filters import filter_values, parse_values
from threadlens.session import build_session
from threadlens.sources.readers import read_table
from threadlens.sources.sinks import write_table

log = logging.getLogger(__name__)


def filter_table(
    spark: SparkSession, source: str, target: str, column: str, values: str,
    case_insensitive: bool = False, base_path: str | None = None,
) -> int:
    """Write the matching rows of ``source`` to ``target`` and return their number.

    The number comes from the footers of the files written; the dump is read once.
    """
    write_table(filter_values(read_table(spark, source, base_path=base_path), column, parse_values(values), case_insensitive), target)
    return read_table(spark, target).count()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True, help="Parquet path or glob")
    parser.add_argument("--output", required=True, help="path of the table to replace")
    parser.add_argument("--column", default="subreddit", help="column to filter on")
    parser.add_argument("--values", required=True, help="comma-separated values to keep")
    parser.add_argument("--base-path", help="folder above the partition folders")
    parser.add_argument("--ignore-case", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    rows = filter_table(build_session("filter-table"), args.input, args.output, args.column, args.values,
                        args.ignore_case, args.base_path)
    log.info("wrote %s rows for %s", f"{rows:,}", parse_values(args.values))


if __name__ == "__main__":
    main()
