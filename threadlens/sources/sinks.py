"""Table and result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import scratch_path


def write_table(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at ``path``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_by_year(df: DataFrame, ts_col: str, path: str, rebalance: bool = False, only_years: bool = False) -> None:
    """Write one ``year=Y`` folder per calendar year in a single pass over ``df``.

    The table is replaced; with ``only_years`` the years present in ``df`` are, and others stay. Input that is not laid out by time would leave
    one file per task and year; ``rebalance`` adds one shuffle in which AQE merges small pieces and
    splits the year that holds most rows.
    """
    out = df.withColumn("year", F.year(ts_col))
    if rebalance:
        out = out.hint("rebalance", "year")
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only_years else "static")
        .partitionBy("year").parquet(path))


def write_csv(
    df: DataFrame,
    path: str,
    files: int | None = None,
    header: bool = True,
    order_by: list[str] | None = None,
) -> None:
    """Write CSV; ``files`` sets the number of files.

    The default writes one file per task, so any size goes through. ``files=1`` suits result tables
    (a few thousand rows): the rows are exchanged first, which leaves the aggregation before it
    running on all tasks, and ``order_by`` then orders the rows inside each file.
    """
    if files is not None:
        df = df.repartition(files)
    if order_by:
        df = df.sortWithinPartitions(*order_by)
    df.write.mode("overwrite").csv(path, header=header)


def store(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a table of the shared scratch folder and return that table.

    For results far smaller than their input that several passes read: the input is not scanned again, and
    a lost executor costs a re-read instead of a re-run of everything before.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
