"""Table scans and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = None,
    base_path: str | None = None,
    file_glob: str | None = None,
) -> DataFrame:
    """Parquet scan over a folder, a partitioned folder or a glob such as ``.../year=2021/month=*``.

    With ``base_path`` the ``key=value`` folders below it become columns, so a filter on them
    prunes folders instead of reading files. ``schema`` avoids opening a footer to learn the types.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if base_path is not None:
        reader = reader.option("basePath", base_path)
    if file_glob is not None:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_csv_table(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """CSV scan with a stated schema: one pass, no inference job."""
    return spark.read.csv(path, header=header, schema=schema)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Make the tables known to ``spark.sql`` under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
