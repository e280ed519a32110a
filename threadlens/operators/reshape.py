"""Union, unpivot, and samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of :func:`hash_bucket`.
BUCKETS = 2**32


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both tables, columns matched by name."""
    return a.unionByName(b)


def unpivot_measures(df: DataFrame, id_col: str, value_cols: list[str]) -> DataFrame:
    """One row per id and measure, as ``variable`` and ``value``."""
    return df.unpivot(id_col, value_cols, "variable", "value")


def hash_bucket(id_col: str | Column, salt: str) -> Column:
    """A 32-bit number that depends on the id and the salt alone."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(F.lit(f"{salt}:"), id_col.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def undersample(
    df: DataFrame, label_col: str, label, fraction: float, id_col: str, salt: str = "undersample"
) -> DataFrame:
    """Keep all other rows (also those without a label) and the given fraction of the rows labelled ``label``, chosen by id."""
    kept = hash_bucket(id_col, salt) < F.lit(fraction * BUCKETS)
    return df.filter(~F.col(label_col).eqNullSafe(F.lit(label)) | kept)


def split_column(id_col: str | Column, weights: list[float], salt: str = "split") -> Column:
    """The number of the part an id belongs to, part sizes in proportion to ``weights``."""
    bucket, total, upper = hash_bucket(id_col, salt), sum(weights), 0.0
    part = F.when(F.lit(False), F.lit(0))
    for i, weight in enumerate(weights[:-1]):
        upper += weight
        part = part.when(bucket < F.lit(upper / total * BUCKETS), F.lit(i))
    return part.otherwise(F.lit(len(weights) - 1))


def hash_split(df: DataFrame, id_col: str, weights: list[float], salt: str = "split") -> list[DataFrame]:
    """Disjoint parts that together are ``df``. Another salt than the sample's keeps the two independent."""
    part = split_column(id_col, weights, salt)
    return [df.filter(part == i) for i in range(len(weights))]
