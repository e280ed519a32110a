"""Joining a table with hot keys to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALTS = 16


def join_unique(df: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``df``, where one key may hold most rows, to ``unique``, which has one row per key.

    The rows of a key are spread over a few salts, one after the other, and each row of ``unique`` is repeated
    per salt. Besides dividing a hot key this puts a plain exchange on both sides even when ``unique`` is an
    aggregate, and that is the shape in which AQE may split an oversized partition further, or drop the
    exchange for a broadcast once ``unique`` has been measured and is small.
    """
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
    repeated = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
