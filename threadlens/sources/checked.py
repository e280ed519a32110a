"""Scans that part rows by rules: those that hold them all, and the others with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MALFORMED = "malformed"
REASONS = "reasons"
LINE = "line"


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows for which every rule is true, and the others with the names of the rules they break in ``reasons``.

    A rule that is NULL counts as broken; without rules all rows are good. Each row is in exactly one of the two
    tables, which are narrow: no exchange, nothing is counted or stored. A column named ``reasons`` raises an error.
    """
    if REASONS in df.columns:
        raise ValueError(f"column {REASONS} is taken")
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    reasons = F.filter(F.array(*broken), lambda name: name.isNotNull()) if broken else F.array().cast("array<string>")
    good = df
    for rule in rules.values():
        good = good.where(rule)
    return good, df.withColumn(REASONS, reasons).where(F.size(REASONS) > 0)


def required(*columns: str) -> dict[str, Column]:
    """Rules that the columns are not NULL."""
    return {f"{c} missing": F.col(c).isNotNull() for c in columns}


def read_checked_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, rules: dict[str, Column] | None = None, header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Good rows of a CSV table with the columns of ``schema``, and the bad ones with ``line`` and ``reasons``.

    A line is malformed if a value does not have its column's type or if it has too few or too many values; ``line`` is
    then the text of the line, otherwise NULL. The rules hold for lines that are not malformed. Lines are parsed
    whole whatever columns a query reads later, so a line is good or bad for every query alike.
    """
    if LINE in schema.names:
        raise ValueError(f"column {LINE} is taken")
    whole = T.StructType([*schema.fields, T.StructField(LINE, T.StringType(), True)])
    lines = spark.read.option("columnPruning", "false").csv(path, header=header, schema=whole, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, enforceSchema=True)
    # A value is only converted, and so found wrong, where its column is needed: this needs all, and is NULL just where the
    # line is, as no line ends in a line break.
    sound = F.nullif(F.col(LINE), F.concat(*[F.col(f"`{c}`").cast("string") for c in schema.names], F.lit("\n"))).isNull()
    good, bad = quarantine(lines, {MALFORMED: sound, **{name: ~sound | rule for name, rule in (rules or {}).items()}})
    return good.drop(LINE), bad


def reason_counts(bad: DataFrame) -> DataFrame:
    """reason, count: how many rows break each rule."""
    return bad.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))
