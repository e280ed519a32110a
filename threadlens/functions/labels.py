"""Small column expressions: flags, labels, ratios, vectors."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.lookup import bind, literal_strings


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag_to_int(col: str | Column) -> Column:
    """TRUE becomes 1; FALSE and NULL become 0."""
    return F.coalesce(_col(col), F.lit(False)).cast("int")


def below(col: str | Column, threshold: float) -> Column:
    """1 where the value lies under ``threshold``, else 0; NULL stays NULL."""
    return (_col(col) < F.lit(threshold)).cast("int")


def label_by_count(col: str | Column, yes: str, no: str) -> Column:
    """``yes`` where the count is positive, otherwise ``no``."""
    return F.when(_col(col) > 0, F.lit(yes)).otherwise(F.lit(no))


def count_if(cond: Column) -> Column:
    """Aggregate: the number of rows where ``cond`` is true."""
    return F.count_if(cond)


def map_labels(col: str | Column, mapping: dict[int, str]) -> Column:
    """The name of a number; NULL for an unknown one."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return table[_col(col).cast("int")]


def indices_to_terms(col: str | Column, vocabulary: list[str]) -> Column:
    """Replace every index of an array by the term at that place of ``vocabulary``."""
    terms = literal_strings(vocabulary)
    return F.transform(_col(col), lambda i: F.get(terms, i))


def argmax(array_col: str | Column) -> Column:
    """Zero-based place of the largest element; the first one among equals."""
    values = _col(array_col)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def unit_vector(array_col: str | Column) -> Column:
    """The vector divided by its Euclidean length; a zero vector stays as it is."""
    values = F.transform(_col(array_col), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return bind(F.struct(values.alias("v"), length.alias("n")), lambda e: F.when(e["n"] == 0, e["v"]).otherwise(
        F.transform(e["v"], lambda x: x / e["n"])))


def zero_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Treat a zero as "not reported"."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in cols})


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Remove ``prefix`` wherever it occurs in a column name."""
    return df.toDF(*[re.sub(re.escape(prefix), "", c) for c in df.columns])


def with_thousands(col: str | Column) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(_col(col), 0)


def parse_thousands(col: str | Column) -> Column:
    """'1,234,567' -> 1234567; text that is no number gives NULL."""
    return F.regexp_replace(_col(col), ",", "").try_cast("bigint")


def ratio(num: str | Column, den: str | Column, scale: float = 1) -> Column:
    """``num / den * scale``; NULL for a zero denominator."""
    share = F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
    return share if scale == 1 else share * F.lit(float(scale))
