"""Least squares from sums that merge: one aggregation over the rows, then arithmetic on one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A feature is left out if the others explain all but this share of its variance.
TOLERANCE = 1e-10


def _name(i: int, j: int) -> str:
    return f"_r{min(i, j)}_{max(i, j)}"


def _moments(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per group the rows, means and centred products of every two columns; sums of parts merge, so a hot group is added up
    in all map tasks. Rows with a NULL, NaN or infinite value are left out."""
    values = [f"_v{i}" for i in range(len(columns))]
    known = df.select(*by, *[F.col(c).cast("double").alias(v) for c, v in zip(columns, values)])
    for v in values:
        known = known.where(F.abs(v) < float("inf"))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(f"_m{i}") for i, v in enumerate(values)],
        *[F.covar_pop(values[i], values[j]).alias(f"_s{i}_{j}") for i, j in pairs])


def _sweep(df: DataFrame, k: int, size: int, keep: list[str]) -> DataFrame:
    """Take column ``k`` into the model: the matrix of correlations is swept on it, unless it is explained already."""
    d, column = F.col(_name(k, k)), lambda i: F.col(_name(i, k))
    used = F.coalesce(d > TOLERANCE, F.lit(False))

    def entry(i: int, j: int) -> Column:
        old = F.col(_name(i, j))
        if i == k == j:
            new = -1 / d
        elif k in (i, j):
            new = old / d
        else:
            new = old - column(i) * column(j) / d
        return F.when(used, new).otherwise(old).alias(_name(i, j))

    return df.select(*keep, used.alias(f"_used{k}"), *[entry(i, j) for i in range(size) for j in range(i, size)])


def linear_regression(df: DataFrame, target: str, features: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group of ``by`` (one row in all without) the least-squares model of ``target`` on the features.

    Columns: ``by``, n, intercept, mse (divisor n), r2, terms: array of (feature, coefficient, std_error). The rows are read
    once, and nothing is solved on the driver, so there may be any number of groups. The correlations are swept on one
    feature after the other. A feature that is constant, or that earlier ones explain, has coefficient 0 and no standard
    error. Without degrees of freedom standard errors are NULL, with a constant target r2 is; a model over no rows has n 0
    and NULL elsewhere.
    """
    by, size, last = list(by or []), len(features) + 1, len(features)
    fit = _moments(df, [*features, target], by)
    scaled = [F.coalesce(F.try_divide(F.col(f"_s{i}_{j}"), F.sqrt(F.col(f"_s{i}_{i}")) * F.sqrt(F.col(f"_s{j}_{j}"))), F.lit(0.0)).alias(_name(i, j))
              for i in range(size) for j in range(i, size)]
    keep = [*by, "_n", *[f"_m{i}" for i in range(size)], *[f"_s{i}_{i}" for i in range(size)]]
    fit = fit.select(*keep, *scaled)
    for k in range(last):
        fit = _sweep(fit, k, size, keep)
        keep.append(f"_used{k}")
    spread = F.col(f"_s{last}_{last}")
    fit = fit.select(
        *keep, (F.greatest(F.col(_name(last, last)), F.lit(0.0)) * spread).alias("_mse"),
        (F.col("_n") - 1 - sum((F.col(f"_used{k}").cast("int") for k in range(last)), F.lit(0))).alias("_free"),
        *[F.when(F.col(f"_used{k}"), F.col(_name(k, last)) * F.sqrt(spread / F.col(f"_s{k}_{k}"))).otherwise(F.when(F.col("_n") > 0, 0.0)).alias(f"_b{k}") for k in range(last)],
        *[F.when(F.col(f"_used{k}"), -F.col(_name(k, k)) / F.col(f"_s{k}_{k}")).alias(f"_i{k}") for k in range(last)])
    error = lambda k: F.when(F.col("_free") > 0, F.sqrt(F.col("_mse") / F.col("_free") * F.col(f"_i{k}")))
    terms = [F.struct(F.lit(c).alias("feature"), F.col(f"_b{k}").alias("coefficient"), error(k).alias("std_error")) for k, c in enumerate(features)]
    terms = F.array(*terms).cast("array<struct<feature:string,coefficient:double,std_error:double>>")
    intercept = F.col(f"_m{last}") - sum((F.col(f"_b{k}") * F.col(f"_m{k}") for k in range(last)), F.lit(0.0))
    return fit.select(
        *by, F.col("_n").alias("n"), intercept.alias("intercept"), F.col("_mse").alias("mse"),
        (1 - F.try_divide(F.col("_mse"), spread)).alias("r2"), terms.alias("terms"))


def regression_terms(fit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group and feature of :func:`linear_regression`: ``by``, feature, coefficient, std_error."""
    return fit.select(*(by or []), F.inline("terms"))
