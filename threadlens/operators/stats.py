"""Summaries, correlation, regression, co-occurrence."""

from __future__ import annotations

from itertools import combinations
from math import ceil, isinf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import matches_any
from threadlens.operators.regression import linear_regression

#: Cells into which the values near a place are cut.
_CELLS = 4096


def describe_scores(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum of every column, one row per column."""
    parts = {"count": F.count, "mean": F.mean, "stddev": F.stddev, "min": F.min, "max": F.max}
    stats = df.agg(*[fn(c).cast("double").alias(f"{name}__{i}") for i, c in enumerate(cols) for name, fn in parts.items()])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"count__{i}").cast("bigint").alias("count"),
                 *[F.col(f"{name}__{i}").alias(name) for name in parts if name != "count"])
        for i, c in enumerate(cols)])
    return stats.select(F.inline(rows))


def _equal_cells(low, high) -> Column:
    """The cell of ``v`` among equal cells from ``low`` to ``high``; infinite ends have cells of their own."""
    if isinf(float(low)) or isinf(float(high)):
        return F.when(F.col("v") == F.lit(low), 0).when(F.col("v") == F.lit(high), 2).otherwise(1).cast("long")
    return F.floor((F.col("v") - F.lit(low)).cast("double") / F.lit(float(high - low)) * _CELLS)


def exact_quantiles(df: DataFrame, col: str, shares: dict[str, float]) -> dict[str, object]:
    """For every name the smallest value that at least its share (above 0, up to 1) of the rows does not exceed.

    Distributed selection: a pass counts the rows by cells of values and keeps the smallest and largest value of each, the
    first by cells of a relative width of 1/64, later ones by ``_CELLS`` equal cells of what is left. Only these counts come
    here (of the first pass some 270,000 at the very most). A place is found once its cell holds one value, so whole numbers take
    two or three passes, whatever their number; nothing is sorted or stored. NULL and NaN take no part; without
    values the result is None.
    """
    value = F.col(col)
    known = df.where(value.isNotNull() & ~F.isnan(value.cast("double"))).select(value.alias("v"))
    size = F.col("v").cast("double")
    relative = F.signum(size) * (F.floor(F.log2(F.least(F.abs(size), F.lit(1.7e308))) * 64) + (1 << 17))
    placed = known.select("v", F.lit(0).alias("span"), F.when(size == 0, F.lit(0)).otherwise(relative).cast("int").alias("cell"))
    found: dict[str, object] = dict.fromkeys(shares)
    open_spans: dict[int, list[tuple[str, int | None]]] = {0: [(name, None) for name in shares]}
    while open_spans:
        counts = placed.groupBy("span", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        cells: dict[int, list] = {}
        for row in counts.collect():
            cells.setdefault(row["span"], []).append(row)
        left: dict[tuple, list[tuple[str, int | None]]] = {}
        for span, wanted in open_spans.items():
            ordered = sorted(cells.get(span, []), key=lambda r: r["cell"])
            rows = sum(r["n"] for r in ordered)
            for name, place in wanted:
                place = max(1, ceil(shares[name] * rows)) if place is None else place
                for cell in ordered:
                    if place <= cell["n"]:
                        if cell["low"] == cell["high"]:
                            found[name] = cell["low"]
                        else:
                            left.setdefault((cell["low"], cell["high"]), []).append((name, place))
                        break
                    place -= cell["n"]
        open_spans = dict(enumerate(left.values()))
        spans = list(left)
        inside = [(F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)) for low, high in spans]
        span = F.coalesce(*[F.when(test, F.lit(k)) for k, test in enumerate(inside)], F.lit(None).cast("int"))
        cut = [F.when(test, _equal_cells(low, high)) for test, (low, high) in zip(inside, spans)]
        placed = known.select("v", span.alias("span"), F.coalesce(*cut, F.lit(None).cast("long")).alias("cell")).where("span IS NOT NULL")
    return found


def score_summary(df: DataFrame, col: str = "score") -> DataFrame:
    """Count, mean, standard deviation, minimum, exact quartiles and maximum, one row each in this order, as strings."""
    quartiles = exact_quantiles(df, col, {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    kind = df.schema[col].dataType
    whole = df.agg(
        F.count(col).alias("count"), F.mean(col).alias("mean"), F.stddev(col).alias("stddev"), F.min(col).alias("min"),
        *[F.lit(v).cast(kind).alias(name) for name, v in quartiles.items()], F.max(col).alias("max"))
    return whole.select(F.inline(F.array(*[F.struct(F.lit(c).alias("summary"), F.col(f"`{c}`").cast("string").alias(col)) for c in whole.columns])))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row with the Pearson correlation of two columns, over the rows that have both."""
    return df.agg(F.corr(x, y).alias("corr"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in long form, all pairs in one aggregation."""
    pairs = [(a, b) for a in cols for b in cols]
    unique = {tuple(sorted(p)): f"_c{i}" for i, p in enumerate(sorted({tuple(sorted(p)) for p in pairs}))}
    stats = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(n) for (a, b), n in unique.items()])
    rows = F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(unique[tuple(sorted((a, b)))]).alias("corr"))
        for a, b in pairs])
    return stats.select(F.inline(rows))


def simple_regression(df: DataFrame, target: str, feature: str) -> DataFrame:
    """One row with slope, intercept, R² and mean squared error of ``target`` on one feature."""
    y, x = F.col(target).cast("double"), F.col(feature).cast("double")
    fit = df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("_syy"), F.regr_count(y, x).alias("_n"))
    return fit.select("slope", "intercept", "r2", F.try_divide((1 - F.col("r2")) * F.col("_syy"), F.col("_n")).alias("mse"))


def series_regression(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """One row with mean squared error and R² of the linear model of ``target`` on the features; rows with a NULL are left out."""
    return linear_regression(df, target, features).select("mse", "r2")


def cooccurrence(df: DataFrame, items: dict[str, Column]) -> DataFrame:
    """For every pair of items the number of rows that have both, as (a, b, count) with a < b and count > 0.

    ``items`` maps a fixed list of names to their tests. A row is repeated once per item it has, never once
    per pair, and sums the tests of all other items: n groups of n counters, merged in every map task.
    """
    names = sorted(items)
    flags = df.select(*[F.coalesce(items[n], F.lit(False)).cast("int").alias(f"_i{k}") for k, n in enumerate(names)])
    held = F.filter(F.array(*[F.when(F.col(f"_i{k}") == 1, k) for k in range(len(names))]), lambda k: k.isNotNull())
    sums = (flags.withColumn("_a", F.explode(held)).groupBy("_a")
            .agg(*[F.sum(f"_i{k}").alias(f"_i{k}") for k in range(len(names))]))
    pairs = F.array(*[
        F.struct(F.lit(a).alias("_k"), F.lit(names[a]).alias("a"), F.lit(names[b]).alias("b"), F.col(f"_i{b}").alias("count"))
        for a, b in combinations(range(len(names)), 2)])
    own = F.filter(pairs, lambda p: p["_k"] == F.col("_a"))
    return sums.select(F.inline(own)).filter(F.col("count") > 0).select("a", "b", "count")


def term_cooccurrence(df: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """:func:`cooccurrence` of terms found as substrings of a text."""
    return cooccurrence(df, {t: matches_any(text_col, [t]) for t in dict.fromkeys(terms)})
