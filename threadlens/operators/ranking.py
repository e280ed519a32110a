"""Top-k, ranks and running totals without a single-task sort."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.sources.sinks import store

_SALTS = 256
#: Distinct values of one range of running totals.
_PER_RANGE = 50_000
_BROADCAST_ROWS = 10_000


def _descending(order_cols: list[str]) -> list[Column]:
    return [F.col(c).desc() for c in order_cols]


def _ascending(cols) -> list[Column]:
    return [F.col(c).asc() for c in ([cols] if isinstance(cols, str) else cols)]


def top_n_per_group(
    df: DataFrame, group: str | list[str], order_cols: list[str], n: int, tie_break: str | list[str], out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group by ``order_cols`` descending, numbered in ``out``.

    ``tie_break`` (ascending) makes the order total. Up to the session's group-limit threshold Spark keeps
    ``n`` rows per group in every map task before the exchange. Beyond it the same cut is made in two
    steps here, first inside salted parts of a group, so that no task ever sorts a whole hot group.
    """
    groups = [group] if isinstance(group, str) else list(group)
    order = _descending(order_cols) + _ascending(tie_break)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        ties = [tie_break] if isinstance(tie_break, str) else list(tie_break)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(_SALTS)))
        part = Window.partitionBy(*groups, "_salt").orderBy(*order)
        df = (salted.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= n).drop("_salt", "_n"))
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col(out) <= n)


def top_k(df: DataFrame, order_cols: list[str], k: int, tie_break: str | list[str], skip: int = 0) -> DataFrame:
    """The ``k`` rows after the first ``skip`` by ``order_cols`` descending: every task keeps ``k + skip``."""
    ordered = df.orderBy(*_descending(order_cols), *_ascending(tie_break))
    if skip:
        ordered = ordered.offset(skip)
    return ordered.limit(k)


def skip_top(df: DataFrame, order_cols: list[str], key: str, n: int = 1) -> DataFrame:
    """All rows but the first ``n`` by ``order_cols`` descending; ``key`` is unique and breaks ties.

    The ``n`` rows are found by a top-k and removed by an anti-join against them, so the rest is
    neither sorted nor numbered.
    """
    first = top_k(df, order_cols, n, key).select(F.col(key).alias("_first"))
    if n <= _BROADCAST_ROWS:
        first = F.broadcast(first)
    return df.join(first, F.col(key).eqNullSafe(F.col("_first")), "left_anti")


def rank_max(col: str | Column, descending: bool = True) -> Column:
    """Window expression: the number of rows whose value is at least (ascending: at most) this one.

    It looks at the whole table in one task. Use it on result tables of known size, such as a top-100
    list, and :func:`add_rank_max` on anything else. NULL and NaN have no rank and are not counted.
    """
    col = F.col(col) if isinstance(col, str) else col
    order = col.desc() if descending else col.asc()
    whole = Window.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = col.isNotNull() & ~F.isnan(col.cast("double"))
    return F.when(known, F.count(F.when(known, 1)).over(whole)).cast("int")


def running_totals(df: DataFrame, order_col: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """For every value of a numeric column the sums over all rows up to and including that value.

    Rows are first merged per value, so repeats cost nothing later, and the merged values are stored: the
    input is read once, when this function is called. The distinct values are then split
    at approximate quantiles (one for every 50,000 distinct values; these numbers are all that
    reaches the driver), summed up inside each range, and shifted by the total of the ranges before.
    The result is exact wherever the cuts fall. NULL and NaN values take no part.
    """
    merged = store(
        df.filter(F.col(order_col).isNotNull() & ~F.isnan(F.col(order_col).cast("double")))
        .groupBy(order_col).agg(*[expr.alias(name) for name, expr in sums.items()]), "merged-values")
    ranges = max(2, -(-merged.count() // _PER_RANGE))
    cuts = merged.select(F.col(order_col).cast("double").alias("v")).approxQuantile(
        "v", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    edges = [float("-inf"), *sorted(set(cuts) - {float("-inf"), float("inf")}), float("inf")]
    if len(edges) < 3:
        edges.insert(1, 0.0)
    placed = Bucketizer(splits=edges, inputCol="_v", outputCol="_range").transform(
        merged.withColumn("_v", F.col(order_col).cast("double")))

    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = Window.partitionBy("_range").orderBy(direction(order_col)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(*[F.sum(name).alias(f"_{name}") for name in sums])
    offsets = totals.select("_range", *[
        F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    running = placed.withColumns({name: F.sum(name).over(inside) for name in sums})
    return (running.join(F.broadcast(offsets), "_range")  # at most `ranges` rows
            .select(order_col, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums]))


def add_rank_max(df: DataFrame, col: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """:func:`rank_max` for tables of any size: ranks of the distinct values joined back to the rows."""
    ranks = running_totals(df, col, {out: F.count(F.lit(1))}, descending)
    return df.join(ranks, col, "left")
