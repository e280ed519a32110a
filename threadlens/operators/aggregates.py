"""Counts, sums, shares and roll-ups."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.constants import NOT_PERCEIVED, PERCEIVED
from threadlens.functions.labels import below, count_if, flag_to_int, ratio
from threadlens.functions.lookup import literal_strings
from threadlens.functions.text import found_phrases, matches_any, part_phrases
from threadlens.operators.ranking import top_k
from threadlens.operators.skew import join_unique


def source_totals(df: DataFrame, keys: str | list[str] = "source") -> DataFrame:
    """Posts and summed score per source, or per source and further keys."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count("source").alias("frequency"), F.sum("score").alias("total_score"))


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Number of rows per key."""
    return df.groupBy(*keys).count()


def count_by_calendar(df: DataFrame, ts_col: str, part: str) -> DataFrame:
    """Number of rows per calendar part: ``year``, ``month``, ``week`` or ``day`` (of the week, 1 = Sunday)."""
    parts = {"year": F.year, "month": F.month, "week": F.weekofyear, "day": F.dayofweek}
    return df.groupBy(parts[part](ts_col).alias(part)).count()


def active_authors(df: DataFrame, min_count: int = 5000) -> DataFrame:
    """Authors with more than ``min_count`` rows."""
    counts = df.groupBy("author").agg(F.count(F.lit(1)).alias("submission_count"))
    return counts.filter(F.col("submission_count") > min_count)


def community_counts(spark: SparkSession, view: str) -> DataFrame:
    """Rows per community of a registered view, largest first, as a SQL query."""
    return spark.sql(
        "SELECT subreddit, count(id) AS count FROM IDENTIFIER(:view) "
        "GROUP BY subreddit ORDER BY count DESC, subreddit",
        args={"view": view},
    )


def rollup_sums(df: DataFrame, cols: list[str] | tuple[str, ...], grain: str) -> DataFrame:
    """``sum_<col>`` per (year, ``grain``), in order; ``grain`` is ``week`` or ``month``."""
    return (df.groupBy("year", grain)
            .agg(*[F.sum(c).alias(f"sum_{c}") for c in cols])
            .orderBy("year", grain))


def period_summary(df: DataFrame, grain: str | list[str], flagged_only: bool = False) -> DataFrame:
    """Score sums, distinct posts and comments, and flagged comments per period.

    ``grain`` names the period columns: ``year_week``, or ``["year", "month"]``. With ``flagged_only``
    just the flagged rows count and ``misinfo_count`` is left out.

    Rows are summed per period and post first, so each step has at most one distinct count and no row is
    repeated for it. A comment id belongs to one post.
    """
    keys = [grain] if isinstance(grain, str) else list(grain)
    if flagged_only:
        df = df.filter(F.col("misinfo_class"))
    per_post = df.groupBy(*keys, "id").agg(
        F.sum("vader_score").alias("_v"), F.sum("textblob_score").alias("_t"),
        F.count_distinct("comment_id").alias("_c"), count_if(F.col("misinfo_class")).alias("_m"))
    measures = [
        F.sum("_v").alias("sum_vader_score"),
        F.sum("_t").alias("sum_textblob_score"),
        F.count("id").alias("posts_count"),
        F.sum("_c").alias("comments_count"),
    ]
    if flagged_only:
        return per_post.groupBy(*keys).agg(*measures)
    return per_post.groupBy(*keys).agg(*measures, F.sum("_m").alias("misinfo_count"))


def period_counts(
    df: DataFrame, grain: str | list[str], distinct_col: str | None = None, flagged_only: bool = False
) -> DataFrame:
    """Rows, or distinct values of ``distinct_col``, per period; of flagged rows only if asked."""
    keys = [grain] if isinstance(grain, str) else list(grain)
    if flagged_only:
        df = df.filter(F.col("misinfo_class"))
    measure = F.count_distinct(distinct_col) if distinct_col else F.count(F.lit(1))
    return df.groupBy(*keys).agg(measure.alias("count"))


def share_below(
    df: DataFrame, key: str, score_col: str, threshold: float, count_name: str = "count_below", percent_name: str = "percentage_below"
) -> DataFrame:
    """Per key: comments, comments with a score under ``threshold``, and their percentage."""
    counts = df.groupBy(key).agg(
        F.count("comment_id").alias("total_comments"),
        F.sum(below(score_col, threshold)).alias(count_name),
    )
    return counts.withColumn(percent_name, ratio(count_name, "total_comments", 100))


def score_histogram(df: DataFrame, score_col: str = "vader_score") -> DataFrame:
    """Rows per exact score."""
    return df.groupBy(score_col).count()


def binned_histogram(df: DataFrame, score_col: str, count_col: str, edges: list[float]) -> DataFrame:
    """Counts summed per bin; bins hold their right edge, the first one its left edge too.

    Scores are 32-bit, where -0.9 lies a little above -0.9, so scores are rounded to four places first.
    Scores outside the edges fall in no bin; an empty bin shows 0.
    """
    score = F.round(F.col(score_col).cast("double"), 4)
    cuts = [round(float(e), 4) for e in edges]
    bin_no = F.when(score < cuts[0], None)
    for i, edge in enumerate(cuts[1:]):
        bin_no = bin_no.when(score <= edge, i)
    # The bins are few and known: one counter each, no join to a table of bins.
    spans = list(enumerate(zip(cuts, cuts[1:])))
    sums = df.select(bin_no.alias("_bin"), F.col(count_col).alias("_n")).agg(*[
        F.coalesce(F.sum(F.when(F.col("_bin") == i, F.col("_n"))), F.lit(0)).alias(f"_{i}") for i, _ in spans])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(f"[{low:.1f}~{high:.1f}]").alias("binned"), F.col(f"_{i}").alias("count"))
        for i, (low, high) in spans])))


def prediction_analysis(
    df: DataFrame, key: str = "topic", label_col: str = "label", pred_col: str = "predictedMisinfo",
    negative=NOT_PERCEIVED, positive=PERCEIVED,
) -> DataFrame:
    """Right and wrong predictions per key, the wrong ones by kind, and two ratios."""
    label, pred = F.col(label_col), F.col(pred_col)
    counts = df.groupBy(key).agg(
        count_if(label == pred).alias("true label"),
        count_if(label != pred).alias("false label"),
        count_if((label != pred) & (label == negative)).alias("incorrectly labeled as misinfo"),
        count_if((label != pred) & (label == positive)).alias("incorrectly labeled as no misinfo"),
    )
    missed, raised = F.col("incorrectly labeled as no misinfo"), F.col("incorrectly labeled as misinfo")
    return counts.withColumns({
        "true ratio": ratio("true label", F.col("true label") + F.col("false label")),
        "incorrectly labeled misinfo ratio": ratio(missed, missed + raised),
    })


def confusion_matrix(df: DataFrame, label_col: str, pred_col: str, classes: list) -> DataFrame:
    """One row per true class, one ``pred_<class>`` column per predicted class; absent pairs are 0."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(*[
        count_if(F.col(pred_col) == F.lit(c)).alias(f"pred_{c}") for c in classes])
    return counts


def share_of_total(df: DataFrame, count_col: str, group: str | None = None, out: str = "share") -> DataFrame:
    """Each row's percentage of the sum of ``count_col``, over the table or over its ``group``.

    The sum is a partial aggregate used as a scalar, or joined back per group: no window pulls the
    rows of a table or of a large group into one task. ``df`` is read twice, so a result that is costly
    to compute should be stored first.
    """
    if group is None:
        total = df.agg(F.sum(count_col).alias("t")).scalar()
        return df.withColumn(out, ratio(count_col, total, 100))
    totals = df.groupBy(group).agg(F.sum(count_col).alias("_total"))
    return join_unique(df, totals, group).withColumn(out, ratio(count_col, "_total", 100)).drop("_total")


def phrase_hits(df: DataFrame, text_col: str, phrases) -> DataFrame:
    """For every phrase the number of texts that hold it, all counted in one pass.

    A few phrases are columns of one aggregate. Many plain ones are found together, and a text sends each phrase
    that it holds, summed in every task.
    """
    together, others = part_phrases(phrases)
    parts = []
    if others or not together:
        names = {p: f"_p{i}" for i, p in enumerate(others)}
        counts = df.agg(*[count_if(matches_any(text_col, [p])).alias(n) for p, n in names.items()])
        parts.append(counts.select(F.inline(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(n).alias("count")) for p, n in names.items()]))))
    if together:
        found = df.select(F.explode(found_phrases(text_col, together)).alias("phrase"), F.lit(1).cast("long").alias("n"))
        listed = df.sparkSession.range(1).select(F.explode(literal_strings(together)).alias("phrase"), F.lit(0).cast("long").alias("n"))
        parts.append(found.unionByName(listed).groupBy("phrase").agg(F.sum("n").alias("count")))
    return reduce(DataFrame.unionByName, parts)


def flag_rate(df: DataFrame, flag_col: str, period_col: str | Column) -> DataFrame:
    """Rows, flagged rows and their ratio per period."""
    counts = df.groupBy(period_col).agg(
        F.count(F.lit(1)).alias("total"), F.sum(flag_to_int(flag_col)).alias("flagged"))
    return counts.withColumn("rate", ratio("flagged", "total"))


def merge_aliases(df: DataFrame, key: str, aliases: dict[str, str], sum_cols: list[str]) -> DataFrame:
    """Lower-case the key, map spellings that mean the same to one, and sum again."""
    name = F.lower(key)
    if aliases:
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(aliases.items())])
        name = F.coalesce(table[name], name)
    return df.groupBy(name.alias(key)).agg(*[F.sum(c).alias(c) for c in sum_cols])


def term_weights(df: DataFrame, key: str, weight_col: str, n: int) -> DataFrame:
    """The ``n`` heaviest keys: the data of a word cloud."""
    return top_k(df.select(key, F.col(weight_col).alias("weight")), ["weight"], n, key)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Every value of ``col`` once."""
    return df.select(col).distinct()


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """One row with the number of different values of ``col``."""
    return df.agg(F.count_distinct(col).alias("count"))


def weekday_counts(df: DataFrame, ts_col: str, out: str) -> DataFrame:
    """Rows per day of the week with the count under the name ``out``."""
    return count_by_calendar(df, ts_col, "day").withColumnRenamed("count", out)


