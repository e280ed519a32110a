"""Mixing sources to target weights.

The words of every source are summed, targets are derived from the weights, and the repetition rate of a source is
target / size. A document is emitted floor(rate) times, plus once more with probability rate - floor(rate), decided
by a hash of its id and a seed. Everything is a column expression; what reaches the driver is three numbers a round.

Defined cases: a NULL text has size 0; a NULL source is a source of its own, the last in order; sources without words
have target 0 and rate 0; an empty table gives no rows; rows that repeat an id draw by id and text together, so exact
repeats of a whole row share their draw. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ordinals, word_count
from threadlens.sources.sinks import store

#: 32 bits of a digest are compared with the fraction.
_RANGE = float(2**32)


def draw(id_: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id (on the text where the id is NULL) and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(_RANGE)


def cyclic_weights(totals: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``totals`` with ``weight``: the sources in code point order, NULL last, take the weights in turn."""
    numbered = ordinals(totals, [F.col("source").isNull(), F.col("source").asc_nulls_last()], "place")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return numbered.withColumn("weight", F.get(values, (F.col("place") % len(weights)).cast("int"))).drop("place")


def fill_targets(totals: DataFrame, share: float, max_rate: float) -> DataFrame:
    """``totals`` (source, source_size, weight) with ``target``.

    ``share`` times all words go to the sources by weight. A source takes at most ``max_rate`` times its size; what is
    above goes to the others by weight, until none is above. Each round is one sum over a row per source. Caps are
    compared as cap <= weight * level, and a source once capped stays so, as the level never falls.
    """
    cap = F.col("source_size") * F.lit(float(max_rate))
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = (cap <= F.col("weight") * F.lit(level)) if capped >= 0 else F.lit(False)
        now = totals.agg(
            F.count_if(full).alias("capped"),
            F.sum(F.when(full, cap)).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        if now["capped"] == capped or not now["weights"]:
            break
        capped = now["capped"]
        level = (share * total - (now["taken"] or 0.0)) / now["weights"]
    return totals.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_rate: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies.

    The texts are read once: sizes and draws go to a stored table, a few bytes a document. Sizes are summed before
    the exchange, so a source that holds a third of all rows sends one row per task; the totals (a row per source)
    come back by a join that Spark broadcasts if they are small and otherwise splits where a source is hot.
    """
    text = F.col(text_col)
    sized = store(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        draw(F.col(id_col), text, seed).alias("draw"),
    ), "sizes")
    totals = store(cyclic_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "totals")
    targets = fill_targets(totals, share, max_rate).withColumnRenamed("source", "of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    return (sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "weight")
            .withColumn("rate", rate)
            .withColumn("copies", F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long"))
            .drop("draw"))


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_rate: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed collection: every row of ``docs`` as often as the plan says, with all its columns.

    The rate belongs to the source, so the rows themselves are joined with a row per source only.
    """
    sized = store(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    totals = store(cyclic_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "totals")
    rates = fill_targets(totals, share, max_rate).select(
        F.col("source").alias("__of"),
        F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("__rate"))
    whole = F.floor("__rate")
    copies = whole + (draw(docs[id_col], docs[text_col], seed) < F.col("__rate") - whole).cast("long")
    return (docs.join(rates, docs[source_col].eqNullSafe(F.col("__of")))
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
            .select(*[docs[c] for c in docs.columns]))
