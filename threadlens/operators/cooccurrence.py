"""Counts of items that stand together in a document, from a (document, item) table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.skew import join_unique

#: Items of a document that meet in one row; a document with more is cut into blocks of about this size.
BLOCK = 128
#: Items are numbered inside so many groups by their hash.
_GROUPS = 1024


def _numbered(known: DataFrame) -> DataFrame:
    """item, number: an int for every item (below 2^31), the same whenever it is worked out, without bringing all items together."""
    group = F.pmod(F.hash("item"), F.lit(_GROUPS))
    inside = F.row_number().over(Window.partitionBy("group").orderBy("item")) - 1
    return known.select("item", group.alias("group")).select("item", (inside * _GROUPS + F.col("group")).alias("number"))


def cooccurrence(df: DataFrame, doc_col: str, item_col: str, min_count: int = 1, block: int = BLOCK) -> DataFrame:
    """For every two items the number of documents that have both, as (a, b, count) with a < b and count >= ``min_count``.

    Repeated rows count once; rows without document or item are left out. An item in fewer than ``min_count``
    documents cannot be in a counted pair and goes before pairs are formed. Items are numbered, and a pair is one number
    until it is counted. A document's items are dealt into blocks, and every two blocks of a document form their pairs in
    one row, so a document with most of the items is worked on by many tasks and no row holds more than two blocks. The
    pairs are counted in each task before the exchange, which is by pair: an item of all documents is spread over as many
    keys as it has partners.
    """
    rows = df.select(F.col(doc_col).alias("doc"), F.col(item_col).alias("item")).where("doc IS NOT NULL AND item IS NOT NULL").distinct()
    # An exchange that several steps read is made once; without it each would work through the source again.
    rows = rows.repartition("doc", "item")
    known = _numbered(rows.groupBy("item").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_count))
    coded = join_unique(rows, known, "item").select("doc", "number").repartition("doc", "number")
    sizes = coded.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = join_unique(coded, sizes, "doc").withColumn("own", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(F.col("own"), other).alias("low"), F.greatest(F.col("own"), other).alias("high")))
    # Two blocks send their pairs across; pairs inside a block come from the row of the block alone.
    across = F.col("tile.low") != F.col("tile.high")
    blocks = dealt.groupBy("doc", "blocks", "own").agg(F.collect_list("number").alias("numbers"))
    groups = blocks.select("doc", "numbers", "own", F.explode(met).alias("tile")).groupBy("doc", "tile").agg(
        F.flatten(F.collect_list(F.when(F.col("own") == F.col("tile.low"), F.col("numbers")))).alias("held"),
        F.flatten(F.collect_list(F.when(across & (F.col("own") == F.col("tile.high")), F.col("numbers")))).alias("others"))
    firsts = groups.select(across.alias("across"), "held", "others", F.posexplode("held").alias("at", "x"))
    partners = F.when(F.col("across"), F.col("others")).otherwise(F.slice("held", F.col("at") + 2, F.size("held")))
    # Pairs of an item follow each other, so the counts that a task is at are few and stay near the processor.
    pairs = firsts.select("x", partners.alias("partners")).sortWithinPartitions("x").select("x", F.explode("partners").alias("y"))
    pair = F.shiftleft(F.least("x", "y").cast("long"), 32).bitwiseOR(F.greatest("x", "y").cast("long"))
    counted = pairs.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    split = counted.select(F.shiftright("pair", 32).cast("int").alias("x"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("y"), "count")
    for side in ("x", "y"):
        split = join_unique(split, known.select(F.col("number").alias(side), F.col("item").alias(f"item_{side}")), side)
    return split.select(F.least("item_x", "item_y").alias("a"), F.greatest("item_x", "item_y").alias("b"), "count")
