"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.sources.sinks import store

#: Links in one file of a stored round; there is a file per core at least.
_FILE = 100_000


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Every neighbour of a node is linked to the smallest of them instead.

    With ``both`` all neighbours count and the larger ones are moved; else only the smaller ones, and the node with
    them. The minimum is built before the exchange, so a node with very many links sends one row per task.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # a is the larger end
    if both:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = pairs.where("v > u") if both else pairs
    out = moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not both:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) for the nodes of ``edges`` (columns a, b).

    Large and small stars in turn until nothing changes, a number of rounds that grows with the logarithm of the
    nodes. Each round is stored in the shared folder, which cuts the lineage; links never leave the cluster. A round
    has no more links than the one before, so it is stored in files of ``_FILE`` links, however many the shuffle
    partitions are: every file that a task opens may start a process of the executor's size for a moment. Links to
    oneself, repeated links and both directions are allowed; rows with NULL are no links.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen or not sums[0]:
            break
        seen = tuple(sums)
        files = max(now.sparkSession.sparkContext.defaultParallelism, -(-sums[0] // _FILE))
        now = store(_stars(_stars(now, True), False).coalesce(files), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
