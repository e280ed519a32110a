"""Parts shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.sources.sinks import store

#: A word: a run of characters other than the space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; none in NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.StringArray, size: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of an array of about ``size`` bytes, of one row at least."""
    upto, first = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(texts):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + size, "right")))
        yield first, last - first
        first = last


def partitions_of(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordinals(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row (from 0, without gaps) in the order of ``keys``.

    Rows are dealt out by ranges of the keys and numbered inside each range; a range starts where the counts of the
    earlier ones end. The ranges are stored, so that a task that is run again numbers the same rows. Only one count
    per range (as many as shuffle partitions) is brought together. Equal keys share a range: give keys that tell
    rows apart.
    """
    spark, n = df.sparkSession, partitions_of(df.sparkSession)
    ranged = store(df.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__rows"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    numbered = ranged.withColumn("__inside", inside)
    return (numbered.join(F.broadcast(starts), "__range")
            .withColumn(name, F.col("__first") + F.col("__inside"))
            .drop("__range", "__inside", "__first"))


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this session the package, as ``--py-files`` would; once per context."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._package_shipped = True
