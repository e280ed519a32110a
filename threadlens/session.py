"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes the reduce side, splits skewed join partitions (also when that costs one more
# shuffle) and turns a join to broadcast only once the measured size allows it.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "threadlens", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings above; ``conf`` adds to them or overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the shared folder of the cluster.

    The folder is that of ``spark.checkpoint.dir``, else the one given to ``SparkContext.setCheckpointDir``. Only on a
    single machine may both be missing: a local temporary folder is taken then.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    _MADE.append(f"{shared.rstrip('/')}/threadlens/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables made in this process; frames that still read them can no longer be used."""
    jvm, gone = spark._jvm, 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan out to all cores if it has fewer pieces than there are cores.

    For a step that is bound by the processor, over a table kept in a few small files. A table of ordinary
    size has more pieces than that and comes back as it is, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def partitions_for(df: DataFrame, rows: int = 20_000) -> int:
    """How many partitions of about ``rows`` rows ``df`` fills: a number that depends on the data alone.

    A model whose result depends on partitioning then repeats on any cluster.
    """
    return max(1, -(-df.count() // rows))
