"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that results or skew safety depend on; all are runtime SQL settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A window over (song, block) must be spread by both columns even where the
    # rows already lie partitioned by song alone: that is what splits a hot song.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # Before it runs, Spark takes a table for as large as its compressed files, however many
    # rows are generated from it. Beyond quite small files a side is broadcast only by its size once known.
    "spark.sql.autoBroadcastJoinThreshold": "256KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1MB",  # a hash table takes 33 MB of the driver and more
    # Folders are listed in a job of so many tasks; by default each of up to 10,000 folders is a task of its own.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}
BROADCASTS = [k for k in SETTINGS if k.endswith("autoBroadcastJoinThreshold")]
NO_BROADCASTS = "-1"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the query that made them


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a running session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def untune(spark: SparkSession) -> SparkSession:
    """Take back what ``tune`` set for broadcasts, for joins of whole texts with a few rows."""
    for key in BROADCASTS:
        if spark.conf.get(key, None) in (SETTINGS[key], NO_BROADCASTS):
            spark.conf.unset(key)
    return spark


def without_broadcasts(spark: SparkSession) -> SparkSession:
    """Broadcast nothing, for queries of many joins whose hash tables would fill the driver; until ``tune`` or ``untune``."""
    for key in BROADCASTS:
        spark.conf.set(key, NO_BROADCASTS)
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, a laptop) is a local folder made.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("strophe.scratch", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("strophe.scratch", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm, sc = spark._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, path: str | None = None, release: bool = False) -> DataFrame:
    """Write a table to the shared folder, or to ``path``, and read it back.

    Cuts the lineage where a result is used several times; later steps read only
    the columns they need, and a lost executor costs no recomputation. With ``release``
    Spark deletes the shuffle files of the write as soon as it is done, not when the
    driver next collects garbage; ``df`` itself should then not be run again.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "stage")
    held = spark.conf.get(CLEANUP, None)
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release and held is None:
            spark.conf.unset(CLEANUP)
        elif release:
            spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)
