"""Stage tables: save a stage once, resume from what is saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files kept of a run and the folder left out.
KEPT_SUFFIXES = ["json", "html", "txt"]
SKIPPED_FOLDERS = ["note_segments_plots"]
CLOCK_SLACK_SECONDS = 2.0


def save_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage as parquet and read it back, so that later steps start there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def pending(songs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Songs that the saved stage does not hold yet."""
    return songs.join(done.select(*keys), list(keys), "left_anti")


def is_kept_artifact(path: Column, modified: Column, since: Column | None = None) -> Column:
    """Whether a file of a run belongs to its intermediate results.

    ``path`` is relative to the run's folder, times are epoch seconds.
    """
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    folders = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    kept = suffix.isin(KEPT_SUFFIXES) & ~skipped
    if since is None:
        return kept
    return kept & (modified >= since - CLOCK_SLACK_SECONDS)


def list_artifacts(spark: SparkSession, root: str, since: float | None = None) -> DataFrame:
    """artifacts(path, modified, length) kept of a run's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    inner = F.regexp_replace("path", f"^(file:)?/*{base.lstrip('/')}/", "")
    at = F.unix_micros("modificationTime") / F.lit(1e6)
    limit = None if since is None else F.lit(float(since))
    return files.where(is_kept_artifact(inner, at, limit)).select(
        inner.alias("path"), F.col("modificationTime").alias("modified"), "length"
    )
