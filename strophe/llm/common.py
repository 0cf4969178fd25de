"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strophe.llm import token_ids

# Bytes and rows in one Arrow batch handed to Python: bound a worker's memory whatever the length of the texts.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that bound the memory of Python workers and keep results alike in every session."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def lean(fn: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives back what earlier tasks and its own left in the worker's memory."""

    def run(batches: Iterator) -> Iterator:
        if not encodes:
            token_ids.release()
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of ``u[i]`` and ``v[i]`` in place.

    ``labels[i]`` is the smallest index of the set of ``i``, before and after.
    """
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given sizes: the run of each element and its place in it."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return run, place


def runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Neighbouring rows that are equal in the first ``keys`` columns (whole numbers), with those values."""
    if not batch.num_rows:
        return
    ids = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]])
    ends = [*(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
    begin = 0
    for end in ends:
        yield tuple(ids[begin].tolist()), batch.slice(begin, end - begin)
        begin = end
