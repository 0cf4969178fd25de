"""Exact percentiles without collecting a group.

Values are first counted per (keys, value), which combines before the shuffle;
the counts are then accumulated in value order by a block-wise scan, and each
wanted rank is picked where the running count passes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators.scan import run_sum, scan, total


def magnitude_block(value: Column) -> Column:
    """A never-decreasing block number: 32 blocks per doubling of the value."""
    size = F.floor(F.log2(F.abs(value) + 1) * 32)
    return F.when(value < 0, -size).otherwise(size)


def from_counts(
    counts: DataFrame, keys: Sequence[str], value: str, block: Column | None = None
) -> DataFrame:
    """Add ``cum``, the last rank of each value, and ``n``, the rows of the key, to a table (keys, value, cnt)."""
    blk = F.coalesce(magnitude_block(F.col(value)) if block is None else block, F.lit(-1 << 40))  # nulls are first
    return scan(counts, keys, [value], blk, cum=run_sum(F.col("cnt")), n=total(F.col("cnt")))


def ranked_counts(
    df: DataFrame, keys: Sequence[str], value: str, block: Column | None = None, **more: Column
) -> DataFrame:
    """(keys, value, cnt, n, cum): how often each value occurs and its last rank.

    ``more`` are further aggregates over the rows of each (keys, value); with them
    nulls have a row as well, with a count of 0.
    """
    counted = df if more else df.where(F.col(value).isNotNull())
    extra = [c.alias(n) for n, c in more.items()]
    counts = counted.groupBy(*keys, value).agg(F.count(value).alias("cnt"), *extra)
    return from_counts(counts, keys, value, block)


def _at_rank(value: str, rank: Column) -> Column:
    """The value whose run of equal ranks covers ``rank`` (1-based)."""
    return F.max(
        F.when((F.col("cum") - F.col("cnt") < rank) & (rank <= F.col("cum")), F.col(value))
    )


def linear(value: str, fraction: float) -> Column:
    """Percentile with linear interpolation, to use over ``ranked_counts``."""
    spot = (F.col("n") - 1) * F.lit(float(fraction))
    low = _at_rank(value, F.floor(spot) + 1)
    high = _at_rank(value, F.ceil(spot) + 1)
    weight = F.max(spot - F.floor(spot))
    # Written as DuckDB, numpy and Spark do: low + (high - low) * weight.
    return low + (high - low) * weight


def nearest_rank(value: str, fraction: float) -> Column:
    """Percentile as ``sorted[round((n - 1) * fraction)]``, half to even."""
    return _at_rank(value, F.rint((F.col("n") - 1) * F.lit(float(fraction))) + 1)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    block: Column | None = None,
    **wanted: Column,
) -> DataFrame:
    """One row per key with the wanted percentiles of ``value`` and the count ``n``."""
    ranked = ranked_counts(df, keys, value, block)
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), *[c.alias(name) for name, c in wanted.items()]
    )


def medians(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", block: Column | None = None
) -> DataFrame:
    """(keys, n, median) with the mean of the two middle values for even counts."""
    return quantiles(df, keys, value, block, **{name: linear(value, 0.5)})
