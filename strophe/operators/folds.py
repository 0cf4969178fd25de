"""Folds for rows that depend on the row before them.

Only for rules with no closed form. Rows are partitioned by the keys, sorted,
and streamed through a Python state of fixed size, batch by batch; a key's rows
are never held together. Callers add an island number to the keys wherever the
rule breaks a song into independent pieces, so a long song still spreads out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_count(df: DataFrame) -> int:
    """Number of tasks for Python work, which small byte sizes must not shrink to one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash the keys to the tasks of a Python step.

    Hashing a hash keeps Spark from reusing, and AQE from merging, the partitions
    of the step before, whose bytes say little about the work to come.
    """
    return df.repartition(task_count(df), F.xxhash64(*keys))


def folded(df: DataFrame, keys: Sequence[str], make_state: Callable[[], object], schema: str) -> DataFrame:
    """``ordered_fold`` for rows that lie together by their keys already, in order."""
    columns = [part.strip().split()[0] for part in schema.split(",")]
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in names)
                if key != current:
                    if state is not None:
                        out.extend(state.end())
                    current, state = key, make_state()
                out.extend(state.push(row))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if state is not None:
            tail = list(state.end())
            if tail:
                yield pd.DataFrame(tail, columns=columns)

    return df.mapInPandas(run, schema)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make_state: Callable[[], object],
    schema: str,
) -> DataFrame:
    """Stream sorted rows of each key through ``state.push(row)`` and ``state.end()``.

    Both return an iterable of output tuples; ``row`` is a named tuple.
    """
    names = list(keys)
    return folded(spread(df, names).sortWithinPartitions(*names, *order), names, make_state, schema)
