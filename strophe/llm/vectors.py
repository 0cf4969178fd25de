"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components.

Only vectors of one label are compared. Equal vectors are one representative with
a multiplicity. In each of several tables a representative's signs against random
hyperplanes name its cell. Cells are given 128 more signs of each row, not the
vector: rows of a cell whose signs differ in few places are tied, and the ties of
all tables make candidate groups. Then each vector is sent to its group alone,
where every cosine is computed in double precision; groups give link counts and
star edges, so no pair is stored. A cell or group with more than ``block_rows``
rows is cut into blocks, and every two of its blocks are compared in a task of
their own.

A pair at cosine c meets in one table with probability p = (1 - acos(c) / pi) ** bits.
At c = 0.93, 9 bits and 16 tables, 1 - (1 - p) ** 16 is 0.997; its 128 signs differ
in 15.3 places on average (deviation 3.7), and 30 are allowed. A pair above it is
found more surely still.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import lean, merge
from strophe.llm.components import components
from strophe.session import stage

BITS = 9
TABLES = 16
SKETCH = 128  # signs that a row carries into its cells
APART = 30  # of those, at most so many differ within a candidate pair
BLOCK_ROWS = 4096
TILE = 512


def _valid(vector: str) -> Column:
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda e: e != 0), F.lit(False))


def signs(x: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell number of each vector in each table (different in every table), and its sketch as two words."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits + SKETCH))
    side = x @ planes >= 0
    cells = (side[:, : tables * bits].reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(axis=2)
    sketch = np.packbits(side[:, tables * bits :], axis=1).view(np.int64)
    return (cells + (np.arange(tables) << bits)).astype(np.int32), sketch


def unit_exponent(x: np.ndarray) -> np.ndarray:
    """The vectors scaled by powers of two to a largest component near 1, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def alike(sketch: np.ndarray, i: slice, j: slice) -> np.ndarray:
    """Whether rows i and rows j are candidates by their sketches."""
    return sum(np.bitwise_count(sketch[i, None, w] ^ sketch[None, j, w]) for w in (0, 1)) <= APART


def near(x: np.ndarray, norm: np.ndarray, cosine: float, i: slice, j: slice) -> np.ndarray:
    """Whether the cosine of rows i and rows j is at least ``cosine``."""
    return (x[i] @ x[j].T) / (norm[i, None] * norm[None, j]) >= cosine


def pairs(block: np.ndarray, test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j for which ``test`` holds, tile by tile; between two blocks only, if there are two (sorted)."""
    cut = int(np.searchsorted(block, block[0], "right"))
    crossed = cut < len(block)
    for start in range(0, cut if crossed else len(block), TILE):
        rows = slice(start, min(start + TILE, cut) if crossed else start + TILE)
        first = cut if crossed else start
        i, j = np.nonzero(test(rows, slice(first, None)))
        i, j = i + start, j + first
        yield i[i < j], j[i < j]


def _dealt(rows: DataFrame, at: list[str], block_rows: int, sizes: DataFrame) -> DataFrame:
    """``rows`` with block, low and high: a group of ``sizes`` with over ``block_rows`` rows is one task per two blocks."""
    over = sizes.where(F.col("count") > block_rows)
    over = over.select(*at, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    held = rows.join(over, at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    held = held.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return held.select(
        *rows.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows equal in the first ``keys`` columns, each a table of the other columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        change = np.any([i[1:] != i[:-1] for i in ids], axis=0)
        ends = [*(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            key = tuple(c[begin].as_py() for c in batch.columns[:keys])
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(pa.RecordBatch.from_arrays(
                [c.slice(begin, end - begin) for c in batch.columns[keys:]], names=batch.schema.names[keys:]
            ))
            begin = end
    if held:
        yield pa.Table.from_batches(held)


def near_vectors(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.93,
    bits: int = BITS,
    tables: int = TABLES,
    block_rows: int = BLOCK_ROWS,
    seed: int = 7,
) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept: one row per row of ``rows``.

    Rows link when their labels are equal and not null, their vectors equally long
    and their cosine, in double precision, at least ``cosine``. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing.
    Equal vectors (of two equal 64-bit hashes) link with one another. component_id is
    the smallest id reachable (null ids never name one); kept says whether it is the
    row's own. Repeated rows count as different vectors. Other columns are ignored.
    """
    source = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).alias("label"),
        F.when(F.col(label).isNotNull() & _valid(vector), F.col(vector)).alias("vector"),
    ).withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "vector", "label")})
    reps = stage(
        source.where(F.col("vector").isNotNull())
        .groupBy("h1", "h2", "label", "vector")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        .withColumn("rid", F.monotonically_increasing_id())
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(dims) - dims
            cells, sketch = np.zeros((len(dims), tables), np.int32), np.zeros((len(dims), 2), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit_exponent(flat[begin[at, None] + np.arange(dim)])
                cells[at], sketch[at] = signs(x, bits, tables, seed)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.ascontiguousarray(sketch[:, 0])),
                    pa.array(np.ascontiguousarray(sketch[:, 1])),
                    pa.ListArray.from_arrays(np.arange(len(dims) + 1, dtype=np.int32) * tables, cells.ravel()),
                ],
                names=["rid", "side", "s0", "s1", "cells"],
            )

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            if group.num_rows < 2:
                continue
            ids, block, s0, s1 = (c.to_numpy() for c in group.columns)
            sketch, labels = np.column_stack([s0, s1]).view(np.uint64), np.arange(len(ids))
            for i, j in pairs(block, lambda i, j, s=sketch: alike(s, i, j)):
                merge(labels, i, j)
            tied = labels != np.arange(len(ids))
            if tied.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[labels[tied]])], names=["a", "b"])

    # Labels meet by hash here; the groups below are cut by the labels themselves.
    found = reps.select("rid", F.xxhash64("label", F.size("vector")).alias("side"), "vector").mapInArrow(
        lean(hashed), "rid long, side long, s0 long, s1 long, cells array<int>"
    )
    found = found.select("rid", "side", "s0", "s1", F.explode("cells").alias("cell"))
    at = ["side", "cell", "low", "high"]
    ties = stage(
        _dealt(found, at[:2], block_rows, found.groupBy(*at[:2]).count())
        .repartition(*at)
        .sortWithinPartitions(*at, "block")
        .select(*at, "rid", "block", "s0", "s1")
        .mapInArrow(lean(tie), "a long, b long")
    )
    groups = stage(components(ties).select(F.col("node").alias("rid"), F.col("root").alias("grp")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 5):
            if group.num_rows < 2:
                continue
            ids, block, n = (group.column(i).to_numpy() for i in range(3))
            flat = group.column(3).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x = unit_exponent(flat.astype(np.float64).reshape(len(ids), -1))
            norm = np.sqrt((x * x).sum(axis=1))
            links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for i, j in pairs(block, lambda i, j, x=x, norm=norm: near(x, norm, cosine, i, j)):
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                merge(labels, i, j)
            some, tied = links > 0, labels != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[some], ids[tied]])),
                    pa.array([None] * int(some.sum()) + ids[labels[tied]].tolist(), pa.int64()),
                    pa.array(np.concatenate([links[some], np.zeros(int(tied.sum()), np.int64)])),
                ],
                names=["a", "b", "links"],
            )

    members = groups.join(reps.select("rid", "label", F.size("vector").alias("dim"), "n", "vector"), "rid")
    at = ["grp", "label", "dim", "low", "high"]
    made = stage(
        _dealt(members, at[:1], block_rows, groups.groupBy("grp").count())
        .repartition(*at)
        .sortWithinPartitions(*at, "block")
        .select(*at, "rid", "block", "n", "vector")
        .mapInArrow(lean(verify), "a long, b long, links long")
    )
    links = made.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    roots = components(made.where("b is not null").select("a", "b"))
    placed = stage(
        reps.join(links, "rid", "left")
        .join(roots, F.col("rid") == F.col("node"), "left")
        .select(
            "h1", "h2", "least", F.coalesce("root", "rid").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "root").select("h1", "h2", "n_links", "component_id")
    own = source.where(F.col("vector").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = source.where(F.col("vector").isNotNull()).select("vec_id", "h1", "h2").join(named, ["h1", "h2"])
    return (
        linked.select("vec_id", "n_links", "component_id")
        .union(own)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
