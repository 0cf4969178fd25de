"""Exact top-k search with vector-approximation files.

Vectors are scaled and cut to integers; equal vectors are one representative with
its smallest ids. The approximation of a representative is a cell: each component
is known to lie in one of ``2 ** bits`` equal ranges between the vector's own least
and largest component, one byte each. The inner product of a query with anything
in a cell has an upper bound (the distance's lower bound) and a lower one. Blocks
of queries scan all cells: a representative survives unless enough others are
certainly better. Survivors of all blocks are held against the common limit, and
then each query reads the exact vectors of the rest in the order of their bounds
until its last result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import lean, partitions, runs
from strophe.session import stage

BITS = 8  # the whole byte
QUERY_ROWS = 1024  # queries that a scanning task holds, about
BLOCK_ROWS = 1 << 18  # representatives that it reads, about; they pass through and are not held
TILE = 256
HELD = 200_000  # survivors that a scanning task holds before it hands them on
STEP = 64  # exact vectors compared at once
WIDEST = float(2**60)
EXACT = float(2**52)
LONG = np.iinfo(np.int64)


def scaled(vector: Column, scale: int) -> Column:
    """Components as whole numbers: floor(scale * x), held within 2**60 either way."""
    return F.transform(
        vector,
        lambda e: F.floor(F.greatest(F.least(e.cast("double") * F.lit(float(scale)), F.lit(WIDEST)), F.lit(-WIDEST))),
    )


def sound(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Equally long lists of an Arrow column as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cells_of(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least component, width of a range, and number of each component's range."""
    low = x.min(axis=1)
    width = -((low - x.max(axis=1) - 1) // (1 << bits))
    return low, width, ((x - low[:, None]) // width[:, None]).astype(np.uint8)


class Scan:
    """A block of queries against a stream of cells."""

    def __init__(self, dim: int, wanted: int):
        self.dim, self.wanted = dim, wanted
        self.rids: list[np.ndarray] = []
        self.asked: list[np.ndarray] = []
        self.q: np.ndarray | None = None
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def ask(self, rid: np.ndarray, x: np.ndarray) -> None:
        """Add queries; all come before the first cell."""
        self.rids.append(rid)
        self.asked.append(x)

    def offer(self, rid: np.ndarray, low: np.ndarray, width: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Scan some cells; gives survivors only where too many are held."""
        if not self.asked:
            return
        if self.q is None:
            self.rid, self.q = np.concatenate(self.rids), np.concatenate(self.asked).astype(np.float64)
            self.up, self.down = np.maximum(self.q, 0).sum(axis=1), np.minimum(self.q, 0).sum(axis=1)
            self.best = np.full((len(self.q), self.wanted), -np.inf)
        corner = low[:, None] + cell * width[:, None].astype(np.float64)
        gap = (width - 1).astype(np.float64)
        most = float(np.abs(self.q).max()) * (float(np.abs(corner).max()) + float(gap.max())) * self.dim
        slack = 0.0 if most < EXACT else most * 2.0**-40
        for start in range(0, len(self.q), TILE):
            tile = slice(start, start + TILE)
            at = self.q[tile] @ corner.T
            lower = np.clip(at + np.outer(self.down[tile], gap) - slack, LONG.min, LONG.max)
            upper = np.clip(at + np.outer(self.up[tile], gap) + slack, LONG.min, LONG.max)
            both = np.concatenate([self.best[tile], lower], axis=1)
            self.best[tile] = np.partition(both, -self.wanted, axis=1)[:, -self.wanted :]
            i, j = np.nonzero(upper >= self.best[tile].min(axis=1)[:, None])
            self.held.append((i + start, rid[j], upper[i, j], lower[i, j]))
            self.count += len(i)
        if self.count > HELD:
            self._prune()
            if self.count > HELD // 2:
                yield from self.end()

    def _prune(self) -> None:
        i, rid, upper, lower = (np.concatenate(c) for c in zip(*self.held, strict=True))
        keep = upper >= self.best.min(axis=1)[i]
        self.held, self.count = [(i[keep], rid[keep], upper[keep], lower[keep])], int(keep.sum())

    def end(self) -> Iterator[pa.RecordBatch]:
        """The survivors held."""
        if self.held:
            self._prune()
            i, rid, upper, lower = self.held[0]
            self.held, self.count = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.rid[i]), pa.array(rid), pa.array(upper), pa.array(lower)], names=["q", "rid", "upper", "lower"]
            )


def products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products, held within a long."""
    if not len(x):
        return []
    if float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < 2.0**62:
        return (x @ q).tolist()
    exact = x.astype(object) @ q.astype(object)
    return [min(max(int(s), LONG.min), LONG.max) for s in exact]


class Reader:
    """One query that reads exact vectors in the order of their bounds."""

    def __init__(self, q: int, wanted: int):
        self.q, self.wanted, self.vector, self.best, self.sure = q, wanted, None, [], False

    def read(self, upper: np.ndarray, ids: list[list[int]], x: np.ndarray) -> None:
        """Compare further vectors, unless the results are certain already."""
        for start in range(0, len(upper), STEP):
            full = len(self.best) == self.wanted
            self.sure = self.sure or (full and upper[start] < -self.best[-1][0])
            if self.sure:
                return
            part = slice(start, start + STEP)
            found = products(x[part], self.vector)
            rows = [(-score, i) for score, own in zip(found, ids[part], strict=True) for i in own]
            self.best = sorted(self.best + rows)[: self.wanted]

    def row(self) -> dict:
        """The best rows found, and the query's product with itself."""
        own = products(self.vector[None, :], self.vector)[0]
        return {"q": self.q, "own": own, "found": [{"score": -s, "vec_id": i} for s, i in self.best]}


def top_k(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    scale: int = 256,
    every: int = 50,
    bits: int = BITS,
    query_rows: int = QUERY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: the ``k`` best rows for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows
    but the query's own. The score is the inner product of the scaled components;
    ties go to the smaller id. A query with fewer candidates has them all.

    Rows with a null id, and vectors that are null, empty or hold null or non-finite
    components, take no part; vectors of different lengths are not compared. Scaled
    components are held within 2**60 and scores within a long. Of repeated rows each
    is a row of its own: a query, and a candidate of the others. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    spark, wanted = rows.sparkSession, k + 1  # a query finds itself as well
    base = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(
        F.col("id").isNotNull() & sound(F.col("v"))
    )
    base = base.select("id", scaled(F.col("v"), scale).alias("x"))
    # The row numbers are limited before the exchange too, so many equal vectors are few rows there.
    nth = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    reps = stage(
        base.withColumn("nth", nth)
        .where(F.col("nth") <= wanted)
        .groupBy("x")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("x", "ids", F.size("x").alias("dim"), F.monotonically_increasing_id().alias("rid"))
    )
    asking = stage(base.where(F.col("id") % every == 0).join(reps.select("x", "rid"), "x").select("id", "rid"))
    asked = asking.select("rid").distinct().join(reps, "rid").select("rid", "dim", "x")
    total, queries = reps.count(), asking.select("rid").distinct().count()
    blocks = max(-(-total // block_rows), min(partitions(spark), -(-total // 256)), 1)
    groups = max(-(-queries // query_rows), 1)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for (dim,), batch in runs(whole, 1):
                x = matrix(batch.column(2), dim)
                low, width, cell = cells_of(x, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(low), pa.array(width), pa.array([c.tobytes() for c in cell])],
                    names=["dim", "rid", "low", "width", "body"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, work = None, None
        for whole in batches:
            for (dim, group, block, kind), batch in runs(whole, 4):
                if (dim, group, block) != now:
                    if work is not None:
                        yield from work.end()
                    now, work = (dim, group, block), Scan(dim, wanted)
                rid, low, width = (batch.column(i).to_numpy() for i in (4, 5, 6))
                body = b"".join(batch.column(7).to_pylist())
                if kind == 0:
                    work.ask(rid, np.frombuffer(body, np.int64).reshape(-1, dim))
                else:
                    yield from work.offer(rid, low, width, np.frombuffer(body, np.uint8).reshape(-1, dim))
        if work is not None:
            yield from work.end()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for (dim,), batch in runs(whole, 1):
                bodies = [r.astype(np.int64).tobytes() for r in matrix(batch.column(2), dim)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies)], names=["dim", "rid", "body"])

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = reps.select("dim", "rid", "x").mapInArrow(lean(approximate), "dim int, rid long, low long, width long, body binary")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("grp", every_group)
    cells = cells.select("dim", "grp", "block", F.lit(1).alias("kind"), "rid", "low", "width", "body")
    asks = asked.select("dim", "rid", "x").mapInArrow(lean(packed), "dim int, rid long, body binary")
    asks = asks.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")).withColumn("block", every_block)
    zero = F.lit(0).cast("long")
    asks = asks.select("dim", "grp", "block", F.lit(0).alias("kind"), "rid", zero.alias("low"), zero.alias("width"), "body")
    survivors = stage(
        cells.union(asks)
        .repartition("dim", "grp", "block")
        .sortWithinPartitions("dim", "grp", "block", "kind")
        .mapInArrow(lean(search), "q long, rid long, upper double, lower double")
    )
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))
    limit = survivors.withColumn("nth", nth).where(F.col("nth") == wanted).select("q", F.col("lower").alias("least"))
    near = survivors.join(limit, "q", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Reader | None = None
        kind = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
        schema = pa.schema([("q", pa.int64()), ("own", pa.int64()), ("found", kind)])
        for whole in batches:
            done = []
            for (q, dim), batch in runs(whole, 2):
                if now is None or now.q != q:
                    if now is not None:
                        done.append(now.row())
                    now = Reader(q, wanted)
                x = matrix(batch.column(4), dim)
                if now.vector is None:
                    now.vector, x, batch = x[0], x[1:], batch.slice(1)
                now.read(batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist(), x)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    best = near.select("q", "rid", "upper").join(reps.select("rid", "dim", "ids", "x"), "rid")
    first = asked.select(F.col("rid").alias("q"), "dim", F.lit(None).cast("double").alias("upper"), F.lit(None).cast("array<long>").alias("ids"), "x")
    found = stage(
        best.select("q", "dim", "upper", "ids", "x")
        .union(first)
        .repartition("q")
        .sortWithinPartitions("q", F.col("upper").desc_nulls_first())
        .mapInArrow(lean(certain), "q long, own long, found array<struct<score: long, vec_id: long>>")
    )
    mine = F.transform("found", lambda e: (e["vec_id"] == F.col("id")) & (e["score"] == F.col("own")))
    held = asking.join(found, asking.rid == found.q).withColumn("at", F.array_position(mine, F.lit(True)) - 1)
    others = F.slice(F.filter("found", lambda e, i: i.cast("long") != F.col("at")), 1, k)
    return held.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "e")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"
    )


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
