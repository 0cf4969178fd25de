"""Centroid clustering of integer vectors by shallot search.

Each vector keeps its nearest centroid, its second-nearest, an upper bound of the
distance to the first and a lower bound of that to any other. When centroids move
the bounds move by as much; a vector whose upper bound stays below its lower one,
or below half the way to the nearest other centroid, keeps its cluster unread. For
the rest the search starts from the closer of the two centroids remembered and
takes that one's neighbours in the order of their distance; a neighbour can matter
only inside a ball of radius (distance to the starting point + second-best
distance), which shrinks as better ones are found. Bounds are held with a margin in
floating point; whatever survives them is compared in whole numbers, so results are
exact and ties go to the smaller number.

The rounds' sums are added up inside tasks first, so that a cluster with most of
the rows costs no more than another. What reaches the driver is k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import lean
from strophe.llm.topk import matrix, scaled, sound
from strophe.session import discard, fresh_path, stage

MARGIN = 1e-9  # far above the error of a square root or a sum of moves
NARROW = 1 << 27  # squared distances of components within this fit a long
LONG = np.iinfo(np.int64).max


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; whole numbers of any size where longs might not hold them."""
    if not len(x):
        return np.zeros(0, np.int64)
    dim = max(1, x.shape[1])
    if max(np.abs(x).max(), np.abs(c).max()) * (dim / 64) ** 0.5 > NARROW:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=1)


def root(d: np.ndarray) -> np.ndarray:
    """Square roots in floating point."""
    return np.sqrt(d.astype(np.float64))


class Shallot:
    """Centroids, how far they moved, and each one's neighbours by distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        gap = np.stack([root(squared(centroids, centroids[j][None, :])) for j in range(k)]) if k else np.zeros((0, 0))
        order = np.argsort(gap, axis=1, kind="stable")
        self.order = np.stack([row[row != j] for j, row in enumerate(order)]) if k else order
        self.gap = np.take_along_axis(gap, self.order, axis=1)
        self.half = self.gap[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else root(squared(centroids, before)) * (1 + MARGIN)
        # Farthest move of any other centroid.
        self.others = np.array([np.delete(self.moved, j).max(initial=0.0) for j in range(k)])

    def assign(
        self, x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """Nearest and second-nearest centroid of each vector and the bounds, from those before the move."""
        if len(self.c) == 1:
            return np.zeros_like(first), second, upper, lower
        first, second = first.copy(), second.copy()
        upper, lower = upper + self.moved[first], lower - self.others[first]
        open_ = np.flatnonzero(~(upper * (1 + MARGIN) < np.maximum(self.half[first], lower)))
        exact = squared(x[open_], self.c[first[open_]])
        upper[open_] = root(exact)
        still = ~(upper[open_] * (1 + MARGIN) < np.maximum(self.half[first[open_]], lower[open_]))
        open_, d1 = open_[still], exact[still]
        if len(open_):
            a, b, da, db = self._search(x[open_], first[open_], second[open_], d1)
            first[open_], second[open_] = a, b
            upper[open_], lower[open_] = root(da) * (1 + MARGIN), root(db) * (1 - MARGIN)
        return first, second, upper, lower

    def _search(self, x, a, b, da) -> tuple[np.ndarray, ...]:
        db = squared(x, self.c[b])
        swap = (db < da) | ((db == da) & (b < a))
        a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
        start, reach = a.copy(), root(da)
        live = np.arange(len(x))
        for step in range(self.order.shape[1]):
            inside = self.gap[start[live], step] <= (reach[live] + root(db[live])) * (1 + MARGIN)
            live = live[inside]  # neighbours come by distance and the ball only shrinks: who is out stays out
            if not len(live):
                break
            j = self.order[start[live], step]
            new = (j != a[live]) & (j != b[live])
            at, j = live[new], j[new]
            d = squared(x[at], self.c[j])
            best = (d < da[at]) | ((d == da[at]) & (j < a[at]))
            next_ = ~best & ((d < db[at]) | ((d == db[at]) & (j < b[at])))
            to = at[best]
            b[to], db[to], a[to], da[to] = a[to], da[to], j[best], d[best]
            to = at[next_]
            b[to], db[to] = j[next_], d[next_]
        return a, b, da, db


def cluster_vectors(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    scale: int = 64,
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
) -> DataFrame:
    """Columns vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256: one row per kept vector.

    Kept are vectors with exactly ``dims`` components, all finite numbers; components
    become floor(scale * x), held within 2**60. Centroids start as the ``k`` vectors
    with the smallest SHA-256 of "seed:id" (all of them if fewer; a null id counts as
    empty; equal ids: the smaller vector first). ``rounds`` times vectors go to the nearest
    centroid and centroids to the floor of their vectors' mean, empty ones stay; then
    vectors are assigned once more. distance is squared; it and the sums (inertia, of
    the cluster and of all) are held within a long.

    Repeated rows count as different vectors, an empty table gives none. Other columns
    are ignored, whatever their names.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    base = stage(base.where(sound(F.col("v")) & (F.size("v") == dims)).select("id", scaled(F.col("v"), scale).alias("x")))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    starts = base.select(drawn.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k vectors
    now = np.array([r.x for r in starts], np.int64).reshape(len(starts), dims)
    state = "id long, x array<long>, first int, second int, upper double, lower double"

    def assigned(table: DataFrame, model: Shallot, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(1), dims)
                if batch.num_columns > 2:
                    bounds = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]
                else:  # nothing is known yet: the search starts from the first two
                    n = len(x)
                    bounds = [np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf)]
                first, second, upper, lower = model.assign(x, *bounds)
                columns = [batch.column(0)]
                if last:
                    exact = [min(int(d), LONG) for d in squared(x, model.c[first])]
                    columns += [pa.array(first.astype(np.int32)), pa.array(exact, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])
                else:
                    columns += [batch.column(1), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))]
                    columns += [pa.array(upper), pa.array(lower)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "first", "second", "upper", "lower"])

        return table.mapInArrow(lean(run), "vec_id long, cluster int, distance long" if last else state)

    def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Halves of 32 bits add up without overflow.
            high, low = np.zeros((2, len(centroids), dims), np.int64)
            n = np.zeros(len(centroids), np.int64)
            for batch in batches:
                if batch.num_rows:
                    at, x = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
                    np.add.at(high, at, x >> 32)
                    np.add.at(low, at, x & 0xFFFFFFFF)
                    n += np.bincount(at, minlength=len(n))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(n[some]), pa.array(high[some].tolist()), pa.array(low[some].tolist())],
                    names=["cluster", "n", "high", "low"],
                )

        parts = table.select("first", "x").mapInArrow(lean(run), "cluster long, n long, high array<long>, low array<long>")
        wide = [F.sum(F.col(f"p.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
        sums = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "p"))
        new = centroids.copy()
        for r in sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), *wide).collect():  # k * dims rows
            new[r.cluster, r.at] = ((int(r.high) << 32) + int(r.low)) // int(r.n)
        return new

    model, table, path = Shallot(now), base, None
    for _ in range(rounds if len(now) else 0):
        old, path = path, fresh_path(spark, "clusters")
        table = stage(assigned(table, model, False), path)
        if old is not None:
            discard(spark, old)
        after = moved(table, now)
        model, now = Shallot(after, now), after
    final = stage(assigned(table, model, True))
    if path is not None:
        discard(spark, path)
    totals = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    whole = min(sum(int(r.d) for r in totals), LONG)
    named = [
        (
            r.cluster, min(int(r.d), LONG), whole, now[r.cluster].tolist(),
            hashlib.sha256(",".join(map(str, now[r.cluster].tolist())).encode()).hexdigest(),
        )
        for r in totals
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    return final.join(F.broadcast(spark.createDataFrame(named, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )


def clusters_sql(rounds: int = 3, k: int = 16, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in plain SQL: every distance of every round."""
    steps = [
        f"""v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as e
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (
  select cast(row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar)), e) - 1 as integer) as cluster, e as c
  from v qualify cluster < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} as (
  select vec_id, e, cluster,
    cast(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as distance
  from v, c{r}),
a{r} as (
  select vec_id, e, cluster, distance from d{r}
  qualify row_number() over (partition by vec_id order by distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} as (
  select cluster, i, sum(e[i]) as s, count(*) as n from a{r}, range(1, {dims + 1}) t(i) group by cluster, i),
m{r} as (
  select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{r} group by cluster),
c{r + 1} as (select cluster, coalesce(m.c, o.c) as c from c{r} o left join m{r} m using (cluster))""")
    return f"""with {",\n".join(steps)}
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""
