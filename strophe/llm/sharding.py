"""Shards of near-equal bytes: a minimax contiguous partition of atomic groups.

Groups of equal texts are atomic and stand in the order of their hash. The
smallest capacity for which a greedy cut needs no more than the wanted shards is
found by binary search. The groups stay on the cluster: the driver searches over
sums of key ranges, learns bounds of the capacity from them, and asks for finer
sums only of the ranges in which a cut may fall, until the bounds meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.session import stage

KEY_BITS = 63
FIRST_BITS = 12  # the first sums: 2**12 ranges
MORE_BITS = 6  # each range asked for again gives 2**6


class Ranges:
    """Sums over consecutive key ranges, and greedy cuts at their bounds."""

    def __init__(self, start: np.ndarray, bits: np.ndarray, weight: np.ndarray, count: np.ndarray):
        self.start, self.bits, self.weight, self.count = start, bits, weight, count
        self.end = np.cumsum(weight)
        self.total = int(self.end[-1]) if len(weight) else 0

    @property
    def single(self) -> np.ndarray:
        return (self.count <= 1) | (self.bits >= KEY_BITS)

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy positions; inside a range of several groups cut at its start, or ``hopeful`` wherever wanted."""
        out, at = [], 0
        for _ in range(shards):
            want = at + capacity
            i = int(np.searchsorted(self.end, want, "right"))
            at = self.total if i == len(self.end) else int(self.end[i] - self.weight[i])
            if i < len(self.end) and hopeful and not self.single[i]:
                at = want
            out.append(at)
        return out

    def smallest(self, shards: int, hopeful: bool) -> int:
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int, key: str = "key", weight: str = "weight") -> tuple[list[int], int]:
    """Keys at which shards 1, 2, ... begin, and the smallest feasible capacity.

    ``groups`` has one row per key (0 <= key < 2**63) with a positive weight. The
    driver holds a few ten thousand sums at most, whatever the number of groups.
    """
    spark = groups.sparkSession

    def sums(rows: DataFrame, bits: int) -> np.ndarray:
        at = F.shiftright(F.col(key), KEY_BITS - bits)
        got = rows.groupBy(at.alias("at")).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).collect()
        return np.array(sorted((r.at << (KEY_BITS - bits), bits, r.w, r.n) for r in got), np.int64).reshape(-1, 4)

    table = sums(groups, FIRST_BITS)
    while True:
        ranges = Ranges(*table.T)
        low, high = ranges.smallest(shards, True), ranges.smallest(shards, False)
        if low == high:
            at = ranges.cuts(high, shards, False)[:-1]
            index = np.searchsorted(ranges.end - ranges.weight, at)
            ends = [int(ranges.start[i]) if i < len(table) else 1 << KEY_BITS for i in index]
            return ends, high
        touched = np.zeros(len(table), bool)
        for a, b in zip(ranges.cuts(low, shards, False), ranges.cuts(high, shards, True), strict=True):
            touched[np.searchsorted(ranges.end, a, "right") : np.searchsorted(ranges.end, b, "right") + 1] = True
        touched &= ~ranges.single
        parts = [table[~touched]]
        for bits in np.unique(table[touched, 1]).tolist():
            wanted = [(int(s) >> (KEY_BITS - bits),) for s in table[touched & (table[:, 1] == bits), 0]]
            asked = spark.createDataFrame(wanted, "part long").coalesce(1)
            part = F.shiftright(F.col(key), KEY_BITS - bits)
            rows = groups.withColumn("part", part).join(F.broadcast(asked), "part", "left_semi")  # ranges near a cut
            parts.append(sums(rows, min(KEY_BITS, bits + MORE_BITS)))
        table = np.concatenate(parts)
        table = table[np.argsort(table[:, 0], kind="stable")]


def _shard(key: Column, ends: list[int]) -> Column:
    top = (1 << KEY_BITS) - 1
    return sum([(key >= F.lit(e)).cast("int") for e in ends if e <= top], F.lit(0))


def shard_by_bytes(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    size is the text's UTF-8 bytes plus 1 (null: 1, as empty). Rows of equal texts
    share a shard; the largest shard is as small as a contiguous cut of the groups
    in hash order allows. slot counts the rows of a shard from 0 without gaps.
    Null or repeated ids are kept as they are; shards may be empty if there are
    fewer groups than shards; an empty table gives no rows. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 1).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("weight")))
    ends, _ = minimax_cuts(groups, shards)
    placed = rows.withColumn("shard", _shard(F.col("key"), ends)).withColumn("part", F.shiftright("row", 33))
    # A row's slot: the rows of its shard in earlier input partitions, then those before it in its own.
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("row")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(base, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
