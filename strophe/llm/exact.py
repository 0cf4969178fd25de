"""Exact duplicates by an extendible-hash index.

The tasks that read the texts combine equal texts of a batch at once, so that a
text which is a third of the corpus reaches the index only once per batch. Each
remaining entry has a 64-bit key. A directory over the leading key bits doubles
until no bucket is overfull; owners get ranges of buckets with about equal bytes,
chain the entries of one key and compare their bytes.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm.common import lean, partitions
from strophe.session import stage

# The directory never has more than 2**MAX_DEPTH slots, which bounds what the driver and a broadcast hold.
MAX_DEPTH = 16
BUCKET_BYTES = 4 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ascii_lower(text: bytes) -> bytes:
    """The text with A-Z lower-cased and nothing else changed."""
    return text.translate(_LOWER)


def _rank(i: int | None) -> tuple:
    return (i is None, 0 if i is None else -i)


def entries(docs: DataFrame, doc_id: str, text: str, normalise: Callable[[bytes], bytes], rows: bool) -> DataFrame:
    """One entry for each text of a batch: its key, and its body and members or (``rows``) the row that wins.

    The member or row with the largest id comes first; null ids come last.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    source = docs.select(F.col(doc_id).cast("long").alias("id"), row if rows else body)
    place = docs.columns.index(text)
    kept = (
        [source.schema["row"]]
        if rows
        else [T.StructField("body", T.BinaryType()), T.StructField("members", T.ArrayType(T.LongType()))]
    )
    schema = T.StructType(
        [
            T.StructField("rep", T.LongType()),
            T.StructField("key", T.LongType()),
            T.StructField("top", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("digest", T.StringType()),
            *kept,
        ]
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            groups: dict[bytes, list[int]] = {}
            bodies = ((t.as_py() or "").encode() for t in batch.column(1).field(place)) if rows else batch.column(1).to_pylist()
            for i, body in enumerate(bodies):
                groups.setdefault(normalise(body), []).append(i)
            digests = [hashlib.sha256(body) for body in groups]
            order = [sorted(g, key=lambda p: _rank(ids[p])) for g in groups.values()]
            members = [[ids[p] for p in g] for g in order]
            last = (
                [batch.column(1).take(pa.array([g[0] for g in order], pa.int64()))]
                if rows
                else [pa.array(list(groups), pa.binary()), pa.array(members, pa.list_(pa.int64()))]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(rep, rep + len(order)), pa.int64()),
                    pa.array([int.from_bytes(d.digest()[:8], "big", signed=True) for d in digests], pa.int64()),
                    pa.array([m[0] for m in members], pa.int64()),
                    pa.array([len(m) for m in members], pa.int64()),
                    pa.array([d.hexdigest() for d in digests], pa.string()),
                    *last,
                ],
                names=schema.names,
            )
            rep += len(order)

    return source.mapInArrow(lean(combine), schema)


def directory_depths(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Local depth of each directory slot.

    ``sizes[i]`` is what the keys with the leading bits ``i`` hold, at the deepest
    directory allowed. Buckets over the capacity split; the directory doubles when
    a bucket that splits is as deep as the directory itself.
    """
    deepest = int(math.log2(len(sizes)))
    at = [sizes.reshape(1 << d, -1).sum(axis=1) for d in range(deepest + 1)]
    depth, whole = np.zeros(1, int), 0
    while True:
        slot = np.arange(1 << whole)
        held = np.array([at[d][s >> (whole - d)] for d, s in zip(depth, slot, strict=True)])
        over = (held > capacity) & (depth < deepest)
        if not over.any():
            return depth
        if (depth[over] == whole).any():
            depth, over, whole = np.repeat(depth, 2), np.repeat(over, 2), whole + 1
        depth[over] += 1


def directory(found: DataFrame, body: Column, owners: int, capacity: int) -> tuple[DataFrame, int]:
    """The directory as a table (slot, depth, owner) with at most 2**MAX_DEPTH rows, and its depth."""
    spark = found.sparkSession
    slot = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    held = found.groupBy(slot.alias("slot")).agg(F.sum(F.octet_length(body) + 64).alias("bytes")).toPandas()
    sizes = np.zeros(1 << MAX_DEPTH, np.int64)
    sizes[held["slot"].to_numpy(np.int64)] = held["bytes"].to_numpy(np.int64)
    depth = directory_depths(sizes, capacity)
    whole = int(math.log2(len(depth)))
    held = sizes.reshape(1 << whole, -1).sum(axis=1)
    first = np.arange(len(depth)) >> (whole - depth) << (whole - depth)  # slots of one bucket go to one owner
    middle = (np.cumsum(held) - held)[first]
    owner = np.minimum(middle * owners // max(int(held.sum()), 1), owners - 1)
    rows = list(zip(range(len(depth)), depth.tolist(), owner.tolist(), strict=True))
    return spark.createDataFrame(rows, "slot int, depth int, owner int").coalesce(1), whole


def owned(found: DataFrame, capacity: int, body: Column | None = None) -> DataFrame:
    """The entries dealt to their owners, each owner's in the order of keys, the winning entry first."""
    owners = partitions(found.sparkSession)
    slots, whole = directory(found, F.col("body") if body is None else body, owners, capacity)
    slot = F.shiftrightunsigned("key", 64 - whole).cast("int") if whole else F.lit(0)
    return (
        found.withColumn("slot", slot)
        .join(F.broadcast(slots), "slot")  # 2**MAX_DEPTH rows at most
        .repartitionById(owners, F.col("owner"))
        .sortWithinPartitions("key", F.desc_nulls_last("top"), "rep")
    )


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[bytes], bytes] = ascii_lower,
    capacity: int = BUCKET_BYTES,
) -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Equal texts (after ``normalise``) form a group; its row with the largest id is
    kept. A null text counts as empty. A null id ranks below every other, and one
    row of a group of only null ids is kept, with a null keep_id. Of rows that
    repeat the largest id exactly one is kept. Other columns are not looked at.
    """
    found = stage(entries(docs, doc_id, text, normalise, rows=False))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "winner", "keep_id", "group_size"]
        done: list[array | list] = [array("q"), array("q"), [], array("q")]
        chains: list[list] = []  # of one key: body, winning entry, its id, size, entries

        def close() -> None:
            for _, winner, keep, size, reps in chains:
                done[0].extend(reps)
                done[1].extend([winner] * len(reps))
                done[2].extend([keep] * len(reps))
                done[3].extend([size] * len(reps))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], names=names)
            done[:] = [array("q"), array("q"), [], array("q")]
            return made

        now = None
        for batch in batches:
            for key, top, rep, n, body in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if key != now:
                    close()
                    chains, now = [], key
                for c in chains:
                    if c[0] == body:
                        c[3] += n
                        c[4].append(rep)
                        break
                else:
                    chains.append([body, rep, top, n, array("q", [rep])])
            yield out()
        close()
        yield out()

    dealt = owned(found.drop("members", "digest"), capacity).select("key", "top", "rep", "n", "body")
    heads = dealt.mapInArrow(lean(chain), "rep long, winner long, keep_id long, group_size long")
    rows = found.select("rep", "members", "digest").join(heads, "rep")
    return rows.select("*", F.posexplode("members").alias("place", "doc_id")).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("place") == 0) & (F.col("rep") == F.col("winner"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[bytes], bytes] = ascii_lower,
    capacity: int = BUCKET_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns as they are."""
    found = stage(entries(docs, doc_id, text, normalise, rows=True))
    place = docs.columns.index(text)
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    dealt = owned(found.drop("digest"), capacity, body).select("key", "row")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()
        for batch in batches:
            mask = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).field(place), strict=True):
                if key != now:
                    now, seen = key, set()
                body = normalise((t.as_py() or "").encode())
                mask.append(body not in seen)
                seen.add(body)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(mask, pa.bool_()))], names=["row"])

    return dealt.mapInArrow(lean(heads), T.StructType([found.schema["row"]])).select("row.*")
