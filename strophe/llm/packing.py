"""Packing documents into fixed-length token sequences, shortest pack first.

Documents are cut into pieces of at most ``capacity`` tokens. Over the histogram of
piece lengths, longest first, each length is put to the packs with the most room
left; packs of one pattern are only counted. The patterns then say for each length
which ranks belong to which sequences, and every piece finds its place by its rank
among the pieces of its length. Only the histogram (``capacity`` numbers) and the
patterns (at most one for each length) ever reach the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm.common import lean
from strophe.llm.token_ids import MEMO_UNITS, encoder
from strophe.session import stage

CAPACITY = 2048
END_ID = 1


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packs as (how many, lengths): every length of the histogram is in as many packs as it counts.

    A step either uses up a length or moves a whole pattern to another room, so the
    patterns never outnumber the lengths.
    """
    rooms: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in rooms if r >= length), default=None)
            if room is None:
                taken, pattern, room = left, (), capacity
            else:
                packs = rooms[room][-1]
                taken, pattern = min(left, packs[0]), packs[1]
                packs[0] -= taken
                if not packs[0]:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
            rooms.setdefault(room - length, []).append([taken, (*pattern, length)])
            left -= taken
    return [(n, p) for r in sorted(rooms) for n, p in rooms[r]]


def places(packs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from there on take sequences in turn."""
    rows, sequence, rank = [], 0, Counter()
    for n, pattern in packs:
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _numbering(row: T.StructType, capacity: int) -> tuple[Callable, T.StructType]:
    """A function that adds to (length, row) the task and the rank of a length in it, and its schema."""
    schema = T.StructType(
        [
            T.StructField("length", T.IntegerType()), T.StructField("row", row),
            T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
        ]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            if len(sizes) and (sizes.min() < 0 or sizes.max() > capacity):
                raise ValueError(f"a piece is longer than {capacity} or shorter than 1")
            order = np.argsort(sizes, kind="stable")
            counts = np.bincount(sizes, minlength=capacity + 1)
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - (np.cumsum(counts) - counts)[sizes[order]]
            rank += seen[sizes]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(rank)], names=schema.names
            )

    return number, schema


def _placed(rows: DataFrame, capacity: int) -> DataFrame:
    """The rows of a written numbered table with their places."""
    counts = stage(rows.where("length > 0").groupBy("length", "part").count())
    held = counts.groupBy("length").agg(F.sum("count").alias("n")).collect()  # ``capacity`` rows at most
    where = places(patterns({r.length: r.n for r in held}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["length", "part"], "left").select(
        "row", "length", (F.col("rank") + F.col("base")).alias("rank")
    )
    keys = where[:, 0] << 48 | where[:, 1]
    out = T.StructType(
        [ranked.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            size, rank = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            if len(keys):
                at = where[np.maximum(np.searchsorted(keys, size << 48 | rank, "right") - 1, 0)]
            else:
                at = np.zeros((len(size), 4), np.int64)
            found = at[:, 2] + rank - at[:, 1], at[:, 3]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, mask=none) for x in found]], names=out.names
            )

    return ranked.mapInArrow(lean(place), out).select("row.*", "sequence_id", "offset")


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies, sequences of at most ``capacity``.

    Lengths must lie in 1..capacity; rows with a null length have no place (nulls).
    Ties are broken by the order of the rows in their partition. Input columns named
    sequence_id or offset are replaced. An empty table gives no rows.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    source = pieces.select(F.col(length).cast("int").alias("length"), row)
    number, schema = _numbering(source.schema["row"].dataType, capacity)
    return _placed(stage(source.mapInArrow(lean(number), schema)), capacity)


def _cutting(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    memo_units: int = MEMO_UNITS,
    specials_as_text: bool = False,
) -> tuple[DataFrame, Callable, T.StructType]:
    """What ``cut`` reads, its function and its schema."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [
        source.schema["doc_id"],
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType())] if with_ids else fields)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, memo_units, specials_as_text).encode_all
        for batch in batches:
            at, rows, bodies = [], [], []
            for i, body in enumerate(encode(batch.column(1).to_pylist())):
                ids = np.append(body, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity].tobytes()
                    at.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), len(ids)))
                    if with_ids:
                        bodies.append(part)
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    *[pa.array(np.ascontiguousarray(c)) for c in columns],
                    *([pa.array(bodies, pa.binary())] if with_ids else []),
                ],
                names=schema.names,
            )

    return source, pieces, schema


def cut(docs: DataFrame, tokenizer: str, *args, **options) -> DataFrame:
    """Pieces of whole texts: doc_id, start, length, ids_crc32, doc_tokens, and ids (little-endian uint32) if wanted.

    Options are those of ``_cutting``: the columns' names, ``capacity``, ``end_id``,
    ``with_ids``; ``memo_units`` weighs a worker's memory against its time, the ids are
    the same; a special token's string gives its id, or ordinary ids with
    ``specials_as_text``. A null text counts as empty and gives the end id alone. Null
    and repeated ids are kept as they are; other columns are ignored.
    """
    source, pieces, schema = _cutting(docs, tokenizer, *args, **options)
    return source.mapInArrow(lean(pieces, encodes=True), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of ``docs`` with their sequence_id and offset; they are cut and numbered in one pass, written once."""
    source, pieces, row = _cutting(docs, tokenizer, capacity=capacity, **options)
    number, schema = _numbering(row, capacity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            body = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            yield pa.RecordBatch.from_arrays([batch.column("length").cast(pa.int32()), body], names=["length", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from number(rows(batches))

    return _placed(stage(source.mapInArrow(lean(run, encodes=True), schema)), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Columns sequence_id, n_tokens, ids: one row per sequence, padded to ``capacity`` unless a power of two long.

    ``packed`` comes from ``pack_documents(..., with_ids=True)``. A sequence holds at
    most ``capacity`` pieces, so its row is bounded.
    """
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
    )
    body = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.ids))
    bare = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    pad = F.when(bare, F.lit(0)).otherwise(capacity - F.col("n_tokens"))
    filler = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), pad.cast("int")))
    return whole.select("sequence_id", "n_tokens", F.concat(body, filler).alias("ids"))
