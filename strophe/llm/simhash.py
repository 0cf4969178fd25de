"""Near duplicates by SimHash fingerprints in Gray-order hierarchical indexes.

Two fingerprints of 64 bits that differ in at most four bits agree in at least
two of any six blocks of bits. So each distinct fingerprint goes to fifteen cells,
one for each two blocks, and every link lies whole in some cell (for another limit
of n bits: n + 2 blocks). In a cell the
fingerprints are sorted by Gray rank, where neighbours share long patterns; groups
of neighbours become nodes that hold the bits all below them share, nodes of nodes
likewise, each holding only what its parent does not. A search adds up the
differences from the root down and leaves a whole group once they pass the limit,
or once the group is known to be in the searcher's component already.

A cell with more fingerprints than ``cell_rows`` is divided anew by two
blocks of its free bits, so that no task holds an unbounded cell, and no link is
lost. Cells give a star for each component, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import lean, merge, runs, spans
from strophe.llm.components import components
from strophe.session import discard, fresh_path, stage

FAN = 16  # fingerprints in a leaf, nodes in a node
CELL_ROWS = 1 << 16
SMALL_BITS = 16  # a cell with so few free bits has at most 2**16 fingerprints
QUERIES = 2048  # fingerprints searched at once
HEAD_ROWS = 256  # rows of a group that one task settles in a round
SALT_ROWS = 2048  # rows of a group that one task compares with those that stay


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of an UTF-8 text, repeats counted; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, parts), lambda x, n: x + n + 1))
    starts = [0, *[e + 1 for e in ends[:-words]]]
    shingles = [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, words: int = 4) -> DataFrame:
    """Columns doc_id and fp (the fingerprint as a signed long), one row per row of ``docs``."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(lean(take), "doc_id long, fp long")


def finer_masks(mask: int, limit: int) -> list[int]:
    """The masks that add two of ``limit + 2`` blocks of the free bits to ``mask`` (signed 64-bit numbers)."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [sum(1 << i for i in part.tolist()) for part in np.array_split(free, limit + 2)]
    out = [(mask & (1 << 64) - 1) | a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over distinct fingerprints sorted by Gray rank.

    Level 0 holds groups of FAN neighbours, the next level groups of FAN groups.
    A node keeps ``pattern`` and ``mask``: the bits all fingerprints below share,
    without those its parent keeps.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        every, some = fps, fps
        shared = []
        while True:
            cuts = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            shared.append((every, ~(every ^ some)))
            if len(cuts) == 1:
                break
        for k, (pattern, mask) in enumerate(shared):
            if k + 1 < len(shared):
                mask = mask & ~shared[k + 1][1][np.arange(len(mask)) // FAN]
            self.levels.append((pattern, mask))

    def link(self, limit: int) -> np.ndarray:
        """Component of each fingerprint (its smallest index) under links of at most ``limit`` bits."""
        n = len(self.fps)
        labels = np.arange(n)
        for step in range(1, FAN + 1):  # neighbours in the order first: most of a dense group joins here
            near = np.flatnonzero(np.bitwise_count(self.fps[step:] ^ self.fps[:-step]) <= limit)
            merge(labels, near, near + step)
        for start in range(0, n, QUERIES):
            self._search(np.arange(start, min(n, start + QUERIES)), labels, limit)
        return labels

    def _search(self, query: np.ndarray, labels: np.ndarray, limit: int) -> None:
        sizes = [labels.shape[0]] + [len(p) for p, _ in self.levels]
        low, high, bounds = labels, labels, []
        for pattern, _ in self.levels:
            cuts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            bounds.append((low, high))
        top = len(self.levels) - 1
        q, node, acc = query, np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        for k in range(top, -1, -1):
            pattern, mask = self.levels[k]
            acc = acc + np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node])
            low, high = bounds[k]
            mine = labels[q]
            last = (node + 1) * FAN ** (k + 1)  # only fingerprints after the searcher: each pair once
            go = (acc <= limit) & (last > q) & ~((low[node] == mine) & (high[node] == mine))
            q, node, acc = q[go], node[go], acc[go]
            fan = np.minimum(FAN, sizes[k] - node * FAN)
            run, place = spans(fan)
            q, node, acc = q[run], node[run] * FAN + place, acc[run]
        go = node > q
        q, node = q[go], node[go]
        near = np.bitwise_count(self.fps[q] ^ self.fps[node]) <= limit
        merge(labels, q[near], node[near])


def link_cells(cell: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components within each cell; ``cell`` is sorted."""
    order = np.lexsort((gray_rank(fps), cell))
    fps = fps[order]
    sizes = np.diff(np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)))
    first = np.cumsum(sizes) - sizes
    labels = np.arange(len(fps))
    small = np.repeat(sizes <= FAN, sizes)
    for step in range(1, FAN):  # a small cell is one leaf: all its fingerprints are compared
        same = (cell[step:] == cell[:-step]) & small[step:]
        near = np.flatnonzero(same & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= limit))
        merge(labels, near, near + step)
    for i in np.flatnonzero(sizes > FAN):
        part = slice(first[i], first[i] + sizes[i])
        labels[part] = GrayIndex(fps[part]).link(limit) + first[i]
    tied = labels != np.arange(len(fps))
    return fps[tied], fps[labels[tied]]


def _cell_edges(cells: DataFrame, limit: int) -> DataFrame:
    """Edges (a, b) within the cells (mask, key), each whole in one partition and bounded."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(rows: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            a, b = link_cells(np.cumsum(new), np.ascontiguousarray(rows[:, 2]).view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not len(rows):
                continue
            last = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            cut = len(rows) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield close(np.concatenate([*held, rows[:cut]]))
                held = []
            elif held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield close(np.concatenate(held))
                held = []
            held.append(rows[cut:])
        if held:
            yield close(np.concatenate(held))

    return (
        cells.repartition("mask", "key")
        .sortWithinPartitions("mask", "key")
        .select("mask", "key", "fp")
        .mapInArrow(lean(find), "a long, b long")
    )


def near_links(nodes: DataFrame, limit: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) at most ``limit`` bits apart.

    The edges of a cell are stars, so there are at most as many for a fingerprint
    as it has cells, and none for most; their components are those of all links.
    """
    spark = nodes.sparkSession
    whole = F.array(*[F.lit(m) for m in finer_masks(0, limit)])
    cells, found = nodes.select("fp", F.explode(whole).alias("mask")), None
    while True:
        cells = cells.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        over = stage(cells.groupBy("mask", "key").count().where(F.col("count") > cell_rows).drop("count"))
        full = [r.mask for r in over.select("mask").distinct().collect()]  # as many as there are masks
        free = 64 - min((bin(m & (1 << 64) - 1).count("1") for m in full), default=64)
        if not full or free <= SMALL_BITS:  # with so few free bits a cell is small by itself
            edges = _cell_edges(cells, limit)
            return edges if found is None else found.union(edges)
        edges = _cell_edges(cells.join(over, ["mask", "key"], "left_anti"), limit)
        found = edges if found is None else found.union(edges)
        rows = stage(cells.join(over, ["mask", "key"], "left_semi").select("fp", "mask").distinct())
        masks = [(m, f) for m in full for f in finer_masks(m, limit)]
        table = spark.createDataFrame(masks, "mask long, finer long").coalesce(1)
        # The broadcast table has a row for each two blocks of each overfull mask.
        cells = rows.join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask"))


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 4,
    limit: int = 4,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links. Null and empty texts
    have the fingerprint 0 and are linked like any other. Rows with a null id have
    a component but do not name one (null if no row of it has an id). Repeated
    rows each give their row; an empty table gives none. Other columns are ignored.
    """
    fps = stage(fingerprints(docs, doc_id, text, words))
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes, limit, cell_rows))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = stage(placed)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def resemblance(a: bytes, b: bytes, words: int) -> float:
    """Jaccard similarity of the sets of word shingles of two texts (1 if neither has a word)."""
    sets = []
    for text in (a, b):
        parts = text.lower().split()
        sets.append({tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text; they stand for the shingles in comparisons."""
    parts = text.lower().split()
    found = {xxhash.xxh64_intdigest(b" ".join(parts[i : i + words])) for i in range(max(1, len(parts) - words + 1))}
    return np.array(sorted(found), np.uint64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    limit: int = 6,
    similarity: float = 0.8,
    cell_rows: int = CELL_ROWS,
    head_rows: int = HEAD_ROWS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, less near copies of a row that stays.

    Groups are those of ``near_groups``; pairs farther apart than ``limit`` bits that no
    chain of fingerprints joins are never compared, however alike. Along the ids of a group
    (null ids last, then as read) a row stays unless its word shingles resemble those
    of a row that stays before it by ``similarity`` or more: no two rows of a group that
    stay are alike, and a chance meeting of fingerprints or a long chain of small
    changes drops nothing unlike what stays.

    Done in rounds: one task settles the first ``head_rows`` rows of a group among
    themselves, and tasks of about ``salt_rows`` others each compare theirs with those
    that stay; what is left goes to the next round. Only hashes of shingles are moved,
    and those of groups of two rows or more alone. Null and empty texts are alike.
    """
    spark = docs.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = stage(docs.select(own.alias("row"), F.monotonically_increasing_id().alias("place")))
    body = F.coalesce(F.col("row").getField(text).cast("binary"), F.lit(b"")).alias("body")
    groups = near_groups(base.select("place", body), "place", "body", words, limit, cell_rows)
    placed = stage(groups.select(F.col("doc_id").alias("place"), "component_id"))
    shared = placed.groupBy("component_id").count().where("count > 1").select("component_id")
    id_ = F.col("row").getField(doc_id).cast("long")
    members = base.join(placed.join(shared, "component_id"), "place").select(
        "component_id", id_.isNull().alias("void"), F.coalesce(id_, F.lit(0)).alias("id"), "place", body
    )
    columns = "component_id long, void boolean, id long, place long, marks binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(marks, pa.binary())], names=["component_id", "void", "id", "place", "marks"]
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for whole in batches:
            for (component,), batch in runs(whole, 1):
                if component != now:
                    now, heads = component, []
                stays = []
                for marks in batch.column(2):
                    own = np.frombuffer(marks.as_py(), np.uint64)
                    stays.append(not any(alike(own, h, similarity) for h in heads))
                    if stays[-1]:
                        heads.append(own)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(stays)], names=["component_id", "place", "marks", "stays"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for whole in batches:
            for (component, salt, kind), batch in runs(whole, 3):
                if (component, salt) != now:
                    now, heads = (component, salt), []
                sets = [np.frombuffer(m.as_py(), np.uint64) for m in batch.column(6)]
                if kind == 0:
                    heads.extend(sets)
                    continue
                near = [any(alike(s, h, similarity) for h in heads) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *batch.columns[3:7], pa.array(near)],
                    names=["component_id", "void", "id", "place", "marks", "near"],
                )

    path, gone = fresh_path(spark, "stage"), fresh_path(spark, "gone")
    left = stage(members.mapInArrow(lean(mark), columns), path)
    nth = F.row_number().over(Window.partitionBy("component_id").orderBy("void", "id", "place"))
    while True:
        # The row numbers are limited before the exchange too: at most ``head_rows`` of a group from each task.
        first = left.withColumn("nth", nth).where(F.col("nth") <= head_rows)
        settled = stage(
            first.repartition("component_id")
            .sortWithinPartitions("component_id", "nth")
            .select("component_id", "place", "marks")
            .mapInArrow(lean(settle), "component_id long, place long, marks binary, stays boolean")
        )
        settled.where("not stays").select("place").write.mode("append").parquet(gone)
        sizes = left.groupBy("component_id").count().where(F.col("count") > head_rows)
        over = stage(sizes.select("component_id", F.ceil(F.col("count") / salt_rows).cast("int").alias("salts")))
        if over.isEmpty():
            break
        rest = left.join(over, "component_id").join(settled.select("place"), "place", "left_anti")
        rest = rest.withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts")).cast("int"))
        heads = settled.where("stays").join(over, "component_id")
        heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        order = ["component_id", "salt", "kind", "void", "id", "place", "marks"]
        both = rest.withColumn("kind", F.lit(1)).select(*order).union(
            heads.select("component_id", "salt", F.lit(0), F.lit(False), F.lit(0).cast("long"), "place", "marks")
        )
        old, path = path, fresh_path(spark, "stage")
        tried = stage(
            both.repartition("component_id", "salt")
            .sortWithinPartitions("component_id", "salt", "kind")
            .mapInArrow(lean(compare), f"{columns}, near boolean"),
            path,
        )
        discard(spark, old)
        tried.where("near").select("place").write.mode("append").parquet(gone)
        left = tried.where("not near").drop("near")
    discard(spark, path)
    return base.join(spark.read.schema("place long").parquet(gone), "place", "left_anti").select("row.*")
