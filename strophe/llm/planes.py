"""Token-id files: fixed-size blocks of ids as bit or byte planes, each compressed with zstandard.

A file holds, after the magic, its chunks and then an index:

    b"STIDS1"  chunk*  index  <index length: u64>  <index crc32: u32>  b"STIDS1"

A chunk is one block of BLOCK ids (the last may be shorter). The ids, as unsigned
32-bit numbers, are transposed to 4 byte planes or 32 bit planes; each plane is
compressed by itself. The index is JSON: plane kind, number of ids, and for each
chunk its offset, its ids and the compressed size of each plane; then, compressed,
the documents' ids (signed 64-bit, with a null mask) and token counts. A reader can
fetch any range of ids from the chunks that hold it.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import lean, partitions
from strophe.llm.token_ids import encoder
from strophe.session import fresh_path, stage

MAGIC = b"STIDS1"
BLOCK = 1 << 16
END_ID = 1
LEVEL = 3


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it; works in any task."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids: byte k, or bit k, of all ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in raw.T]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The ids that ``to_planes`` took apart."""
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes]) if count else np.zeros((len(planes), 0), np.uint8)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, count=count, bitorder="little")
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def _packed(values: np.ndarray) -> str:
    return base64.b64encode(zstandard.compress(values.tobytes(), LEVEL)).decode()


def _unpacked(text: str, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(base64.b64decode(text)), kind)


class Writer:
    """Writes one file; holds at most one block of ids and the counts of its documents."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK):
        self.out, self.kind, self.block = out, kind, block
        self.at = self.out.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.chunks: list[list] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self.at += self.out.write(b"".join(planes))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for start in range(0, whole, self.block):
                self._chunk(ids[start : start + self.block])
            self.held, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.concatenate(self.held))
        index = {
            "planes": self.kind,
            "ids": self.total,
            "chunks": self.chunks,
            "docs": _packed(np.array([d or 0 for d in self.docs], "<i8")),
            "null": _packed(np.array([d is None for d in self.docs], np.uint8)),
            "counts": _packed(np.array(self.counts, "<i8")),
        }
        body = json.dumps(index).encode()
        self.at += self.out.write(body + struct.pack("<QI", len(body), zlib.crc32(body)) + MAGIC)


class Reader:
    """Reads one file: its documents, and any range of its ids."""

    def __init__(self, source):
        self.source = source
        tail = len(MAGIC) + 12
        source.seek(source.size() - tail)
        size, check = struct.unpack("<QI", (end := source.read(tail))[:12])
        if end[12:] != MAGIC:
            raise ValueError("not a whole token-id file")
        source.seek(source.size() - tail - size)
        body = source.read(size)
        if zlib.crc32(body) != check:
            raise ValueError("the index of the token-id file is damaged")
        index = json.loads(body)
        self.kind, self.total, self.chunks = index["planes"], index["ids"], index["chunks"]
        null = _unpacked(index["null"], np.uint8)
        docs = _unpacked(index["docs"], "<i8").tolist()
        self.docs = [None if n else d for d, n in zip(docs, null, strict=True)]
        self.counts = _unpacked(index["counts"], "<i8")
        self.ends = np.cumsum([c[1] for c in self.chunks]) if self.chunks else np.zeros(0, np.int64)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            offset, count, sizes = self.chunks[k]
            self.source.seek(offset)
            planes = [zstandard.decompress(self.source.read(n)) for n in sizes]
            self.last = (k, from_planes(planes, count, self.kind))
        return self.last[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop."""
        parts = []
        while start < stop:
            k = int(np.searchsorted(self.ends, start, "right"))
            first = int(self.ends[k]) - self.chunks[k][1]
            parts.append(self.chunk(k)[start - first : stop - first])
            start = int(self.ends[k])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    planes: str = "byte",
    specials_as_text: bool = False,
) -> DataFrame:
    """Write the ids of whole texts in ascending doc_id order; returns the table of files.

    Columns file (their order), path, docs, ids, bytes. Each task writes one file
    under a name of its own attempt, so a repeated task never meets a half-written
    file, and only the files of attempts that ended well are in the table. Rows of
    equal ids are ordered by a checksum of the text; null ids come first; a null
    text counts as empty (the end id alone). A special token's string gives its id,
    or ordinary ids with ``specials_as_text``. Other columns are ignored.
    """
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("tie", F.crc32(F.col("text").cast("binary")))
    dealt = source.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie")
    dealt = dealt.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder.rstrip('/')}/ids-{task.partitionId():05d}-{task.taskAttemptId()}.stids"
        encode = encoder(tokenizer, specials_as_text=specials_as_text).encode_all
        store, inner = open_store(path)
        writer = None
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inner)
                    writer = Writer(out, planes)
                writer.add(doc, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            row = [[task.partitionId()], [path], [len(writer.docs)], [writer.total], [writer.at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)],
                names=["file", "path", "docs", "ids", "bytes"],
            )

    return stage(dealt.mapInArrow(lean(write, encodes=True), "file int, path string, docs long, ids long, bytes long"))


def read_ids(files: DataFrame) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 of every document, read from the files of ``write_ids``.

    start counts the ids of all documents before it.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"), "file")
    tasks = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = open_store(path)
                with store.open_input_file(inner) as source:
                    reader = Reader(source)
                    ends = np.cumsum(reader.counts)
                    for first in range(0, len(ends), 10_000):
                        at = range(first, min(first + 10_000, len(ends)))
                        crcs = [
                            zlib.crc32(reader.ids(int(ends[i] - reader.counts[i]), int(ends[i])).astype("<u4").tobytes())
                            for i in at
                        ]
                        part = slice(first, first + 10_000)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.docs[part], pa.int64()),
                                pa.array(ends[part] - reader.counts[part] + base),
                                pa.array(reader.counts[part]),
                                pa.array(crcs, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spread = placed.repartitionById(tasks, F.col("file") % tasks)
    return spread.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_folder(docs: DataFrame) -> str:
    """A new folder for id files in the shared folder."""
    return fresh_path(docs.sparkSession, "token-ids")
