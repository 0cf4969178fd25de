"""Fill-in-middle: texts cut at unit boundaries and put together with the middle last.

The bytes of a text lie in fixed blocks. A Fenwick tree over the blocks stores how
many units end and how many code points begin in each. The cut after the k-th unit
is found by binary lifting: the descent halves its step until the block is left in
which that unit ends, adding up the code points passed; then the boundary is sought
in this block alone. A text of any length costs one pass to count its blocks and a
logarithm and one block for a cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import lean

MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
BLOCK_BYTES = 1024


def _begins(data: np.ndarray) -> np.ndarray:
    """Whether a code point begins at each byte of an UTF-8 text."""
    return (data & 0xC0) != 0x80


def _line_ends(data: np.ndarray, last: bool) -> np.ndarray:
    ends = data == 10
    if last and len(ends):
        ends[-1] = True
    return ends


def _char_ends(data: np.ndarray, last: bool) -> np.ndarray:
    # Only called with blocks that end at the end of a code point or of the text.
    return np.append(_begins(data[1:]), True) if len(data) else np.zeros(0, bool)


UNITS = {"line": _line_ends, "char": _char_ends}


def _fenwick(counts: np.ndarray) -> list[int]:
    """Tree over counts: entry i (from 1) sums the ``i & -i`` counts up to the i-th."""
    total = np.append(0, np.cumsum(counts))
    i = np.arange(len(total))
    return (total - total[i - (i & -i)]).tolist()


class BlockTree:
    """Units and code points of one text, by blocks of ``block`` bytes."""

    def __init__(self, data: np.ndarray, unit: str = "line", block: int = BLOCK_BYTES):
        self.data, self.unit = data, unit
        starts = _begins(data)
        cuts = np.arange(0, len(data), block)
        if unit == "char" and len(cuts) > 1:  # a block begins with a code point
            for k in range(1, 4):
                cuts = np.where(starts[cuts], cuts, np.maximum(cuts - 1, 0))
            cuts = np.unique(cuts)
        self.cuts = np.append(cuts, len(data))
        if not len(data):
            self.units, self.points, self.n = [0], [0], 0
            return
        ends = UNITS[unit](data, True)
        counts = np.add.reduceat(ends.astype(np.int64), cuts)
        self.units, self.n = _fenwick(counts), int(counts.sum())
        self.points = _fenwick(np.add.reduceat(starts.astype(np.int64), cuts))

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the end of the k-th unit (from 1; 0 for the start)."""
        if not k:
            return 0, 0
        at, points, left = 0, 0, k
        step = 1 << ((len(self.units) - 1).bit_length() - 1)
        while step:
            to = at + step
            if to < len(self.units) and self.units[to] < left:
                at, left, points = to, left - self.units[to], points + self.points[to]
            step >>= 1
        low, high = int(self.cuts[at]), int(self.cuts[at + 1])
        ends = np.flatnonzero(UNITS[self.unit](self.data[low:high], high == len(self.data)))
        stop = low + int(ends[left - 1]) + 1
        return stop, points + int(np.count_nonzero(_begins(self.data[low:stop])))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits drawn from the id by SHA-256 (a null id counts as empty)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _checked(markers: Sequence[str]) -> tuple[str, str, str]:
    prefix, suffix, middle = markers
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            # Then no marker can arise where a text and a marker meet, and each is found again.
            if not a or (i != j and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))):
                raise ValueError("markers must be distinct, without one in another and without common ends and starts")
    return prefix, suffix, middle


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    markers: Sequence[str] = MARKERS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns doc_id, n (units), form, prefix_chars, middle_chars, output: one row per row of ``docs``.

    ``unit`` is "line" (with its line break) or "char". Two draws by id cut the text
    after some unit, or before the first; the middle lies between. Of 100 texts
    ``rate`` are transformed, of 100 of these ``spm_rate`` have the suffix first
    (form "spm"), the rest the prefix ("psm"). Empty texts and those that hold a
    marker stay as they are (form "plain", null counts of characters).

    A null text counts as empty; a null id is drawn for like an empty one. Rows of
    one id are cut by the same draws. Repeated rows each give their row, an empty
    table none. Other columns are ignored, whatever their names.
    """
    prefix, suffix, middle = _checked(markers)
    signs = [m.encode() for m in markers]
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")

    def one(own: int | None, body: bytes) -> tuple:
        tree = BlockTree(np.frombuffer(body, np.uint8), unit, block_bytes)
        h1, h2, h3, h4 = draws(own, seed)
        if not body or any(m in body for m in signs) or h3 % 100 >= rate:
            return tree.n, "plain", None, None, body
        low, high = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
        (a, before), (b, upto) = tree.cut(low), tree.cut(high)
        p, m, s = body[:a], body[a:b], body[b:]
        if h4 % 100 < spm_rate:
            form, parts = "spm", (signs[1], s, signs[0], p, signs[2], m)
        else:
            form, parts = "psm", (signs[0], p, signs[1], s, signs[2], m)
        return tree.n, form, before, upto - before, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1)
            made = [one(i.as_py(), b.as_py()) for i, b in zip(ids, bodies, strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), kinds[1:], strict=True)] if made else [
                pa.array([], t) for t in kinds[1:]
            ]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    body = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body")).mapInArrow(
        lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    )
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form", markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of ``fill_in_middle`` was made from (null for a null output or form)."""
    prefix, suffix, middle = _checked(markers)
    out = F.col(output)

    def between(first: str, then: str | None) -> Column:
        rest = F.split_part(out, F.lit(first), F.lit(2))
        return rest if then is None else F.split_part(rest, F.lit(then), F.lit(1))

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm)


FIM_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || cast(doc_id as varchar)) as h from documents),
u as (
  select *, case when t = '' then [] else regexp_extract_all(t, '[^\n]*\n|[^\n]+') end as u,
    cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from d),
c as (
  select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from u),
p as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid,
    coalesce(array_to_string(u[b + 1:n], ''), '') as suf
  from c)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
