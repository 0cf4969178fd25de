"""Ordered operators that survive a hot key.

A plain ``Window.partitionBy(song)`` puts a whole song into one task. The
functions here split each song into blocks of neighbouring rows:

* ``scan``: running values. Each block is scanned on its own, one summary row
  per block is carried forward over the blocks of the song, and the carried
  value is joined back. Rows are shuffled once, by (keys, block); the summaries
  come from that same exchange, so the input is read once.
* ``halo``: bounded frames (lag, lead, rolling). Needs a dense ordinal; the few
  rows near a block edge are copied into the neighbour block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 4096

_LO, _HI = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Step:
    """One running value: how it scans a block, sums it up and carries on."""

    kind: str
    expr: Column
    unwrap: bool = False


def run_sum(expr: Column) -> Step:
    """Sum of ``expr`` up to and including this row."""
    return Step("sum", F.coalesce(expr, F.lit(0)))


def total(expr: Column) -> Step:
    """Sum of ``expr`` over all rows of the keys."""
    return Step("total", F.coalesce(expr, F.lit(0)))


def run_count(cond: Column) -> Step:
    """Number of rows so far for which ``cond`` holds."""
    return Step("sum", F.when(cond, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))


def position() -> Step:
    """Row number within the keys, from 1."""
    return Step("sum", F.lit(1).cast("long"))


def run_max(expr: Column) -> Step:
    """Largest ``expr`` so far, this row included."""
    return Step("max", expr)


def max_before(expr: Column) -> Step:
    """Largest ``expr`` of the rows strictly before this one."""
    return Step("max_before", expr)


def last_seen(expr: Column) -> Step:
    """Latest non-null ``expr``, this row included."""
    return Step("last", expr)


def prev_seen(expr: Column) -> Step:
    """Latest non-null ``expr`` strictly before this row."""
    return Step("prev", expr)


def next_seen(expr: Column) -> Step:
    """Nearest non-null ``expr`` strictly after this row."""
    return Step("next", expr)


def lag(expr: Column) -> Step:
    """``expr`` of the previous row, null or not."""
    return Step("prev", F.struct(expr.alias("v")), unwrap=True)


def lead(expr: Column) -> Step:
    """``expr`` of the next row, null or not."""
    return Step("next", F.struct(expr.alias("v")), unwrap=True)


def _local(step: Step, w: Window, back: Window) -> Column:
    """The value within a block; ``back`` runs from its end.

    A frame that ends with the block is read anew for every row, so a value from
    the rows after is taken from the rows before in the opposite order.
    """
    if step.kind == "sum":
        return F.sum(step.expr).over(w.rowsBetween(_LO, 0))
    if step.kind == "total":
        return F.lit(0)
    if step.kind == "max":
        return F.max(step.expr).over(w.rowsBetween(_LO, 0))
    if step.kind == "max_before":
        return F.max(step.expr).over(w.rowsBetween(_LO, -1))
    if step.kind == "last":
        return F.last(step.expr, ignorenulls=True).over(w.rowsBetween(_LO, 0))
    if step.kind == "prev":
        return F.last(step.expr, ignorenulls=True).over(w.rowsBetween(_LO, -1))
    return F.last(step.expr, ignorenulls=True).over(back.rowsBetween(_LO, -1))


def _summary(step: Step, order: Sequence[str]) -> Column:
    if step.kind in ("sum", "total"):
        return F.sum(step.expr)
    if step.kind in ("max", "max_before"):
        return F.max(step.expr)
    rank = F.when(step.expr.isNotNull(), F.struct(*order))
    return F.min_by(step.expr, rank) if step.kind == "next" else F.max_by(step.expr, rank)


def _carry(step: Step, col: str, w: Window, back: Window) -> Column:
    before = w.rowsBetween(_LO, -1)
    if step.kind == "sum":
        return F.sum(col).over(before)
    if step.kind == "total":
        return F.sum(col).over(w.rowsBetween(_LO, _HI))
    if step.kind in ("max", "max_before"):
        return F.max(col).over(before)
    if step.kind == "next":
        return F.last(col, ignorenulls=True).over(back.rowsBetween(_LO, -1))
    return F.last(col, ignorenulls=True).over(before)


def _combine(step: Step, local: Column, carried: Column) -> Column:
    if step.kind == "sum":
        out = local + F.coalesce(carried, F.lit(0))
    elif step.kind == "total":
        out = carried
    elif step.kind in ("max", "max_before"):
        out = F.greatest(local, carried)
    else:
        out = F.coalesce(local, carried)
    return out.getField("v") if step.unwrap else out


def exchanged(df: DataFrame, keys: Sequence[str], block: Column | None = None) -> DataFrame:
    """``df`` with its block, if any, exchanged by (keys, block) in a form that all uses share.

    Columns go through the exchange in one array, so that a use of few columns does
    not become an exchange of its own below which other columns are pruned. Rows with
    a null key or block have no place and go here, alike for all uses, not in a join.
    """
    rest = [c for c in df.columns if c not in keys]
    body = F.array(F.struct(*[F.col(c) for c in rest])) if rest else F.array(F.struct(F.lit(0).alias("_none")))
    at = [*keys] if block is None else [*keys, "_blk"]
    placed = df.select(*keys, *([] if block is None else [block.alias("_blk")]), body.alias("_row"))
    for c in at:
        placed = placed.where(F.col(c).isNotNull())
    sent = placed.repartition(*at)
    row = F.element_at("_row", 1)
    return sent.select(*at, *[row.getField(c).alias(c) for c in rest], F.size("_row").alias("_one"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    **steps: Step,
) -> DataFrame:
    """Add one column per step, computed over (keys, order) block by block.

    ``order`` must be total within the keys. ``block`` must be non-null, never
    decrease along ``order``, and bound the rows that share one value.
    """
    at = [*keys, "_blk"]
    rows = exchanged(df, keys, block)
    w = Window.partitionBy(*at).orderBy(*order)
    back = Window.partitionBy(*at).orderBy(*[F.col(c).desc() for c in order])
    local = rows.drop("_one").select("*", *[_local(s, w, back).alias(f"_l_{n}") for n, s in steps.items()])

    # Every use reads ``_row``: sums that need no column read it for its size.
    sums = rows.groupBy(*at).agg(
        *[_summary(s, order).alias(f"_s_{n}") for n, s in steps.items()], F.sum("_one").alias("_rows")
    ).where("_rows > 0")
    wb = Window.partitionBy(*keys).orderBy("_blk")
    backb = Window.partitionBy(*keys).orderBy(F.col("_blk").desc())
    carried = sums.select(
        *at, *[_carry(s, f"_s_{n}", wb, backb).alias(f"_c_{n}") for n, s in steps.items()]
    )
    joined = local.join(carried, at, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in steps],
        *[_combine(s, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in steps.items()],
    )


def ordinal_block(ordinal: str, rows: int = ROWS_PER_BLOCK) -> Column:
    """Block of a dense ordinal."""
    return F.floor(F.col(ordinal) / F.lit(rows))


def width_block(value: str | Column, width: float) -> Column:
    """Block of a numeric order column, ``width`` units wide."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(width))


def halo(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    reach: int,
    exprs: dict[str, "callable"],
    rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add columns computed over a bounded frame of a dense ordinal.

    ``exprs`` maps a name to a function of the ordered window; no frame may look
    further than ``reach`` rows away. One shuffle, no second read of the input.
    """
    home = F.floor(F.col(ordinal) / F.lit(rows))
    place = F.pmod(F.col(ordinal), F.lit(rows))
    homes = F.filter(
        F.array(
            home,
            F.when(place < reach, home - 1),
            F.when(place >= rows - reach, home + 1),
        ),
        lambda b: b.isNotNull(),
    )
    spread = df.withColumn("_home", home).withColumn("_blk", F.explode(homes))
    w = Window.partitionBy(*keys, "_blk").orderBy(ordinal)
    out = spread.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
    keep = [c for c in df.columns if c not in exprs]
    return out.where("_blk = _home").select(*keep, *exprs)
