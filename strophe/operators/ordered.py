"""Operators on ordered rows: sessions, islands, filling, folding, slicing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.music import half_even
from strophe.operators.folds import folded, ordered_fold
from strophe.operators.quantiles import linear, quantiles, ranked_counts
from strophe.operators.ranges import points_in_intervals
from strophe.operators.scan import (
    exchanged,
    halo,
    lag,
    next_seen,
    ordinal_block,
    position,
    prev_seen,
    run_count,
    run_max,
    run_sum,
    scan,
)
from strophe.operators.stats import ALIGNED, MIN_WEIGHT
from strophe.session import stage

VERSE_GAP = 2.0
SILENCE_RATIO, SILENCE_FLOOR = 0.05, 1e-6
MIN_CONFIDENCE, FALLBACK_CONFIDENCE = 0.3, 0.5
DROPOUT_GAP = 0.05
PITCH_TOLERANCE = 1
MIN_NOTE = 0.06
FRAME_STEP = 0.01
MAX_WORDS_PER_SECOND = 12.0


def dense_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "idx"
) -> DataFrame:
    """Add a dense 0-based position within the keys."""
    out = scan(df, keys, order, block, **{name: position()})
    return out.withColumn(name, F.col(name) - 1)


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    start: str,
    end: str,
    gap: float = VERSE_GAP,
    name: str = "verse",
) -> DataFrame:
    """Add a 0-based session number; one starts where the rest since the previous
    row's end is longer than ``gap``."""
    rows = scan(df, keys, order, block, _pe=lag(F.col(end)))
    opens = F.coalesce(F.col(start) - F.col("_pe") > F.lit(gap), F.lit(False))
    return scan(rows, keys, order, block, **{name: run_count(opens)}).drop("_pe")


def delimited_groups(
    df: DataFrame, keys: Sequence[str], ordinal: str, is_mark: Column, drop_empty: bool = True, name: str = "grp"
) -> DataFrame:
    """Add a 0-based group number to the rows between marks; marks are dropped.

    Empty groups are left out of the count, or kept in it, which leaves a hole.
    """
    if not drop_empty:
        return scan(df, keys, [ordinal], ordinal_block(ordinal), **{name: run_count(is_mark)}).where(~is_mark)
    # A group opens at a row whose neighbour above is a mark or missing.
    rows = halo(df.withColumn("_m", is_mark), keys, ordinal, 1, {"_pm": lambda w: F.lag("_m").over(w)})
    opens = ~F.col("_m") & F.coalesce(F.col("_pm"), F.lit(True))
    out = scan(rows, keys, [ordinal], ordinal_block(ordinal), **{name: run_count(opens)})
    return out.where("NOT _m").withColumn(name, F.col(name) - 1).drop("_m", "_pm")


def islands(
    df: DataFrame, keys: Sequence[str], ordinal: str, wanted: Column, name: str = "island"
) -> DataFrame:
    """Rows for which ``wanted`` holds, with a number shared by neighbouring rows.

    The number is the dense ordinal less the row number among the wanted rows.
    """
    rows = df.where(wanted)
    numbered = scan(rows, keys, [ordinal], ordinal_block(ordinal), _nth=position())
    return numbered.withColumn(name, F.col(ordinal) - F.col("_nth") + 1).drop("_nth")


def quiet_runs(
    frames: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    level: str,
    min_frames: int,
    ratio: float = SILENCE_RATIO,
) -> DataFrame:
    """(keys, first_frame, end_frame): long runs of quiet frames.

    Quiet is below ``ratio`` of the 95th percentile of the song. A run ends at
    the first loud frame, or at the last frame of the song.
    """
    keys = list(keys)
    # One read for the percentile and the last frame, one for the quiet frames.
    ranked = ranked_counts(frames, keys, level, _last=F.max(ordinal))
    top = ranked.groupBy(*keys).agg(linear(level, 0.95).alias("p95"), F.max("_last").alias("_last"))
    top = top.where(F.col("p95") >= SILENCE_FLOOR)
    quiet = frames.select(*keys, ordinal, level).join(top, keys).where(F.col(level) < F.lit(ratio) * F.col("p95"))
    runs = islands(quiet.select(*keys, ordinal, "_last"), keys, ordinal, F.lit(True)).groupBy(*keys, "island").agg(
        F.min(ordinal).alias("first_frame"), F.max(ordinal).alias("_end"), F.count(F.lit(1)).alias("_n"), F.first("_last").alias("_last")
    )
    return runs.where(F.col("_n") >= min_frames).select(
        *keys, "first_frame", F.least(F.col("_end") + 1, F.col("_last")).alias("end_frame")
    )


def active_bounds(
    frames: DataFrame, keys: Sequence[str], at: str, level: str, frame_length: float, duration: str
) -> DataFrame:
    """(keys, start, end) of the audible part: frames above the 5th percentile.

    The whole song where no frame is above it.
    """
    keys = list(keys)
    floor = quantiles(frames, keys, level, _p5=linear(level, 0.05)).select(*keys, "_p5")
    loud = F.col(level) > F.col("_p5")
    return frames.join(floor, keys).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(loud, F.col(at))), F.lit(0.0)).alias("start"),
        F.coalesce(F.max(F.when(loud, F.col(at))) + F.lit(frame_length), F.max(duration)).alias("end"),
    )


# ---- notes inside a syllable ---------------------------------------------------------


def active_frames(
    frames: DataFrame, keys: Sequence[str], confidence: str, amplitude: str, threshold: str
) -> DataFrame:
    """Frames that pass the activity gate of their key.

    Confident and loud ones; where a key has none, the very confident ones.
    """
    keys = list(keys)
    first = (F.col(confidence) >= MIN_CONFIDENCE) & (F.col(amplitude) >= F.col(threshold))
    rows = frames.withColumn("_ok", first)
    any_ok = rows.groupBy(*keys).agg(F.bool_or("_ok").alias("_any"))
    passed = F.when(F.col("_any"), F.col("_ok")).otherwise(F.col(confidence) >= FALLBACK_CONFIDENCE)
    return rows.join(any_ok, keys).where(passed).drop("_ok", "_any")


def strongest_island(
    frames: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    at: str,
    energy: Column,
    dropout: float = DROPOUT_GAP,
) -> DataFrame:
    """The frames of the island with most energy per key, the first on a tie.

    A new island starts where the time since the previous frame exceeds ``dropout``.
    """
    keys = list(keys)
    rows = gap_sessions(frames, keys, order, block, at, at, dropout, "_isl")
    sums = rows.groupBy(*keys, "_isl").agg(F.sum(energy).alias("_e"))
    best = sums.groupBy(*keys).agg(F.max_by("_isl", F.struct("_e", -F.col("_isl"))).alias("_isl"))
    return rows.join(best, [*keys, "_isl"]).drop("_isl")


def rolling_median(
    df: DataFrame, keys: Sequence[str], ordinal: str, value: str, half: int = 2, name: str = "smooth", fallback: Column | None = None
) -> DataFrame:
    """Add the centred rolling median as an integer; 0 turns into the fallback."""
    out = halo(
        df, keys, ordinal, half,
        {name: lambda w: half_even(F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-half, half)))},
    )
    if fallback is None:
        return out
    return out.withColumn(name, F.when(F.col(name) == 0, fallback).otherwise(F.col(name)))


class _Runs:
    """Running state of one syllable: the pitches of the open run and its last time."""

    def __init__(self, keys, order, at, pitch, fallback, gap, tolerance):
        self.names = (keys, order, at, pitch, fallback)
        self.gap, self.tolerance = gap, tolerance
        self.counts, self.size, self.last, self.run = {}, 0, None, -1

    def median(self):
        """Median of the open run from its pitch counts, a half rounded to even."""
        low = high = None
        seen = 0
        for pitch in sorted(self.counts):
            seen += self.counts[pitch]
            if low is None and seen > (self.size - 1) // 2:
                low = pitch
            if seen > self.size // 2:
                high = pitch
                break
        return round((low + high) / 2)

    def push(self, row):
        keys, order, at, pitch, fallback = self.names
        t, p = getattr(row, at), int(getattr(row, pitch))
        joins = False
        if self.size:
            middle = self.median() or getattr(row, fallback)
            joins = t - self.last <= self.gap and abs(p - middle) <= self.tolerance
        if not joins:
            self.counts, self.size, self.run = {}, 0, self.run + 1
        self.counts[p] = self.counts.get(p, 0) + 1
        self.size, self.last = self.size + 1, t
        return [(*[getattr(row, k) for k in keys], getattr(row, order), self.run)]

    def end(self):
        return []


def pitch_runs(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    at: str,
    pitch: str,
    fallback: str,
    gap: float = DROPOUT_GAP,
    tolerance: int = PITCH_TOLERANCE,
    name: str = "run",
) -> DataFrame:
    """Add the number of the pitch run of each frame.

    A frame joins the open run if it follows within ``gap`` and lies within
    ``tolerance`` of the median of the run so far; the median makes each step
    depend on the one before. The state is a count per pitch. ``keys`` name one
    syllable or another short stretch.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    slim = df.select(*keys, ordinal, at, pitch, fallback)
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*keys, ordinal)], f"{name} bigint"])
    numbered = ordered_fold(
        slim, keys, [ordinal], lambda: _Runs(keys, ordinal, at, pitch, fallback, gap, tolerance), schema
    )
    return df.join(numbered, [*keys, ordinal])


def merge_short_runs(
    df: DataFrame, keys: Sequence[str], run: str, at: str, min_length: float = MIN_NOTE, name: str = "note"
) -> DataFrame:
    """Add the note each run belongs to.

    A run shorter than ``min_length`` joins the note before it; if the first note
    is then still shorter, it joins the second. Both rules are sums over the runs.
    """
    keys = list(keys)
    runs = df.groupBy(*keys, run).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    short = F.col("_b") - F.col("_a") < F.lit(min_length)
    notes = scan(
        runs, keys, [run], ordinal_block(run), _note=run_count(~short | (F.col(run) == 0))
    )
    spans = notes.groupBy(*keys, "_note").agg(F.min("_a").alias("_na"), F.max("_b").alias("_nb"))
    firsts = spans.groupBy(*keys).agg(
        F.max(F.when(F.col("_note") == 1, F.col("_nb") - F.col("_na"))).alias("_len"), F.count(F.lit(1)).alias("_k")
    )
    joined = notes.join(firsts, keys)
    moved = (F.col("_note") == 1) & (F.col("_k") > 1) & (F.col("_len") < F.lit(min_length))
    mapping = joined.select(*keys, run, F.when(moved, F.lit(2)).otherwise(F.col("_note")).cast("long").alias(name))
    return df.join(mapping, [*keys, run])


class _RunSums(_Runs):
    """The same runs, each as one row once it ends: its times, weighted pitches, weights, first step of the syllable."""

    def __init__(self, *args):
        super().__init__(*args)
        self.step, self.row = None, None

    def push(self, row):
        if self.row is None and self.run < 0:
            self.step = None if row.step != row.step else row.step
        (joined,) = super().push(row)
        done = self.end() if self.row and self.row[0] != joined[-1] else []
        if done or self.row is None:
            self.row = [joined[-1], row.t, row.t, 0.0, 0.0]
            self.key = joined[:-2]
        self.row[2] = row.t
        self.row[3] += row.pitched
        self.row[4] += row.weight
        return done

    def end(self):
        return [(*self.key, *self.row, self.step)] if self.row else []


def sung_runs(
    frames: DataFrame, keys: Sequence[str], at: str, pitch: str, fallback: str, energy: Column,
    dropout: float = DROPOUT_GAP, tolerance: int = PITCH_TOLERANCE,
) -> DataFrame:
    """(keys, run, first, last, pitched, weight, step): the pitch runs of each syllable's strongest island.

    ``frames`` are those that may count: where a key has any with ``_ok`` only these
    do. They are exchanged once, by the keys: ``active_frames``, ``strongest_island``,
    ``rolling_median`` and ``pitch_runs`` for keys that name one syllable or another
    short stretch. ``pitched`` and ``weight`` are the sums of a ``weighted_pitch``,
    ``step`` is the time from the first to the second frame.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(at)
    t = F.col(at)
    rows = exchanged(frames.select(*keys, at, pitch, fallback, "_ok", energy.alias("_energy")), keys).drop("_one")
    rows = rows.withColumn("_any", F.bool_or("_ok").over(whole)).where(~F.coalesce("_any", F.lit(False)) | F.col("_ok"))
    opens = F.coalesce(t - F.lag(at).over(w) > F.lit(dropout), F.lit(False))
    rows = rows.withColumn("_opens", opens.cast("long")).withColumn("_isl", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(*keys, "_isl").agg(F.sum("_energy").alias("_e"))
    best = sums.groupBy(*keys).agg(F.max_by("_isl", F.struct("_e", -F.col("_isl"))).alias("_best"))
    # As an equality it would become a key of the join, and the frames be exchanged by it.
    kept = rows.join(best, keys).where("_isl - _best = 0")
    smooth = half_even(F.percentile(pitch, F.lit(0.5)).over(w.rowsBetween(-2, 2)))
    weight = F.greatest(F.lit(MIN_WEIGHT), F.col("_energy"))
    kept = kept.withColumn("_smooth", smooth).withColumn("step", F.lead(at).over(w) - t)
    kept = kept.withColumn("smooth", F.when(F.col("_smooth") == 0, F.col(fallback)).otherwise(F.col("_smooth")))
    # The window has just brought each key together, in order.
    slim = kept.select(
        *keys, t.alias("t"), "smooth", F.col(fallback).alias("fallback"), (F.col("smooth") * weight).alias("pitched"),
        weight.alias("weight"), "step",
    ).sortWithinPartitions(*keys, "t")
    types = dict(frames.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], "run bigint", *[f"{c} double" for c in ("first", "last", "pitched", "weight", "step")]])
    return folded(slim, keys, lambda: _RunSums(keys, "t", "t", "smooth", "fallback", dropout, tolerance), schema)


def merged_runs(
    runs: DataFrame, keys: Sequence[str], run: str, first: str, last: str, min_length: float = MIN_NOTE, name: str = "note"
) -> DataFrame:
    """``merge_short_runs`` for one row per run, brought together by the keys alone: a syllable has few."""
    whole = Window.partitionBy(*keys)
    opens = (F.col(last) - F.col(first) >= F.lit(min_length)) | (F.col(run) == 0)
    notes = runs.withColumn("_opens", opens.cast("long"))
    notes = notes.withColumn("_note", F.sum("_opens").over(whole.orderBy(run).rowsBetween(Window.unboundedPreceding, 0)))
    one = F.col("_note") == 1
    length = F.max(F.when(one, F.col(last))).over(whole) - F.min(F.when(one, F.col(first))).over(whole)
    notes = notes.withColumns({"_len": length, "_k": F.max("_note").over(whole)})
    moved = one & (F.col("_k") > 1) & (F.col("_len") < F.lit(min_length))
    return notes.withColumn(name, F.when(moved, F.lit(2)).otherwise(F.col("_note")).cast("long")).drop("_opens", "_note", "_len", "_k")


# ---- filling -------------------------------------------------------------------------


def interpolate_gaps(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    start: str,
    end: str,
    mode: str = "final",
    low: str | None = None,
    high: str | None = None,
    midi: str | None = None,
    between_start: str | None = None,
    between_end: str | None = None,
) -> DataFrame:
    """Fill the times of unmatched rows (null start) from the matched rows around them.

    Adds ``source``: aligned, before, between or after. ``final`` keeps at least
    0.1 s a word before, at most 0.8 s between and the mean length (at least
    0.2 s) after; ``between_start``/``between_end`` on the row after a gap give
    the stretch of unused words there. ``approx`` spreads over the timeline from
    ``low`` to ``high``. Keys without a matched row are spread over ``low`` to
    ``high`` as well.
    """
    keys = list(keys)
    hit = F.col(start).isNotNull()
    anchor = F.struct(
        F.col(ordinal).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"),
        (F.col(midi) if midi else F.lit(None).cast("int")).alias("m"),
        (F.col(between_start) if between_start else F.lit(None).cast("double")).alias("us"),
        (F.col(between_end) if between_end else F.lit(None).cast("double")).alias("ue"),
    )
    mark = F.when(hit, anchor)
    rows = scan(
        df, keys, [ordinal], ordinal_block(ordinal), _p=prev_seen(mark), _n=next_seen(mark)
    )
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.avg(F.when(hit, F.col(end) - F.col(start))).alias("_avg"),
        F.min(ordinal).alias("_o0"),
    )
    rows = rows.join(sums, keys)
    i = F.col(ordinal) - F.col("_o0")
    p, n = F.col("_p"), F.col("_n")
    no, po = n["o"] - F.col("_o0"), p["o"] - F.col("_o0")
    k = i - po
    missing = no - po - 1
    lo = F.col(low) if low else F.lit(0.0)
    hi = F.col(high) if high else F.lit(0.0)
    all_slot = F.greatest(F.lit(0.01), (hi - lo) / F.col("_rows"))
    if mode == "final":
        b_slot = F.greatest(F.lit(0.1), n["s"] / no)
        before = (
            F.greatest(F.lit(0.0), n["s"] - (no - i) * b_slot),
            F.greatest(F.lit(0.0), n["s"] - (no - i - 1) * b_slot),
        )
        ts, te = F.coalesce(n["us"], p["e"]), F.coalesce(n["ue"], n["s"])
        span = F.least(F.greatest(F.lit(0.0), te - ts), missing * F.lit(0.8))
        between = (ts + (k - 1) * span / missing, ts + k * span / missing)
        a_slot = F.greatest(F.lit(0.2), F.col("_avg"))
        offset = (k - 1) * a_slot
        after = (p["e"] + offset, p["e"] + offset + a_slot)
    else:
        b_slot = F.greatest(F.lit(0.01), (n["s"] - lo) / no)
        before = (lo + i * b_slot, lo + (i + 1) * b_slot)
        m_slot = F.greatest(F.lit(0.01), (n["s"] - p["e"]) / missing)
        between = (p["e"] + (k - 1) * m_slot, F.least(n["s"], p["e"] + k * m_slot))
        remaining = F.col("_rows") - po - 1
        a_slot = F.greatest(F.lit(0.01), (hi - p["e"]) / remaining)
        after = (p["e"] + (k - 1) * a_slot, p["e"] + k * a_slot)
    nowhere = (lo + i * all_slot, lo + (i + 1) * all_slot)

    def choose(x: int, own: str) -> Column:
        return (
            F.when(hit, F.col(own))
            .when(p.isNotNull() & n.isNotNull(), between[x])
            .when(n.isNotNull(), before[x])
            .when(p.isNotNull(), after[x])
            .otherwise(nowhere[x])
        )

    source = (
        F.when(hit, ALIGNED)
        .when(p.isNotNull() & n.isNotNull(), "between")
        .when(n.isNotNull() | p.isNull(), "before")
        .otherwise("after")
    )
    out = [c for c in df.columns if c not in (start, end, midi)]
    columns = [F.col(c) for c in out] + [choose(0, start).alias(start), choose(1, end).alias(end)]
    if midi:
        line = half_even(p["m"] + k / (missing + 1) * (n["m"] - p["m"]))
        columns.append(
            F.when(hit, F.col(midi))
            .when(p.isNotNull() & n.isNotNull(), line)
            .otherwise(F.coalesce(n["m"], p["m"], F.col(midi)))
            .cast("int")
            .alias(midi)
        )
    return rows.select(*columns, source.alias("source"))


def split_shared(
    df: DataFrame, keys: Sequence[str], ordinal: str, signature: str, start: str, end: str, weight: Column,
    eligible: Column | None = None,
) -> DataFrame:
    """Divide one source interval among the neighbouring rows that share it.

    Neighbours with the same non-null ``signature`` form a group; its interval is
    cut in proportion to the weights. Groups with a row that is not ``eligible``
    keep their times.
    """
    keys = list(keys)
    marked = df.withColumn("_sig", F.col(signature))
    rows = halo(marked, keys, ordinal, 1, {"_ps": lambda w: F.lag("_sig").over(w)})
    opens = ~F.coalesce(F.col("_ps") == F.col("_sig"), F.lit(False))
    w = F.greatest(F.lit(1), weight).cast("double")
    grouped = scan(
        rows.withColumn("_w", w), keys, [ordinal], ordinal_block(ordinal), _g=run_count(opens), _cw=run_sum(F.col("_w"))
    )
    ok = F.lit(True) if eligible is None else eligible
    spans = grouped.groupBy(*keys, "_g").agg(
        F.min(start).alias("_s"), F.max(end).alias("_e"), F.sum("_w").alias("_tw"),
        F.min(F.col("_cw") - F.col("_w")).alias("_base"), F.count(F.lit(1)).alias("_k"), F.bool_and(ok).alias("_ok"),
    )
    out = grouped.join(spans, [*keys, "_g"])
    shared = (F.col("_k") > 1) & F.col("_sig").isNotNull() & F.col("_ok")
    length = F.col("_e") - F.col("_s")
    upto = F.col("_cw") - F.col("_base")
    keep = [c for c in df.columns if c not in (start, end)]
    return out.select(
        *keep,
        F.when(shared, F.col("_s") + length * (upto - F.col("_w")) / F.col("_tw")).otherwise(F.col(start)).alias(start),
        F.when(shared, F.col("_s") + length * upto / F.col("_tw")).otherwise(F.col(end)).alias(end),
    )


def fill_intervals(
    df: DataFrame, keys: Sequence[str], ordinal: str, start: str, end: str, low: str, high: str
) -> DataFrame:
    """Intervals of the syllables of one word from the times of its characters.

    ``start``/``end`` are the character bounds of a syllable or null; ``low`` and
    ``high`` bound the word. Holes are shared out equally, all-missing words are
    divided evenly, and overlaps of neighbours are cut in the middle. A cut moves
    an end and the next start only, so both follow from the neighbours alone.
    """
    keys = list(keys)
    known = F.col(start).isNotNull()
    clamped = df.withColumn(
        "_s", F.when(known, F.greatest(F.col(low), F.col(start)))
    ).withColumn("_e", F.when(known, F.least(F.col(high), F.col(end))))
    mark = F.when(F.col("_s").isNotNull(), F.struct(F.col(ordinal).alias("o"), F.col("_s").alias("s"), F.col("_e").alias("e")))
    rows = scan(clamped, keys, [ordinal], ordinal_block(ordinal), _p=prev_seen(mark), _n=next_seen(mark))
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), F.count(start).alias("_hits"), F.min(ordinal).alias("_o0"), F.max(ordinal).alias("_o1")
    )
    rows = rows.join(sums, keys)
    even = F.greatest(F.lit(0.01), (F.col(high) - F.col(low)) / F.col("_k"))
    i = F.col(ordinal) - F.col("_o0")
    left = F.coalesce(F.col("_p.e"), F.col(low))
    right = F.coalesce(F.col("_n.s"), F.col(high))
    first = F.coalesce(F.col("_p.o") + 1, F.col("_o0"))
    stop = F.coalesce(F.col("_n.o"), F.col("_o1") + 1)
    slot = F.greatest(F.lit(0.0), right - left) / (stop - first)
    at = F.col(ordinal) - first
    none = F.col("_hits") == 0
    filled = rows.select(
        *df.columns,
        none.alias("_none"),
        F.when(none, F.col(low) + i * even).when(F.col("_s").isNotNull(), F.col("_s")).otherwise(left + at * slot).alias("_fs"),
        F.when(none, F.col(low) + (i + 1) * even).when(F.col("_s").isNotNull(), F.col("_e")).otherwise(left + (at + 1) * slot).alias("_fe"),
    )
    around = halo(
        filled, keys, ordinal, 1,
        {"_pe": lambda w: F.lag("_fe").over(w), "_ns": lambda w: F.lead("_fs").over(w)},
    )
    s, e = F.col("_fs"), F.col("_fe")
    new_start = F.when(~F.col("_none") & (F.col("_pe") > s), F.least(e, (F.col("_pe") + s) / 2)).otherwise(s)
    new_end = F.when(~F.col("_none") & (e > F.col("_ns")), F.greatest(new_start, (e + F.col("_ns")) / 2)).otherwise(e)
    keep = [c for c in df.columns if c not in (start, end)]
    return around.select(*keep, new_start.alias(start), new_end.alias(end))


class _Cuts:
    """Running state of one island of touching words: the open row."""

    def __init__(self, keys, order):
        self.keys, self.order, self.open = keys, order, None

    def push(self, row):
        now = [*[getattr(row, k) for k in self.keys], getattr(row, self.order), row.s, row.e]
        if self.open is None:
            self.open, self.pauses = now, row.pauses
            return []
        done, pauses = self.open, self.pauses
        for ps, pe in pauses if pauses is not None else []:
            if done[-2] <= ps and pe <= now[-1]:
                done[-1], now[-2] = min(done[-1], ps), max(now[-2], pe)
                break
        if done[-1] > now[-2]:
            middle = (done[-1] + now[-2]) / 2
            done[-1], now[-2] = max(done[-2], middle), min(now[-1], middle)
        self.open, self.pauses = now, row.pauses
        return [tuple(done)]

    def end(self):
        return [tuple(self.open)] if self.open is not None else []


def resolve_overlaps(
    words: DataFrame,
    pauses: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    start: str,
    end: str,
    width: float,
) -> DataFrame:
    """Cut neighbouring words at the pause between them, or in the middle of an overlap.

    Left to right, each cut feeding the next pair. A pair that neither overlaps
    nor has a pause leaves both words alone, so a song falls into short islands
    of touching words, and only those are folded. ``pauses`` has pause_idx,
    pause_start and pause_end. ``ordinal`` is dense.
    """
    keys = list(keys)
    pairs = halo(
        words, keys, ordinal, 1,
        {"_ns": lambda w: F.lead(start).over(w), "_ne": lambda w: F.lead(end).over(w)},
    )
    # Starts only move right, so the pauses seen from the given start include all
    # that the moved start can still meet.
    spans = pairs.where("_ne IS NOT NULL").select(
        *keys, ordinal, F.col(start).alias("_a"), F.col("_ne").alias("_b")
    ).where("_b > _a")
    found = (
        _inside(spans, pauses, keys, width)
        .groupBy(*keys, ordinal)
        .agg(F.array_sort(F.collect_list(F.struct("pause_idx", "pause_start", "pause_end"))).alias("_ps"))
    )
    listed = F.transform("_ps", lambda p: F.array(p["pause_start"], p["pause_end"]))
    rows = pairs.join(found.select(*keys, ordinal, listed.alias("pauses")), [*keys, ordinal], "left")
    touches = F.coalesce(F.col(end) > F.col("_ns"), F.lit(False)) | F.col("pauses").isNotNull()
    tied = halo(
        rows.withColumn("_t", touches), keys, ordinal, 1, {"_pt": lambda w: F.lag("_t").over(w)}
    )
    island = scan(
        tied, keys, [ordinal], ordinal_block(ordinal), isl=run_count(~F.coalesce(F.col("_pt"), F.lit(False)))
    )
    types = dict(words.dtypes)
    group = [*keys, "isl"]
    schema = ", ".join(
        [*[f"{k} {types[k]}" for k in keys], "isl bigint", f"{ordinal} {types[ordinal]}", "s double", "e double"]
    )
    slim = island.select(*group, ordinal, F.col(start).alias("s"), F.col(end).alias("e"), "pauses")
    cut = ordered_fold(slim, group, [ordinal], lambda: _Cuts(group, ordinal), schema)
    keep = [c for c in words.columns if c not in (start, end)]
    return words.select(*keep).join(
        cut.select(*keys, ordinal, F.col("s").alias(start), F.col("e").alias(end)), [*keys, ordinal]
    )


def _inside(spans: DataFrame, pauses: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pauses that lie wholly inside a span [_a, _b]."""
    hits = points_in_intervals(pauses, spans, keys, "pause_start", ("_a", "_b"), width)
    return hits.where(F.col("pause_end") <= F.col("_b"))


def monotone_mid(df: DataFrame, keys: Sequence[str], ordinal: str, start: str, end: str) -> DataFrame:
    """Move intervals right so that their middles never fall back; lengths stay."""
    rows = df.withColumn("_s", F.greatest(F.lit(0.0), F.col(start)))
    rows = rows.withColumn("_e", F.greatest(F.col("_s"), F.col(end)))
    out = scan(
        rows, keys, [ordinal], ordinal_block(ordinal), _mid=run_max((F.col("_s") + F.col("_e")) / 2)
    )
    mid, half = F.greatest(F.lit(0.0), F.col("_mid")), (F.col("_e") - F.col("_s")) / 2
    keep = [c for c in df.columns if c not in (start, end)]
    return out.select(*keep, F.greatest(F.lit(0.0), mid - half).alias(start), (mid + half).alias(end))


def assign_region(
    words: DataFrame, cuts: DataFrame, keys: Sequence[str], ordinal: str, middle: Column, width: float
) -> DataFrame:
    """Add ``region``: the number of cuts at or before the middle, never falling back.

    Cuts are counted on one timeline with the words, block by block; no list of
    cuts is built.
    """
    keys = list(keys)
    rows = words.withColumn("_mid", middle)
    lane = rows.withColumn("_kind", F.lit(1)).unionByName(
        cuts.select(*keys, F.col("cut").alias("_mid"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    counted = scan(
        lane, keys, ["_mid", "_kind", ordinal], F.floor(F.col("_mid") / F.lit(width)),
        _r=run_count(F.col("_kind") == 0),
    ).where("_kind = 1")
    out = scan(counted, keys, [ordinal], ordinal_block(ordinal), region=run_max(F.col("_r")))
    return out.select(*words.columns, "region")


def pause_chunks(
    words: DataFrame, cuts: DataFrame, songs: DataFrame, keys: Sequence[str], region: str, ordinal: str, word: str,
    densest: float = MAX_WORDS_PER_SECOND,
) -> DataFrame:
    """(keys, chunk_idx, text, start, end, first_word, last_word): words per pause-free stretch.

    A stretch with more than ``densest`` words a second joins the chunk before
    it. That depends on the stretch alone, so chunks are running counts.
    ``songs`` has a duration; ``words`` the region of each word.
    """
    keys = list(keys)
    words = stage(words)
    per = words.groupBy(*keys, region).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ordinal).alias("_f"), F.max(ordinal).alias("_l")
    )
    numbered = dense_order(cuts, keys, ["cut"], F.floor(F.col("cut") / 600.0), "_k")
    left = numbered.select(*keys, (F.col("_k") + 1).alias(region), F.col("cut").alias("_from"))
    right = numbered.select(*keys, F.col("_k").alias(region), F.col("cut").alias("_to"))
    spans = (
        per.join(left, [*keys, region], "left").join(right, [*keys, region], "left").join(songs, keys)
        .withColumn("_from", F.coalesce("_from", F.lit(0.0)))
        .withColumn("_to", F.coalesce("_to", F.col("duration")))
    )
    length = F.col("_to") - F.col("_from")
    dense = F.coalesce((length > 0) & (F.col("_n") / length > F.lit(densest)), F.lit(False))
    chunked = scan(
        stage(spans.withColumn("_dense", dense)), keys, [region], ordinal_block(region),
        _c=run_count(~F.col("_dense")), _pos=position(),
    )
    # A dense first stretch has nothing before it and opens a chunk of its own.
    first_dense = chunked.groupBy(*keys).agg(F.bool_or((F.col("_pos") == 1) & F.col("_dense")).alias("_fd"))
    numbered_spans = chunked.join(first_dense, keys).withColumn(
        "chunk_idx", F.col("_c") - F.when(F.col("_fd"), 0).otherwise(1)
    )
    text = words.join(numbered_spans.select(*keys, region, "chunk_idx"), [*keys, region]).groupBy(*keys, "chunk_idx").agg(
        F.expr(f"listagg({word}, ' ') WITHIN GROUP (ORDER BY {ordinal})").alias("text")
    )
    bounds = numbered_spans.groupBy(*keys, "chunk_idx").agg(
        F.min("_from").alias("start"), F.max("_to").alias("end"), F.min("_f").alias("first_word"), F.max("_l").alias("last_word")
    )
    return text.join(bounds, [*keys, "chunk_idx"]).select(
        *keys, "chunk_idx", "text", "start", "end", "first_word", "last_word"
    )


# ---- neighbours, breaks, windows -------------------------------------------------------


def neighbour_gap(
    frames: DataFrame, keys: Sequence[str], word: str, at: str, voiced: Column, start: str, end: str
) -> DataFrame:
    """(keys, word, gap): first voiced frame of the next word less the last of this one.

    A word without voiced frames uses its own start and end.
    """
    keys = list(keys)
    t = F.when(voiced, F.col(at))
    per = frames.groupBy(*keys, word).agg(
        F.coalesce(F.min(t), F.min(start)).alias("_lo"), F.coalesce(F.max(t), F.max(end)).alias("_hi")
    )
    out = scan(per, keys, [word], ordinal_block(word), _next=next_seen(F.col("_lo")))
    return out.where("_next IS NOT NULL").select(*keys, word, (F.col("_next") - F.col("_hi")).alias("gap"))


def insert_breaks(
    notes: DataFrame, keys: Sequence[str], ordinal: str, line: str, start: str
) -> DataFrame:
    """Put a break row in front of each row that begins a new line.

    Adds ``is_break`` and a new dense ordinal ``pos``.
    """
    keys = list(keys)
    rows = halo(notes, keys, ordinal, 1, {"_pl": lambda w: F.lag(line).over(w)})
    turn = F.coalesce(F.col("_pl") != F.col(line), F.lit(False))
    counted = scan(rows.withColumn("_turn", turn), keys, [ordinal], ordinal_block(ordinal), _b=run_count(F.col("_turn")))
    both = counted.withColumn(
        "is_break", F.explode(F.when(F.col("_turn"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    )
    pos = F.col(ordinal) + F.col("_b") - F.col("is_break").cast("int")
    return both.select(*notes.columns, "is_break", pos.cast("long").alias("pos"))


def queue_position(
    jobs: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, status: str, waiting: str = "queued"
) -> DataFrame:
    """0-based place of each waiting job in its queue, oldest first."""
    return dense_order(jobs.where(F.col(status) == waiting), keys, order, block, "queue_pos")


def page_window(notes: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, from_ms, to_ms): the padded time window of each line."""
    out = notes.groupBy(*keys).agg(
        F.greatest(F.lit(0), F.min(start) - 200).alias("from_ms"), (F.max(end) + 400).alias("_to")
    )
    return out.select(*keys, "from_ms", F.greatest(F.col("from_ms") + 250, F.col("_to")).alias("to_ms"))


def first_strong_slot(
    grid: DataFrame, frames: DataFrame, keys: Sequence[str], slot: str, frame: str, level: str, ordinal: str,
    reach: int = 2, share: float = 0.5,
) -> DataFrame:
    """(keys, slot): the earliest grid slot with a strong frame within ``reach`` frames.

    Strong is at least ``share`` of the song's loudest frame. Each strong frame
    is copied to the few places it reaches; the match is an equality join.
    """
    keys = list(keys)
    top = frames.groupBy(*keys).agg(F.max(level).alias("_top"))
    limit = F.when(F.col("_top") > 0, F.lit(share) * F.col("_top")).otherwise(0.0)
    strong = frames.join(top, keys).where(F.col(level) >= limit)
    near = strong.select(
        *keys, F.explode(F.sequence(F.col(ordinal) - reach, F.col(ordinal) + reach)).alias(frame)
    ).distinct()
    return grid.join(near, [*keys, frame]).groupBy(*keys).agg(F.min(slot).alias(slot))


# ---- slices ------------------------------------------------------------------------------


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, limit: int
) -> DataFrame:
    """The first ``limit`` rows of each key, the report size being the feature."""
    return scan(df, keys, order, block, _nth=position()).where(F.col("_nth") <= limit).drop("_nth")


def position_slices(
    df: DataFrame, keys: Sequence[str], ordinal: str, slices: dict[str, tuple[int | None, int | None]]
) -> DataFrame:
    """Rows of the named slices by position; negative bounds count from the end.

    A row in several slices appears once for each.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg((F.max(ordinal) + 1).alias("_n"))
    rows = df.join(sizes, keys)

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.lit(x) if x >= 0 else F.col("_n") + x

    names = [
        F.when(
            (F.col(ordinal) >= bound(a, F.lit(0))) & (F.col(ordinal) < bound(b, F.col("_n"))), F.lit(name)
        )
        for name, (a, b) in slices.items()
    ]
    hits = F.filter(F.array(*names), lambda s: s.isNotNull())
    return rows.withColumn("slice", F.explode(hits)).drop("_n")


def tail_per_key(
    df: DataFrame, keys: Sequence[str], ordinal: str, keep: int, show: int
) -> DataFrame:
    """The last ``show`` of the last ``keep`` rows of each key, from a dense ordinal."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.max(ordinal).alias("_last"))
    return df.join(sizes, keys).where(F.col("_last") - F.col(ordinal) < min(keep, show)).drop("_last")


def retention(df: DataFrame, created: Column, modified: Column, now: Column, days: float) -> DataFrame:
    """Rows young enough to keep; the change time stands in for a missing creation time."""
    return df.where(F.coalesce(created, modified) >= now - F.lit(days * 86400.0))
