"""From timed syllables to notes on the beat grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import music
from strophe.functions.text import normalize_line
from strophe.functions.music import half_even
from strophe.operators.lyrics import repeated_block
from strophe.operators.scan import (
    lag,
    next_seen,
    ordinal_block,
    prev_seen,
    run_count,
    run_sum,
    scan,
)
from strophe.session import stage

LEAD_IN_MS = 500
GRID_MULTIPLIER = 2


def anchor_gap(first_note_ms: Column, first_beat_ms: Column, bpm: Column, lead_in_ms: int = LEAD_IN_MS) -> Column:
    """The offset of beat 0 in ms.

    The detected first beat, else the first note less a lead-in; never negative,
    and moved back by whole beats when it would fall after the first note.
    """
    zero = F.lit(0).cast("long")
    wanted = F.greatest(
        zero, half_even(F.coalesce(first_beat_ms.cast("double"), first_note_ms - F.lit(lead_in_ms)))
    )
    gap = F.coalesce(wanted, zero)
    first = half_even(first_note_ms.cast("double"))
    beat = music.beat_ms(bpm)
    moved = half_even(gap - F.ceil((gap - first) / beat) * beat)
    return F.when(gap > first, F.greatest(zero, moved)).otherwise(gap)


def quantize_unique(
    df: DataFrame, keys: Sequence[str], ordinal: str, raw: Column, counts: Column, name: str = "start_beat"
) -> DataFrame:
    """Add strictly rising grid positions: ``max(raw, previous + 1)`` over the counted rows.

    Closed form: with i the number of counted rows so far, the position is
    ``max(raw - i) + i``. Both the number and the maximum are carried from block
    to block in one pass; rows not counted get null.
    """
    keys = list(keys)
    rows = df.withColumn("_blk", ordinal_block(ordinal)).withColumn("_raw", F.when(counts, raw))
    at = [*keys, "_blk"]
    w = Window.partitionBy(*at).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_i", F.count("_raw").over(w))
    local = local.withColumn("_top", F.max(F.col("_raw") - F.col("_i")).over(w))
    sums = local.groupBy(*at).agg(F.count("_raw").alias("_n"), F.max("_top").alias("_best"))
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    based = sums.withColumn("_base", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
    carried = based.select(*at, "_base", F.max(F.col("_best") - F.col("_base")).over(wb).alias("_before"))
    joined = local.join(carried, at)
    place = F.greatest(F.col("_top") - F.col("_base"), F.col("_before")) + F.col("_i") + F.col("_base")
    return joined.select(*df.columns, F.when(F.col("_raw").isNotNull(), place).alias(name))


def next_onset(df: DataFrame, keys: Sequence[str], ordinal: str, start: Column, sung: Column, name: str = "next_start") -> DataFrame:
    """Add the start of the nearest following sung row."""
    return scan(df, keys, [ordinal], ordinal_block(ordinal), **{name: next_seen(F.when(sung, start))})


def capped_end(start: Column, end: Column, next_start: Column) -> Column:
    """End of a note: one beat long at least, never past the next onset."""
    return F.least(F.greatest(start + 1, end), next_start)


def break_beat(previous_end: Column, next_start: Column) -> Column:
    """Where a line break goes between two notes: a third into a rest of more than 3 beats."""
    rest = next_start - previous_end
    return F.when(rest > 3, previous_end + F.floor(rest / 3)).otherwise(previous_end)


def place_breaks_between(notes: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Place every break between the sung notes around it.

    Looks past other breaks, and leaves a break where a side is missing.
    """
    sung = F.col("note_type") != "-"
    out = scan(
        notes,
        keys,
        [ordinal],
        ordinal_block(ordinal),
        _pe=prev_seen(F.when(sung, F.col("start_beat") + F.col("duration"))),
        _ns=next_seen(F.when(sung, F.col("start_beat"))),
    )
    inner = ~sung & F.col("_pe").isNotNull() & F.col("_ns").isNotNull()
    moved = F.when(inner, break_beat(F.col("_pe"), F.col("_ns"))).otherwise(F.col("start_beat"))
    return out.withColumn("start_beat", moved).drop("_pe", "_ns")


def notes_on_grid(
    syllables: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    bpm: Column,
    gap: Column,
) -> DataFrame:
    """Notes and breaks with their beats from timed syllables.

    ``syllables`` has is_break, start_ms, end_ms, pitch and syllable; ``bpm`` is
    the exported tempo and ``gap`` the place of beat 0. A break is placed after
    the row right before it and dropped when no note follows.
    """
    sung = ~F.col("is_break")
    raw = music.ms_to_beats("start_ms", bpm, gap)
    placed = quantize_unique(syllables, keys, ordinal, raw, sung, "_start")
    placed = stage(placed.withColumn("_end", F.when(sung, music.ms_to_beats("end_ms", bpm, gap))))
    around = scan(
        placed,
        keys,
        [ordinal],
        ordinal_block(ordinal),
        _next=next_seen(F.col("_start")),
        _prev=lag(F.struct(F.col("_start").alias("s"), F.col("_end").alias("e"))),
    )
    prev_end = F.when(
        F.col("_prev.s").isNotNull(), capped_end(F.col("_prev.s"), F.col("_prev.e"), F.col("_next"))
    ).otherwise(F.lit(0).cast("long"))
    end = capped_end(F.col("_start"), F.col("_end"), F.col("_next"))
    zero = F.lit(0).cast("long")
    keep = [c for c in syllables.columns if c not in ("is_break", "start_ms", "end_ms", "pitch", "syllable", "note_type")]
    return around.where(sung | F.col("_next").isNotNull()).select(
        *keep,
        F.when(sung, ":").otherwise("-").alias("note_type"),
        F.when(sung, F.col("_start")).otherwise(break_beat(prev_end, F.col("_next"))).alias("start_beat"),
        F.when(sung, end - F.col("_start")).otherwise(zero).alias("duration"),
        F.when(sung, F.col("pitch")).otherwise(0).cast("int").alias("pitch"),
        F.when(sung, F.coalesce(F.nullif(F.col("syllable"), F.lit("")), F.lit("~"))).otherwise("").alias("syllable"),
    )


def song_anchors(syllables: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """(keys, first_note_ms): the start of the first sung syllable in row order."""
    sung = F.when(~F.col("is_break"), F.col(ordinal))
    return syllables.groupBy(*keys).agg(F.min_by("start_ms", sung).alias("first_note_ms"))


def generate(
    syllables: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    lyric_lines: DataFrame | None = None,
    lead_in_ms: int = LEAD_IN_MS,
    multiplier: int = GRID_MULTIPLIER,
) -> tuple[DataFrame, DataFrame]:
    """(headers, notes) of every song.

    ``songs`` has bpm and first_beat_ms (null if unknown) and any header fields;
    the song table is joined to the syllables by key. With ``lyric_lines(keys,
    line_no, line)`` the repeated section is put into the header as well.
    """
    keys = list(keys)
    syllables = stage(syllables)
    first = song_anchors(syllables, keys, ordinal)
    headed = songs.join(first, keys).withColumn("bpm", F.col("bpm") * multiplier)
    headed = headed.withColumn(
        "gap", anchor_gap(F.col("first_note_ms"), F.col("first_beat_ms"), F.col("bpm"), lead_in_ms)
    )
    headed = stage(headed)
    timed = syllables.join(headed.select(*keys, "bpm", "gap"), keys)
    notes = stage(notes_on_grid(timed, keys, ordinal, F.col("bpm"), F.col("gap")))
    if lyric_lines is None:
        sung_start = F.when(F.col("note_type") != "-", F.col(ordinal))
        firsts = notes.groupBy(*keys).agg(F.min_by("start_beat", sung_start).alias("_first"))
        headed = headed.join(firsts, keys, "left").withColumn(
            "preview_start", (F.col("gap") + F.col("_first") * music.beat_ms("bpm")) / 1000.0
        )
        headers = headed.drop("_first", "first_note_ms", "first_beat_ms")
    else:
        block = block_to_beats(notes.drop("bpm", "gap"), lyric_lines, headed.select(*keys, "bpm", "gap"), keys, ordinal)
        headers = headed.drop("first_note_ms", "first_beat_ms").join(block, keys, "left")
    return headers, notes.drop("bpm", "gap")


def line_numbers(notes: DataFrame, keys: Sequence[str], ordinal: str, name: str = "line_no") -> DataFrame:
    """Add the number of the lyric line each row stands in: rests before it."""
    rest = F.when(F.col("note_type") == "-", 1).otherwise(0)
    return scan(notes, keys, [ordinal], ordinal_block(ordinal), **{name: run_sum(rest.cast("long"))})


def block_to_beats(
    notes: DataFrame, lines: DataFrame, songs: DataFrame, keys: Sequence[str], ordinal: str
) -> DataFrame:
    """(keys, medley_start_beat, medley_end_beat, preview_start) of each song with notes.

    The most repeated block of lyric lines (alike once normalized), put on the beat grid by line number.
    Without one, or if note lines and lyric lines do not match, only a preview
    at the first note is given.
    """
    keys = list(keys)
    sung = line_numbers(notes, keys, ordinal, "_line").where("note_type <> '-'")
    per_line = stage(
        sung.groupBy(*keys, "_line").agg(
            F.min_by("start_beat", ordinal).alias("first"),
            F.max_by(F.col("start_beat") + F.col("duration"), ordinal).alias("last"),
        )
    )
    whole = per_line.groupBy(*keys).agg(
        (F.max("_line") + 1).alias("groups"), F.min_by("first", "_line").alias("first_beat")
    )
    lines = stage(lines.withColumn("line", normalize_line(F.col("line"))))
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lyric_lines"))
    block = repeated_block(lines, keys, "line", "line_no").join(counts, keys)
    fits = whole.join(block, keys).where("groups = lyric_lines")
    starts = per_line.select(*keys, F.col("_line").alias("first_line"), F.col("first").alias("medley_start_beat"))
    ends = per_line.select(*keys, F.col("_line").alias("last_line"), F.col("last").alias("medley_end_beat"))
    medley = (
        fits.join(starts, [*keys, "first_line"]).join(ends, [*keys, "last_line"])
        .select(*keys, "medley_start_beat", "medley_end_beat")
    )
    out = whole.join(songs.select(*keys, "bpm", "gap"), keys).join(medley, keys, "left")
    at = F.coalesce(F.col("medley_start_beat"), F.col("first_beat"))
    preview = (F.col("gap") + at * music.beat_ms("bpm")) / 1000.0
    return out.select(*keys, "medley_start_beat", "medley_end_beat", preview.alias("preview_start"))


def count_sung(df: DataFrame, keys: Sequence[str], ordinal: str, name: str = "nth") -> DataFrame:
    """Add the 1-based number of each row among the sung rows."""
    return scan(df, keys, [ordinal], ordinal_block(ordinal), **{name: run_count(~F.col("is_break"))})
