"""Grouped statistics with the rounding and tie rules of timed-text data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.music import half_even
from strophe.functions.text import strip
from strophe.operators.quantiles import (
    from_counts,
    linear,
    medians,
    nearest_rank,
    quantiles,
)
from strophe.operators.scan import lag, scan

CONFIDENCE_LADDER = (0.5, 0.3, 0.1)
NOISE_FRACTION, SIGNAL_FRACTION, ACTIVITY_RATIO = 0.1, 0.75, 0.2
STABLE_ABSOLUTE, STABLE_RELATIVE = 2.0, 0.05
BEAT_LOW, BEAT_HIGH = 0.6, 1.1
MIN_PAUSE_BEATS, PHASE_TOLERANCE = 2.0, 0.2
ALIGNED = "aligned"  # source of a word whose times were found and not interpolated
MIN_WEIGHT = 0.001
CLIP_CHARS = 200


def ladder_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    confidence: str,
    ladder: Sequence[float] = CONFIDENCE_LADDER,
    block: Column | None = None,
    bounded: bool = False,
    above: float | None = 0.0,
) -> DataFrame:
    """(keys, median, used): the median over the most confident rows there are.

    The first threshold that any value greater than ``above`` passes decides; with
    None every value that is not null counts. Keys without a
    single usable row are left out; the caller fills in its default. ``bounded``
    says that a key has few values, as the frames of one word: one aggregate then
    holds them, with a single exchange.
    """
    keys = list(keys)
    tallies = [f"_n{i}" for i in range(len(ladder))]
    counts_at_all = F.col(value).isNotNull() if above is None else F.col(value) > above
    usable = df.where(counts_at_all & (F.col(confidence) > min(ladder)))
    if bounded:
        passed = [F.col(confidence) > t for t in ladder]
        found = usable.groupBy(*keys).agg(
            *[F.percentile(F.when(c, F.col(value)), F.lit(0.5)).alias(f"_m{i}") for i, c in enumerate(passed)],
            *[F.count_if(c).alias(n) for c, n in zip(passed, tallies)],
        )
        used = F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in tallies])
        median = F.coalesce(*[F.col(f"_m{i}") for i in range(len(ladder))])
        return found.select(*keys, median.alias("median"), used.alias("used"))
    counts = usable.groupBy(*keys, value).agg(
        *[F.count_if(F.col(confidence) > t).alias(n) for t, n in zip(ladder, tallies)]
    )
    totals = usable.groupBy(*keys).agg(
        *[F.count_if(F.col(confidence) > t).alias(f"{n}_all") for t, n in zip(ladder, tallies)]
    )
    pick, size = F.lit(None).cast("long"), F.lit(None).cast("long")
    for n in reversed(tallies):
        pick = F.when(F.col(f"{n}_all") > 0, F.col(n)).otherwise(pick)
        size = F.when(F.col(f"{n}_all") > 0, F.col(f"{n}_all")).otherwise(size)
    chosen = counts.join(totals, keys).select(*keys, value, pick.alias("cnt"), size.alias("n")).where("cnt > 0")
    ranked = from_counts(chosen, keys, value, block)
    return ranked.groupBy(*keys).agg(linear(value, 0.5).alias("median"), F.max("n").alias("used"))


def int_median(df: DataFrame, keys: Sequence[str], value: str, block: Column | None = None) -> DataFrame:
    """(keys, n, median) as an integer, a half rounded to even."""
    return medians(df, keys, value, "median", block).withColumn("median", half_even(F.col("median")))


def activity_threshold(df: DataFrame, keys: Sequence[str], amplitude: str) -> DataFrame:
    """(keys, noise, signal, threshold) from nearest-rank percentiles of the amplitude."""
    out = quantiles(
        df,
        keys,
        amplitude,
        noise=nearest_rank(amplitude, NOISE_FRACTION),
        signal=nearest_rank(amplitude, SIGNAL_FRACTION),
    )
    lift = F.greatest(F.lit(0.0), F.col("signal") - F.col("noise")) * ACTIVITY_RATIO
    return out.select(*keys, "noise", "signal", (F.col("noise") + lift).alias("threshold"))


def sliding_rms(
    df: DataFrame, keys: Sequence[str], at: Column, value: Column, frame: float, hop: float
) -> DataFrame:
    """(keys, frame_no, rms, n): root mean square in overlapping frames.

    Frame i covers ``[i * hop, i * hop + frame)``; a sample is copied into the
    ``frame / hop`` frames it lies in and sums combine before the shuffle.
    """
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - F.lit(frame)) / F.lit(hop)) + 1)
    last = F.floor(at / F.lit(hop))
    spread = df.withColumn("_x", value.cast("double")).withColumn("frame_no", F.explode(F.sequence(first, last)))
    return spread.groupBy(*keys, "frame_no").agg(
        F.sqrt(F.avg(F.col("_x") * F.col("_x"))).alias("rms"), F.count(F.lit(1)).alias("n")
    )


def framed_rms(samples: Column, frame: int, hop: int) -> Column:
    """Root mean square of each full frame of a sample array."""
    count = F.greatest(F.lit(1), F.floor((F.size(samples) - frame) / hop).cast("int") + 1)

    def rms(i: Column) -> Column:
        # A series shorter than one frame is extended by its last sample.
        part = F.slice(samples, i * hop + 1, F.lit(frame))
        squares = F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        missing = frame - F.size(part)
        tail = F.element_at(samples, -1).cast("double")
        return F.sqrt((squares + F.when(missing > 0, missing * tail * tail).otherwise(0.0)) / frame)

    frames = F.transform(F.sequence(F.lit(0), count - 1), rms)
    return F.when(F.size(samples) == 0, F.array().cast("array<double>")).otherwise(frames)


def max_normalize(df: DataFrame, keys: Sequence[str], value: str, name: str = "level") -> DataFrame:
    """Add ``value`` divided by its largest value of the key, unless that is not positive."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))
    return df.join(top, list(keys)).withColumn(name, scaled).drop("_top")


def majority_vote(df: DataFrame, keys: Sequence[str], reading: str, order: str) -> DataFrame:
    """(keys, winner, votes, readings): most votes, the earliest seen on a tie."""
    counts = df.groupBy(*keys, reading).agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(
        F.min_by(reading, F.struct(-F.col("_c"), "_first")).alias("winner"),
        F.max("_c").alias("votes"),
        F.count(F.lit(1)).alias("readings"),
    )


def disagreements(df: DataFrame, keys: Sequence[str], reading: str) -> DataFrame:
    """(keys, votes): keys with several readings, as ``2x'a', 1x'b'`` by count and text."""
    counts = df.groupBy(*keys, reading).agg(F.count(F.lit(1)).alias("_c"))
    one = F.struct((-F.col("_c")).alias("c"), F.col(reading).alias("r"))
    votes = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_v"))
    shown = F.transform("_v", lambda v: F.concat((-v["c"]).cast("string"), F.lit("x'"), v["r"], F.lit("'")))
    return votes.where(F.size("_v") > 1).select(*keys, F.concat_ws(", ", shown).alias("votes"))


def character_quality(char_scores: str | None) -> Column:
    """Mean of the character scores that are not null; null without any."""
    if char_scores is None:
        return F.lit(None).cast("double")
    known = F.filter(char_scores, lambda s: s.isNotNull())
    total = F.aggregate(F.transform(known, lambda s: s.cast("double")), F.lit(0.0), lambda a, s: a + s)
    return F.when(F.size(known) > 0, total / F.size(known))


def best_candidate(
    df: DataFrame,
    keys: Sequence[str],
    reading: str,
    score: Column,
    middle: Column,
    order: str,
    char_scores: str | None = None,
) -> DataFrame:
    """One row per key: the best reading among those that won the vote.

    Highest score, then nearest to the median midpoint of the winning readings,
    then earliest. The score is the mean of the array ``char_scores`` where it has
    any, else ``score``, which is null where there is none. A key has a row for each
    run, so its rows are few; they are exchanged once, by key, where equal readings are peers.
    """
    keys = list(keys)
    same = Window.partitionBy(*keys).orderBy(reading).rangeBetween(Window.currentRow, Window.currentRow)
    rows = df.withColumns({"_c": F.count(F.lit(1)).over(same), "_first": F.min(order).over(same), "_mid": middle})
    every = Window.partitionBy(*keys)
    rows = rows.withColumn("_won", F.min(F.struct(-F.col("_c"), "_first")).over(every))
    rows = rows.where(F.col("_won") == F.struct(-F.col("_c"), "_first"))
    rows = rows.withColumn("_median", F.percentile("_mid", F.lit(0.5)).over(every))
    quality = F.coalesce(character_quality(char_scores), score, F.lit(-1.0))
    key = F.struct(-quality, F.abs(F.col("_mid") - F.col("_median")), F.col(order))
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), key).alias("_r")).select(*keys, "_r.*")


def median_candidate(
    df: DataFrame,
    keys: Sequence[str],
    matches: Column,
    start: str,
    end: str,
    order: str,
    char_scores: str | None = None,
) -> DataFrame:
    """One row per key: the candidate closest to the median start and end.

    Only candidates for which ``matches`` holds count, or all where none does; equal
    distances go to the better mean of the array ``char_scores`` (-1 without any; the
    score of the whole word does not count here), then to the earlier one. A key has
    a row for each run, so its rows are few; one exchange brings them together.
    """
    keys = list(keys)
    every = Window.partitionBy(*keys)
    rows = df.withColumn("_any", F.bool_or(matches).over(every)).where(matches | ~F.col("_any"))
    rows = rows.withColumns(
        {"_ms": F.percentile(start, F.lit(0.5)).over(every), "_me": F.percentile(end, F.lit(0.5)).over(every)}
    )
    far = F.abs(F.col(start) - F.col("_ms")) + F.abs(F.col(end) - F.col("_me"))
    key = F.struct(far, -F.coalesce(character_quality(char_scores), F.lit(-1.0)), F.col(order))
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), key).alias("_r")).select(*keys, "_r.*")


# ---- tempo -------------------------------------------------------------------------


def onset_gaps(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], block: Column) -> DataFrame:
    """Add ``gap``, the time since the previous onset of the key."""
    out = scan(df, keys, order, block, _before=lag(F.col(at)))
    return out.withColumn("gap", F.col(at) - F.col("_before")).drop("_before")


def chunk_rates(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    block: Column,
    chunk: float,
    min_tail: float,
    unit: float,
) -> DataFrame:
    """(keys, chunk, rate): onsets per ``unit`` of time in each fixed-length chunk.

    The rate is the inverse of the median gap inside the chunk; a last chunk
    shorter than ``min_tail`` is skipped. Gaps across chunk borders do not count.
    """
    keys = list(keys)
    length = df.groupBy(*keys).agg(F.max(at).alias("_end"))
    rows = df.withColumn("chunk", F.floor(F.col(at) / F.lit(chunk)))
    gaps = onset_gaps(rows, [*keys, "chunk"], at, order, block).where("gap > 0")
    rates = medians(gaps, [*keys, "chunk"], "gap").select(*keys, "chunk", (F.lit(unit) / F.col("median")).alias("rate"))
    whole = F.col("_end") - F.col("chunk") * F.lit(chunk) >= F.lit(min_tail)
    return rates.join(length, keys).where(whole).drop("_end")


def song_rate(chunks: DataFrame, overall: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, rate): the median of a song's overall rate and its chunk rates."""
    both = overall.select(*keys, "rate").unionByName(chunks.select(*keys, "rate"))
    return medians(both, keys, "rate", "rate_median").withColumnRenamed("rate_median", "rate")


def chunks_stable(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, stable): whether every chunk rate is close to the median of its song."""
    ref = medians(chunks, keys, "rate", "_ref").select(*keys, "_ref")
    limit = F.greatest(F.lit(STABLE_ABSOLUTE), F.lit(STABLE_RELATIVE) * F.col("_ref"))
    near = F.abs(F.col("rate") - F.col("_ref")) <= limit
    return chunks.join(ref, list(keys)).groupBy(*keys).agg(F.bool_and(near).alias("stable"))


def beat_interval(gaps: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """(keys, beat): median of the gaps that look like one beat, else the expected beat.

    ``gaps`` has one row per onset with ``gap`` (null for the first) and the
    expected beat length of its song.
    """
    keys = list(keys)
    songs = gaps.groupBy(*keys).agg(F.max(expected).alias("_exp"))
    single = gaps.where(
        (F.col("gap") >= F.lit(BEAT_LOW) * F.col(expected)) & (F.col("gap") <= F.lit(BEAT_HIGH) * F.col(expected))
    )
    found = medians(single, keys, "gap", "_beat").select(*keys, "_beat")
    return songs.join(found, keys, "left").select(*keys, F.coalesce("_beat", "_exp").alias("beat"))


def phases_stable(gaps: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """(keys, beat, stable): whether the beat resumes on its grid after every pause."""
    beats = beat_interval(gaps, keys, expected)
    b = F.col("beat")
    away = F.abs(F.col("gap") - F.rint(F.col("gap") / b) * b)
    off = (F.col("gap") > MIN_PAUSE_BEATS * b) & (away > PHASE_TOLERANCE * b) & (b > 0)
    return gaps.join(beats, list(keys)).groupBy(*keys, "beat").agg(
        (~F.bool_or(F.coalesce(off, F.lit(False)))).alias("stable")
    )


# ---- summaries -----------------------------------------------------------------------


def weighted_pitch(df: DataFrame, keys: Sequence[str], pitch: str, weight: Column) -> DataFrame:
    """(keys, pitch): rounded mean weighted by loudness and confidence."""
    w = F.greatest(F.lit(MIN_WEIGHT), weight)
    return df.groupBy(*keys).agg(half_even(F.sum(F.col(pitch) * w) / F.sum(w)).alias("pitch"))


def verse_summary(
    notes: DataFrame, keys: Sequence[str], verse: str, start: str, end: str, pitch: str, confidence: str
) -> DataFrame:
    """Notes, span, pitch range and mean confidence per verse and per song.

    Verses are summed up first, then copied to both levels, so that the second
    grouping sees verses instead of notes. Song rows have a null verse.
    """
    verses = notes.groupBy(*keys, verse).agg(
        F.count(F.lit(1)).alias("notes"),
        F.min(start).alias("_from"),
        F.max(end).alias("_to"),
        F.min(pitch).alias("low"),
        F.max(pitch).alias("high"),
        F.sum(confidence).alias("_conf"),
    )
    levels = F.explode(F.array(F.col(verse).cast("long"), F.lit(None).cast("long")))
    return (
        verses.withColumn("_level", levels)
        .groupBy(*keys, F.col("_level").alias(verse))
        .agg(
            F.sum("notes").alias("notes"),
            (F.max("_to") - F.min("_from")).alias("span"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            (F.sum("_conf") / F.sum("notes")).alias("mean_confidence"),
        )
    )


def coverage(df: DataFrame, keys: Sequence[str], source: str, is_break: Column, syllable: str) -> DataFrame:
    """Aligned and interpolated words, syllables, notes and breaks per key."""
    word = F.col(source).isNotNull()
    aligned = F.col(source) == ALIGNED
    return df.groupBy(*keys).agg(
        F.count_if(word & aligned).alias("aligned"),
        F.count_if(word & ~aligned).alias("interpolated"),
        (100.0 * F.count_if(word & aligned) / F.greatest(F.count_if(word), F.lit(1))).alias("aligned_pct"),
        F.count_if(~is_break & (F.col(syllable) != "")).alias("syllables"),
        F.count_if(~is_break).alias("notes"),
        F.count_if(is_break).alias("breaks"),
    )


def dist_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, mean, population deviation, extremes and distance of the mean from the overall mean."""
    keys = list(keys)
    basic = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    # The overall mean is one row; it meets every key through a constant.
    overall = df.agg(F.avg(value).alias("_overall")).withColumn("_one", F.lit(1))
    mid = medians(df, keys, value).select(*keys, "median")
    rows = basic.join(mid, keys).withColumn("_one", F.lit(1)).join(F.broadcast(overall), "_one")
    return rows.withColumn("deviation", F.col("mean") - F.col("_overall")).drop("_overall", "_one")


def cut_points(
    pauses: DataFrame, keys: Sequence[str], start: str, end: str, duration: str, min_pause: float
) -> DataFrame:
    """Distinct (keys, cut): middles of the pauses strictly longer than ``min_pause``."""
    s, e, d = F.col(start), F.col(end), F.col(duration)
    cut = (F.greatest(F.lit(0.0), s) + F.least(d, e)) / 2
    kept = pauses.where((e - s > F.lit(min_pause)) & (e > 0) & (s < d)).withColumn("cut", cut)
    return kept.where((F.col("cut") > 0) & (F.col("cut") < d)).select(*keys, "cut").distinct()


def unaligned_ends(df: DataFrame, keys: Sequence[str], order: str, token: str, used: Column) -> DataFrame:
    """(keys, before, after): the stripped text outside the first and last used position.

    All text counts as before when nothing is used. Longer texts are clipped with
    ``...``; only the tokens inside the clip are gathered. ``order`` is dense.
    """
    keys = list(keys)
    pos, blank = F.col(order), strip(F.col(token)) == ""
    span = df.groupBy(*keys).agg(F.min(F.when(used, pos)).alias("_lo"), F.max(F.when(used, pos)).alias("_hi"))
    side = F.when(F.col("_lo").isNull() | (pos < F.col("_lo")), "before").when(pos > F.col("_hi"), "after")
    rows = df.join(span, keys).withColumn("_side", side).where("_side IS NOT NULL").drop("_lo", "_hi")
    ends = rows.where(~blank).groupBy(*keys, "_side").agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    shown = rows.join(ends, [*keys, "_side"]).where(
        (pos >= F.col("_a")) & (pos <= F.least(F.col("_b"), F.col("_a") + CLIP_CHARS))
    )
    texts = shown.groupBy(*keys, "_side").agg(
        F.expr(f"listagg({token}, '') WITHIN GROUP (ORDER BY {order})").alias("_t")
    )
    clipped = F.when(
        F.length("_t") > CLIP_CHARS, F.concat(F.substring("_t", 1, CLIP_CHARS), F.lit("..."))
    ).otherwise(F.col("_t"))

    def of(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_side") == name, clipped)), F.lit("")).alias(name)

    found = texts.groupBy(*keys).agg(of("before"), of("after"))
    empty = F.lit("")
    return span.select(*keys).join(found, keys, "left").select(
        *keys, F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after")
    )


def overhang(frames: DataFrame, keys: Sequence[str], at: str, end: str, voiced: Column) -> DataFrame:
    """(keys, overhang): how far the last voiced frame of a word lies past its end."""
    last = F.coalesce(F.max(F.when(voiced, F.col(at))), F.lit(0.0))
    return frames.groupBy(*keys).agg((last - F.max(end)).alias("overhang"))


def longest_run(words: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """(keys, run, word_count, runs): the run with most words, the first on a tie."""
    per = words.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(
        F.max_by(run, F.struct("_n", -F.col(run))).alias(run),
        F.max("_n").alias("word_count"),
        F.count(F.lit(1)).alias("runs"),
    )
