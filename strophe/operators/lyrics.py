"""Lyrics from notes, repeated lines and blocks, rows for the editor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions import music
from strophe.functions.text import strip
from strophe.operators.scan import halo, ordinal_block, position, prev_seen, run_sum, scan
from strophe.session import stage

LYRICS_SQL = """,
kept AS (SELECT song, pos, line, syllable, lag(syllable) OVER (PARTITION BY song, line ORDER BY pos) AS prev FROM
   (SELECT *, sum(CASE WHEN is_break THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY pos) AS line FROM sung) WHERE NOT is_break AND trim(syllable) NOT IN ('', '~')),
worded AS (SELECT *, sum(CASE WHEN prev IS NULL OR syllable LIKE ' %' OR prev LIKE '% ' THEN 1 ELSE 0 END) OVER (PARTITION BY song, line ORDER BY pos) AS word FROM kept),
lyric AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY line) - 1 AS line_no, string_agg(w, ' ' ORDER BY word) AS text
  FROM (SELECT song, line, word, string_agg(trim(syllable), '' ORDER BY pos) AS w FROM worded GROUP BY song, line, word) GROUP BY song, line)
"""


def reassemble(
    notes: DataFrame, keys: Sequence[str], ordinal: str, note_type: str, syllable: str
) -> DataFrame:
    """lyric lines(keys, line_no, text) put together from note syllables.

    A leading space starts a word, a trailing space ends one, rests end lines;
    ``~`` and empty syllables are skipped and empty lines vanish.
    """
    keys = list(keys)
    is_rest = F.col(note_type) == "-"
    core = strip(F.col(syllable))
    kept = ~is_rest & ~core.isin("", "~")
    mark = F.when(kept, F.struct(F.col(syllable).alias("s")))
    # The line is a running count of rests, and the previous kept syllable counts
    # only if no rest lies between: both come from one scan.
    rows = scan(
        notes,
        keys,
        [ordinal],
        ordinal_block(ordinal),
        _line=run_sum(F.when(is_rest, 1).otherwise(0)),
        _prev=prev_seen(F.when(is_rest, F.struct(F.lit(None).cast("string").alias("s"))).otherwise(mark)),
    ).where(kept)
    prev = F.col("_prev.s")
    starts = prev.isNull() | F.startswith(F.col(syllable), F.lit(" ")) | F.endswith(prev, F.lit(" "))
    # Words are numbered inside a line; a line's text is gathered in one row anyway.
    one = F.struct(F.col(ordinal).alias("o"), starts.alias("starts"), core.alias("s"))
    lines = rows.groupBy(*keys, "_line").agg(F.array_sort(F.collect_list(one)).alias("_xs"))
    text = F.aggregate(
        "_xs",
        F.lit(""),
        lambda acc, x: F.concat(acc, F.when(x["starts"] & (acc != ""), " ").otherwise(""), x["s"]),
    )
    texts = lines.select(*keys, "_line", text.alias("text"))
    numbered = scan(texts, keys, ["_line"], ordinal_block("_line"), line_no=position())
    return numbered.select(*keys, (F.col("line_no") - 1).alias("line_no"), "text")


def editor_rows(notes: DataFrame, keys: Sequence[str], ordinal: str, bpm: str) -> DataFrame:
    """One JSON object per note for the editor, with the grid units of its song.

    Objects stay rows; written in order they form the note list of a document.
    Sung pitches are lifted to the lowest pitch shown.
    """
    pitch = F.when(F.col("note_type") == "-", F.col("pitch")).otherwise(music.lift_octaves("pitch"))
    note = F.to_json(
        F.struct(
            F.col(ordinal).alias("id"),
            F.col("note_type").alias("type"),
            F.col("start_beat").alias("start"),
            F.col("duration").alias("dur"),
            pitch.alias("pitch"),
            F.col("syllable").alias("syl"),
        )
    )
    return notes.select(
        *keys,
        F.col(ordinal).alias("id"),
        note.alias("note"),
        music.beat_ms(bpm).alias("beat_ms"),
        music.pulse_ms(bpm).alias("pulse_ms"),
    )


def repeated_lines(lines: DataFrame, keys: Sequence[str], key: str, ordinal: str) -> DataFrame:
    """Lines whose key occurs again in the song: how often, and where first.

    Counted per (song, key) with a partial aggregation, then joined back; the
    pairs of equal lines are never formed.
    """
    per = lines.groupBy(*keys, key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ordinal).alias("first_at")
    ).where("_n > 1")
    return lines.join(per, [*keys, key]).withColumn("repeats", F.col("_n") - 1).drop("_n")


def repeated_block(lines: DataFrame, keys: Sequence[str], line: str, ordinal: str) -> DataFrame:
    """(keys, first_line, last_line, times): the most often repeated block of lines.

    Most occurrences first, then the longer block, then the earlier one. A block
    has two lines or more, so the highest count C is that of a line pair; a
    block holds C occurrences exactly if each of its line triples does. It
    follows that the longest such block is the longest run of neighbouring
    triples with count C: counting and run lengths suffice, no line is compared
    with another. ``ordinal`` must be dense from 0.
    """
    keys = list(keys)
    # The place of its first occurrence stands for a line, so that its text goes no further.
    first = lines.groupBy(*keys, line).agg(F.min(ordinal).alias("_id"))
    numbered = lines.select(*keys, ordinal, line).join(first, [*keys, line], "left")
    line = "_id"
    ids = stage(
        halo(
            numbered.select(*keys, ordinal, line),
            keys,
            ordinal,
            2,
            {"_b": lambda w: F.lead(line, 1).over(w), "_c": lambda w: F.lead(line, 2).over(w)},
        )
    )
    pairs = ids.where("_b IS NOT NULL").withColumn("_p", F.struct(F.col(line).alias("x"), F.col("_b").alias("y")))
    long_enough = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 4").select(*keys)
    pair_counts = stage(
        pairs.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_cnt"), F.min(ordinal).alias("_at"))
        .where("_cnt >= 2")
    )
    best = (
        pair_counts.groupBy(*keys).agg(F.max("_cnt").alias("times")).join(long_enough, keys)
    )
    top_pairs = (
        pair_counts.join(best, keys).where("_cnt = times").groupBy(*keys, "times").agg(F.min("_at").alias("_at"))
    )
    # Triples with the full count, in runs of neighbouring places.
    triples = pairs.where("_c IS NOT NULL")
    triple_counts = triples.groupBy(*keys, line, "_b", "_c").agg(F.count(F.lit(1)).alias("_tc"))
    full = (
        triples.select(*keys, ordinal, line, "_b", "_c")
        .join(triple_counts.join(best, keys).where("_tc = times").select(*keys, line, "_b", "_c"), [*keys, line, "_b", "_c"])
        .select(*keys, ordinal)
    )
    runs = scan(full, keys, [ordinal], ordinal_block(ordinal), _nth=position())
    spans = runs.groupBy(*keys, (F.col(ordinal) - F.col("_nth")).alias("_run")).agg(
        F.min(ordinal).alias("_from"), F.count(F.lit(1)).alias("_len")
    )
    longest = spans.groupBy(*keys).agg(
        F.max_by(F.struct("_from", "_len"), F.struct("_len", -F.col("_from"))).alias("_s")
    )
    out = top_pairs.join(longest, keys, "left")
    first = F.coalesce(F.col("_s._from"), F.col("_at")).cast("long")
    length = F.coalesce(F.col("_s._len"), F.lit(0)) + 2
    return out.select(
        *keys, first.alias("first_line"), (first + length - 1).alias("last_line"), F.col("times")
    )

