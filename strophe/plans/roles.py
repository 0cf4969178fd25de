"""The given tables in the roles of notes, frames, lines and runs.

Each role is a DataFrame function and, for the checks, the same definition as
a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.text import lyric_lines, words_of
from strophe.operators.scan import position, run_sum, scan
from strophe.plans.registry import table

DAY = 86400.0


def seconds(ts: str) -> Column:
    """A timestamp column as epoch seconds."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


# ---- notes: lineitem, one song per supplier ---------------------------------

NOTES_SQL = """
raw AS (
  SELECT l_suppkey AS song, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
         CAST(l_quantity * 100 AS BIGINT) AS len_ms,
         CAST(CASE WHEN l_partkey % 50 = 0 THEN 2500 ELSE (l_partkey % 7) * 60 END AS BIGINT) AS rest_ms,
         CAST(48 + l_partkey % 25 AS INTEGER) AS pitch,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '*'
              WHEN l_tax > 0.075 THEN 'F' ELSE ':' END AS note_type,
         CASE l_partkey % 6 WHEN 0 THEN '~' WHEN 1 THEN ' ' || lower(l_returnflag)
              WHEN 2 THEN lower(l_linestatus) || ' ' WHEN 3 THEN ''
              ELSE lower(l_returnflag || l_linestatus) END AS syllable
  FROM lineitem),
notes AS (
  SELECT song, row_number() OVER w - 1 AS idx, len_ms, pitch, note_type, syllable,
         CAST(sum(len_ms + rest_ms) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - len_ms - rest_ms AS start_ms,
         CAST(sum(len_ms + rest_ms) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - rest_ms AS end_ms
  FROM raw
  WINDOW w AS (PARTITION BY song ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice))
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes(song, idx, len_ms, pitch, note_type, syllable, start_ms, end_ms)."""
    part = F.col("l_partkey")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("song"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        (F.col("l_quantity") * 100).cast("long").alias("len_ms"),
        F.when(part % 50 == 0, 2500).otherwise((part % 7) * 60).cast("long").alias("rest_ms"),
        (48 + part % 25).cast("int").alias("pitch"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "*")
        .when(F.col("l_tax") > 0.075, "F")
        .otherwise(":")
        .alias("note_type"),
        F.when(part % 6 == 0, "~")
        .when(part % 6 == 1, F.concat(F.lit(" "), F.lower("l_returnflag")))
        .when(part % 6 == 2, F.concat(F.lower("l_linestatus"), F.lit(" ")))
        .when(part % 6 == 3, "")
        .otherwise(F.lower(F.concat("l_returnflag", "l_linestatus")))
        .alias("syllable"),
    )
    placed = scan(
        raw,
        ["song"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        F.floor(F.col("l_orderkey") / 8192),
        nth=position(),
        total=run_sum(F.col("len_ms") + F.col("rest_ms")),
    )
    return placed.select(
        "song",
        (F.col("nth") - 1).alias("idx"),
        "len_ms",
        "pitch",
        "note_type",
        "syllable",
        (F.col("total") - F.col("len_ms") - F.col("rest_ms")).alias("start_ms"),
        (F.col("total") - F.col("rest_ms")).alias("end_ms"),
    )


# Sung rows with a break row after every fourth note; ``pos`` is dense.
SUNG_SQL = (
    NOTES_SQL
    + """,
sung AS (
  SELECT song, idx + idx // 4 AS pos, FALSE AS is_break, note_type, syllable, pitch, start_ms, end_ms FROM notes
  UNION ALL
  SELECT song, idx + idx // 4 + 1, TRUE, '-', '', 0, end_ms, end_ms FROM notes WHERE idx % 4 = 3)
"""
)


def sung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sung(song, pos, is_break, note_type, syllable, pitch, start_ms, end_ms)."""
    rows = notes(spark, sf_dir).withColumn(
        "extra",
        F.explode(F.when(F.col("idx") % 4 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    brk = F.col("extra") == 1
    return rows.select(
        "song",
        (F.col("idx") + F.floor(F.col("idx") / 4) + F.col("extra")).alias("pos"),
        brk.alias("is_break"),
        F.when(brk, "-").otherwise(F.col("note_type")).alias("note_type"),
        F.when(brk, "").otherwise(F.col("syllable")).alias("syllable"),
        F.when(brk, 0).otherwise(F.col("pitch")).alias("pitch"),
        F.when(brk, F.col("end_ms")).otherwise(F.col("start_ms")).alias("start_ms"),
        "end_ms",
    )


# Chart rows on the beat grid of 10 beats a second, the input of chart tools.
CHART_SQL = (
    SUNG_SQL
    + """,
chart AS (
  SELECT song, pos, note_type, start_ms // 100 AS start_beat,
         CASE WHEN is_break THEN 0 ELSE greatest(1, end_ms // 100 - start_ms // 100) END AS duration,
         pitch, syllable FROM sung)
"""
)


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart(song, pos, note_type, start_beat, duration, pitch, syllable)."""
    first, last = F.floor(F.col("start_ms") / 100), F.floor(F.col("end_ms") / 100)
    return sung(spark, sf_dir).select(
        "song",
        "pos",
        "note_type",
        first.alias("start_beat"),
        F.when(F.col("is_break"), F.lit(0).cast("long"))
        .otherwise(F.greatest(F.lit(1).cast("long"), last - first))
        .alias("duration"),
        "pitch",
        "syllable",
    )


# ---- frames: events, one song per user ---------------------------------------

FRAMES_SQL = """
frames AS (
  SELECT user_id AS song, event_id AS id, epoch_us(ts) / 1000000.0 AS t, event_type AS kind, value AS amp,
         (event_id % 100) / 100.0 AS conf,
         CAST(36 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 48 AS INTEGER) AS midi
  FROM events)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(song, id, t seconds, kind, amp, conf, midi)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("song"),
        F.col("event_id").alias("id"),
        seconds("ts").alias("t"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("amp"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("conf"),
        (36 + F.get_json_object("props", "$.k").cast("int") % 48).cast("int").alias("midi"),
    )


def day_block(t: str = "t") -> Column:
    """A block a day, for frames ordered by time."""
    return F.floor(F.col(t) / DAY)


FRAME_ORDER = ["t", "id"]

# Frames with a dense ordinal.
FRAMES_N_SQL = (
    FRAMES_SQL
    + """,
framesn AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY t, id) - 1 AS n FROM frames)
"""
)


def numbered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with ``n``, their dense 0-based position in the song."""
    rows = scan(frames(spark, sf_dir), ["song"], FRAME_ORDER, day_block(), n=position())
    return rows.withColumn("n", F.col("n") - 1)


# ---- text --------------------------------------------------------------------

LINES_SQL = r"""
lines AS (
  SELECT doc_id AS song, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_no, line
  FROM (SELECT doc_id, k, trim(parts[k], E' \t\n\r') AS line
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
  WHERE line <> '')
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines(song, line_no, line): the non-blank trimmed lines of each document."""
    return lyric_lines(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song"), "text"), "text"
    )


WORDS_SQL = r"""
words AS (
  SELECT conv_id AS song, turn AS run, k - 1 AS pos, parts[k] AS word
  FROM (SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS k
        FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS parts
              FROM conversations)))
"""


def run_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words(song, run, pos, word): the words of each turn as a transcription run."""
    base = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("song"), F.col("turn").alias("run"), F.col("text")
    )
    return base.select("song", "run", F.posexplode(words_of(F.col("text"))).alias("pos", "word")).withColumn(
        "pos", F.col("pos").cast("long")
    )


TIMED_SQL = (
    WORDS_SQL
    + """,
timed AS (SELECT song, run, pos, word, pos * 400 + (song * 7 + run * 13 + pos * 31) % 120 AS start_ms,
          pos * 400 + (song * 7 + run * 13 + pos * 31) % 120 + 150 + length(word) * 20 AS end_ms,
          ((song * 11 + run * 17 + pos * 5) % 100) / 100.0 AS score FROM words)
"""
)


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run words with a start, an end (ms) and a score derived from their place."""
    s, r, p = F.col("song"), F.col("run"), F.col("pos")
    start = p * 400 + (s * 7 + r * 13 + p * 31) % 120
    return run_words(spark, sf_dir).select(
        "song",
        "run",
        "pos",
        "word",
        start.alias("start_ms"),
        (start + 150 + F.length("word") * 20).cast("long").alias("end_ms"),
        (((s * 11 + r * 17 + p * 5) % 100) / F.lit(100.0)).alias("score"),
    )

