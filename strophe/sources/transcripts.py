"""Transcription documents: nested JSON in, flat tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "time DOUBLE, midi INT, confidence DOUBLE, amplitude DOUBLE"
CHARACTER = "char STRING, start DOUBLE, end DOUBLE, score DOUBLE"


def _struct(fields: str) -> str:
    return "STRUCT<" + ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(",")) + ">"


WORD_STRUCT = (
    "STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, midi: INT, "
    f"pitch_frames: ARRAY<{_struct(FRAME)}>, characters: ARRAY<{_struct(CHARACTER)}>>"
)
DOCUMENT = (
    f"song BIGINT, words ARRAY<{WORD_STRUCT}>, language STRING, vocals_path STRING, "
    f"accompaniment_path STRING, pauses ARRAY<STRUCT<start: DOUBLE, end: DOUBLE>>, "
    f"pitch_frames ARRAY<{_struct(FRAME)}>, bpm DOUBLE, "
    "bpm_result STRUCT<bpm: DOUBLE, first_beat_ms: DOUBLE, stable: BOOLEAN, chunk_bpms: ARRAY<DOUBLE>>"
)
OVERLAY_WORD = (
    "STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, midi: INT, "
    f"pitchFrames: ARRAY<{_struct(FRAME)}>>"
)
OVERLAY = f"words ARRAY<{OVERLAY_WORD}>"


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transcription documents with an explicit schema; missing lists become empty.

    One document per file with ``multi_line``, else one per line.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", str(multi_line).lower()).json(path)
    return with_defaults(docs)


def with_defaults(docs: DataFrame) -> DataFrame:
    """Fill missing nested lists and the amplitude of old frames."""

    def some(name: str) -> Column:
        return F.coalesce(F.col(name), F.array())

    def frames(xs: Column) -> Column:
        return F.transform(
            xs,
            lambda f: F.struct(
                f["time"].alias("time"),
                f["midi"].alias("midi"),
                f["confidence"].alias("confidence"),
                F.coalesce(f["amplitude"], F.lit(0.0)).alias("amplitude"),
            ),
        )

    words = F.transform(
        F.coalesce("words", F.array().cast(f"array<{WORD_STRUCT}>")),
        lambda w: F.struct(
            w["word"].alias("word"),
            w["start"].alias("start"),
            w["end"].alias("end"),
            w["midi"].alias("midi"),
            frames(F.coalesce(w["pitch_frames"], F.array().cast(f"array<{_struct(FRAME)}>"))).alias("pitch_frames"),
            F.coalesce(w["characters"], F.array().cast(f"array<{_struct(CHARACTER)}>")).alias("characters"),
        ),
    )
    return (
        docs.withColumn("words", words)
        .withColumn("pauses", F.coalesce("pauses", F.array().cast("array<struct<start:double,end:double>>")))
        .withColumn(
            "pitch_frames", frames(F.coalesce("pitch_frames", F.array().cast(f"array<{_struct(FRAME)}>")))
        )
    )


def document_words(docs: DataFrame) -> DataFrame:
    """words(song, word_idx, word, start, end, midi, characters)."""
    rows = docs.select("song", F.posexplode("words").alias("word_idx", "_w"))
    return rows.select(
        "song", F.col("word_idx").cast("long").alias("word_idx"),
        "_w.word", "_w.start", "_w.end", "_w.midi", "_w.characters",
    )


def recover_frames(
    frames: DataFrame, keys: Sequence[str], time: str, order: Sequence[str]
) -> DataFrame:
    """One frame per time, the one latest in ``order`` standing.

    Used where a document holds frames only inside its words. The pre-aggregation
    combines copies before the shuffle.
    """
    rest = [c for c in frames.columns if c not in (*keys, time)]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_f")
    return frames.groupBy(*keys, time).agg(last).select(*keys, time, "_f.*")


def all_frames(docs: DataFrame) -> DataFrame:
    """frames(song, time, midi, confidence, amplitude) of documents of either age.

    The global timeline where there is one, otherwise rebuilt from the words.
    """
    new = docs.where(F.size("pitch_frames") > 0).select("song", F.inline("pitch_frames"))
    old = docs.where(F.size("pitch_frames") == 0).select("song", F.posexplode("words").alias("_i", "_w"))
    nested = old.select("song", "_i", F.posexplode("_w.pitch_frames").alias("_j", "_f")).select(
        "song", "_i", "_j", "_f.*"
    )
    rebuilt = recover_frames(nested, ["song"], "time", ["_i", "_j"]).drop("_i", "_j")
    return new.unionByName(rebuilt)


def pitch_overlay(doc: Column) -> Column:
    """Words of a pitch document (JSON text), times in ms and missing values as 0."""
    words = F.from_json(doc, OVERLAY)["words"]

    def ms(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0)) * 1000.0

    return F.transform(
        F.coalesce(words, F.array().cast(f"array<{OVERLAY_WORD}>")),
        lambda w: F.struct(
            F.coalesce(w["word"], F.lit("")).alias("word"),
            ms(w["start"]).alias("start_ms"),
            ms(w["end"]).alias("end_ms"),
            F.coalesce(w["midi"], F.lit(0)).alias("midi"),
            F.transform(
                F.coalesce(w["pitchFrames"], F.array().cast(f"array<{_struct(FRAME)}>")),
                lambda f: F.struct(
                    ms(f["time"]).alias("t_ms"),
                    F.coalesce(f["midi"], F.lit(0)).alias("m"),
                    F.coalesce(f["confidence"], F.lit(0.0)).alias("conf"),
                    F.coalesce(f["amplitude"], F.lit(0.0)).alias("amp"),
                ),
            ).alias("frames"),
        ),
    )


def dump_runs(words: DataFrame, keys: Sequence[str], order: str, word: str) -> DataFrame:
    """One row per run: word count and the joined text."""
    return words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("word_count"),
        F.expr(f"listagg({word}, ' ') WITHIN GROUP (ORDER BY {order})").alias("text"),
    )
