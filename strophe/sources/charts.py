"""Reading and writing chart text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.text import SPACE, let, strip

# The line formats of a chart.
NOTE_LINE = r"(?s)^\s*([:*F])\s+(-?\d+)\s+(\d+)\s+(-?\d+)(?: (.*))?$"
NOTE_FIELDS = r"(?s)^(-?\d+)\s+(\d+)\s+(-?\d+)(?: (.*))?$"
WHOLE_NUMBER = r"^[+-]?\d+(_\d+)*$"

# Code points that Windows-1252 puts at bytes 80 to 9F; the five
# missing bytes are undefined there.
CP1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020,
    0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152,
    0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A,
    0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}

# Defaults of the two required numbers.
DEFAULT_BPM, DEFAULT_GAP = 120.0, 0


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 without its mark, else Windows-1252, else Latin-1."""
    utf8 = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    undefined = F.regexp_like(latin, F.lit(r"[\x81\x8d\x8f\x90\x9d]"))
    western = F.translate(latin, "".join(map(chr, CP1252)), "".join(map(chr, CP1252.values())))
    return (
        F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "^﻿", ""))
        .when(undefined, latin)
        .otherwise(western)
    )


def read_corpus(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """corpus(path, modified, text): every matching file below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return files.select(
        "path", F.col("modificationTime").alias("modified"), decode_text(F.col("content")).alias("text")
    )


def text_lines(text: Column) -> Column:
    """The lines of a text, as they stand."""
    return F.split(text, "\n")


# ---- single lines --------------------------------------------------------------


MARK = "\x01"


def _fields(x: Column, pattern: str, groups: int) -> Column:
    """The groups of a match as an array with one empty cell in front, null without a match."""
    shown = "".join(f"{MARK}${g}" for g in range(1, groups + 1))
    marked = F.regexp_replace(x, pattern, shown)
    hit = F.startswith(marked, F.lit(MARK)) & ~F.startswith(x, F.lit(MARK))
    return F.when(hit, F.split(marked, MARK, groups + 1))


def _note(kind: Column, beat: Column, duration: Column, pitch: Column, syllable: Column) -> Column:
    return F.struct(
        kind.alias("note_type"),
        beat.try_cast("long").alias("start_beat"),
        duration.try_cast("long").alias("duration"),
        pitch.try_cast("int").alias("pitch"),
        syllable.alias("syllable"),
    )


def _rest(dashed: Column) -> Column:
    """A rest, or the sung note hidden in a damaged rest line; null if unreadable."""

    def plain(beat: Column) -> Column:
        ok = F.regexp_like(beat, F.lit(WHOLE_NUMBER))
        number = F.replace(beat, F.lit("_"), F.lit(""))
        return F.when(ok, _note(F.lit("-"), number, F.lit(0), F.lit(0), F.lit("")))

    def split_at_colon(after: Column) -> Column:
        colon = F.position(F.lit(":"), after)
        head = strip(F.substring(after, F.lit(1), colon - 1))
        tail = strip(F.substring(after, colon + 1, F.length(after)))
        first = F.regexp_extract(after, r"^([^\s\x1c-\x1f\x85\p{Z}]*)", 1)
        found = let(
            _fields(tail, NOTE_FIELDS, 4),
            lambda m: F.when(m.isNotNull(), _note(F.lit(":"), m[1], m[2], m[3], m[4])),
        )
        return F.when(colon > 0, F.coalesce(found, plain(head))).otherwise(plain(first))

    return let(strip(F.substring(dashed, F.lit(2), F.length(dashed))), split_at_colon)


def parse_line(line: Column) -> Column:
    """The note or rest on one line as a struct, null for headers and anything else."""

    def read(trimmed: Column) -> Column:
        note = let(
            _fields(F.regexp_replace(line, "\r+$", ""), NOTE_LINE, 5),
            lambda m: F.when(m.isNotNull(), _note(m[1], m[2], m[3], m[4], m[5])),
        )
        rest = F.when(F.startswith(trimmed, F.lit("-")), _rest(trimmed))
        return F.when(~F.startswith(trimmed, F.lit("#")), F.coalesce(note, rest))

    return let(strip(line), read)


def parse_strict_line(line: Column) -> Column:
    """The lenient second reader's view of a line.

    A note needs all four fields, the last being the rest of the line; a rest
    only ends a verse. Null for anything else.
    """
    body = F.substring(line, F.lit(2), F.length(line))
    four = r"(?s)^\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S.*)$"
    first = F.substring(line, 1, 1)
    number = [F.regexp_extract(body, four, g) for g in range(1, 5)]
    note = F.struct(
        F.lit(False).alias("is_rest"),
        (first == "*").alias("golden"),
        number[0].try_cast("double").alias("beat"),
        number[1].try_cast("double").alias("length"),
        number[2].try_cast("int").alias("pitch"),
        F.regexp_replace(number[3], r"[\r\n]+$", "").alias("syllable"),
    )
    rest = F.struct(
        F.lit(True).alias("is_rest"),
        F.lit(False).alias("golden"),
        F.lit(None).cast("double").alias("beat"),
        F.lit(None).cast("double").alias("length"),
        F.lit(None).cast("int").alias("pitch"),
        F.lit("").alias("syllable"),
    )
    sung = first.isin(":", "*", "F") & F.regexp_like(body, F.lit(four))
    return F.when(sung, note).when(first == "-", rest)


# ---- whole files ----------------------------------------------------------------


def parse_notes(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Notes of every file with a dense ``note_idx``. No shuffle: a file is one row."""
    others = [c for c in corpus.columns if c != text]
    found = F.filter(F.transform(text_lines(F.col(text)), parse_line), lambda n: n.isNotNull())
    rows = corpus.select(*others, F.posexplode(found).alias("note_idx", "_n"))
    return rows.select(*others, F.col("note_idx").cast("long").alias("note_idx"), "_n.*")


def parse_strict(corpus: DataFrame, bpm: str, gap: str, text: str = "text") -> DataFrame:
    """Notes of the lenient second reader, timed in ms and numbered by verse.

    Verses end at rests; empty verses are not counted.
    """
    others = [c for c in corpus.columns if c not in (text, bpm, gap)]
    found = F.filter(
        F.transform(F.split(F.col(text), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), parse_strict_line),
        lambda n: n.isNotNull(),
    )
    # A verse starts at each note that is first in the file or follows a rest.
    numbered = F.aggregate(
        found,
        F.struct(F.lit(0).alias("verse"), F.lit(True).alias("open"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct(
            F.when(~n["is_rest"] & acc["open"], acc["verse"] + 1).otherwise(acc["verse"]).alias("verse"),
            n["is_rest"].alias("open"),
            F.concat(
                acc["out"],
                F.array(F.when(~n["is_rest"] & acc["open"], acc["verse"] + 1).otherwise(acc["verse"])),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    both = F.filter(
        F.arrays_zip(found.alias("n"), numbered.alias("v")), lambda x: ~x["n"]["is_rest"]
    )
    rows = corpus.select(*others, bpm, gap, F.posexplode(both).alias("note_idx", "_x"))
    beat = F.lit(60000.0) / F.col(bpm) / 4
    return rows.select(
        *others,
        F.col("note_idx").cast("long").alias("note_idx"),
        (F.col("_x.v") - 1).cast("long").alias("verse"),
        (F.col(gap) + F.col("_x.n.beat") * beat).alias("start_ms"),
        (F.col("_x.n.length") * beat).alias("length_ms"),
        F.col("_x.n.pitch").alias("pitch"),
        F.col("_x.n.syllable").alias("syllable"),
        F.col("_x.n.golden").alias("golden"),
    )


def header_tags(text: Column) -> Column:
    """All header lines as a map; keys in upper case, the last line of a key stands."""
    heads = F.filter(
        F.transform(text_lines(text), strip),
        lambda x: F.startswith(x, F.lit("#")) & (F.locate(":", x) > 1),
    )
    entries = F.transform(
        heads,
        lambda x: let(
            F.locate(":", x),
            lambda at: F.struct(
                F.upper(F.substring(x, F.lit(2), at - 2)).alias("k"),
                strip(F.substring(x, at + 1, F.length(x))).alias("v"),
            ),
        ),
    )

    def last_wins(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda e: e["k"]))
        values = F.transform(names, lambda k: F.element_at(F.filter(found, lambda e: e["k"] == k), -1)["v"])
        return F.map_from_arrays(names, values)

    return let(entries, last_wins)


def _number(value: Column) -> Column:
    """A finite number, or null: no suffix such as ``120d``, no NaN and no infinity."""
    dotted = F.replace(value, F.lit(","), F.lit("."))
    plain = dotted.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    number = F.when(plain, dotted.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def song_row(tags: Column) -> list[Column]:
    """Typed song columns from a map of header tags; unreadable numbers are null."""

    def tag(name: str) -> Column:
        return F.try_element_at(tags, F.lit(name))

    def whole(name: str) -> Column:
        return _number(tag(name)).try_cast("long")

    return [
        F.coalesce(tag("TITLE"), F.lit("")).alias("title"),
        F.coalesce(tag("ARTIST"), F.lit("")).alias("artist"),
        F.coalesce(tag("MP3"), F.lit("")).alias("mp3"),
        F.when(tag("BPM").isNull(), DEFAULT_BPM).otherwise(_number(tag("BPM"))).alias("bpm"),
        F.when(tag("GAP").isNull(), F.lit(DEFAULT_GAP).cast("long")).otherwise(whole("GAP")).alias("gap"),
        tag("VIDEO").alias("video"),
        tag("VOCALS").alias("vocals"),
        tag("INSTRUMENTAL").alias("instrumental"),
        tag("COVER").alias("cover"),
        tag("CREATOR").alias("creator"),
        _number(tag("START")).alias("start"),
        whole("END").alias("end_ms"),
        whole("MEDLEYSTARTBEAT").alias("medley_start_beat"),
        whole("MEDLEYENDBEAT").alias("medley_end_beat"),
        _number(tag("PREVIEWSTART")).alias("preview_start"),
    ]


def parse_songs(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One typed song row per file, with the full tag map in ``tags``."""
    others = [c for c in corpus.columns if c != text]
    tagged = corpus.select(*others, header_tags(F.col(text)).alias("tags"))
    return tagged.select(*others, *song_row(F.col("tags")), "tags")


def raw_header(text: Column) -> Column:
    """The leading ``#`` lines exactly as they stand, line ends unified."""
    rows = text_lines(F.regexp_replace(text, "\r\n|\r", "\n"))
    stops = F.array_position(F.transform(rows, lambda x: F.startswith(strip(x), F.lit("#"))), False)
    return F.when(stops == 0, rows).otherwise(F.slice(rows, 1, F.greatest(stops - 1, F.lit(0)).cast("int")))


# ---- writing ---------------------------------------------------------------------


def _decimals(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def header_lines(songs: DataFrame) -> Column:
    """The header of a song as an array of lines; missing optional tags leave no line.

    Uses the columns that ``songs`` has; only title, artist, mp3, bpm and gap are needed.
    """
    have = set(songs.columns)

    def text_tag(tag: str, name: str, required: bool = False) -> Column:
        if name not in have:
            return F.lit(None).cast("string")
        value = F.concat(F.lit(f"#{tag}:"), F.col(name).cast("string"))
        return value if required else F.when(F.col(name) != "", value)

    def number_tag(tag: str, name: str, shown: Column) -> Column:
        if name not in have:
            return F.lit(None).cast("string")
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f"#{tag}:"), shown))

    lines = [
        text_tag("TITLE", "title", True),
        text_tag("ARTIST", "artist", True),
        text_tag("CREATOR", "creator"),
        text_tag("MP3", "mp3", True),
        text_tag("COVER", "cover"),
        text_tag("VIDEO", "video"),
        text_tag("VOCALS", "vocals"),
        text_tag("INSTRUMENTAL", "instrumental"),
        F.concat(F.lit("#BPM:"), _decimals(F.col("bpm").cast("double"), 2)),
        F.concat(F.lit("#GAP:"), F.rint(F.col("gap")).cast("long").cast("string")),
        number_tag("START", "start", _decimals(F.col("start"), 1)) if "start" in have else F.lit(None),
        number_tag("END", "end_ms", F.col("end_ms").cast("string")) if "end_ms" in have else F.lit(None),
        number_tag("MEDLEYSTARTBEAT", "medley_start_beat", F.col("medley_start_beat").cast("string"))
        if "medley_start_beat" in have
        else F.lit(None),
        number_tag("MEDLEYENDBEAT", "medley_end_beat", F.col("medley_end_beat").cast("string"))
        if "medley_end_beat" in have
        else F.lit(None),
        number_tag(
            "PREVIEWSTART",
            "preview_start",
            F.replace(_decimals(F.col("preview_start"), 2), F.lit("."), F.lit(",")),
        )
        if "preview_start" in have
        else F.lit(None),
    ]
    return F.filter(F.array(*[x.cast("string") for x in lines]), lambda x: x.isNotNull())


def note_line(note_type="note_type", beat="start_beat", duration="duration", pitch="pitch", syllable="syllable") -> Column:
    """One body line."""
    sung = F.concat_ws(
        " ", note_type, F.col(beat).cast("string"), F.col(duration).cast("string"),
        F.col(pitch).cast("string"), F.coalesce(F.col(syllable), F.lit("")),
    )
    return F.when(F.col(note_type) == "-", F.concat(F.lit("- "), F.col(beat).cast("string"))).otherwise(sung)


def render(
    headers: DataFrame, notes: DataFrame, keys: Sequence[str], header: str, ordinal: str
) -> DataFrame:
    """The lines of each chart: (keys, section, ord, line).

    ``headers`` holds one array of header lines per key. Sections: 0 header,
    1 the blank line, 2 body, 3 the closing ``E``. Lines stay rows, so a chart
    of any length can be written.
    """
    keys = list(keys)
    top = headers.select(*keys, F.lit(0).alias("section"), F.posexplode(header).alias("ord", "line"))
    closing = headers.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("section"), F.lit(0).alias("ord"), F.lit("").alias("line")),
                F.struct(F.lit(3).alias("section"), F.lit(0).alias("ord"), F.lit("E").alias("line")),
            )
        ),
    )
    body = notes.select(
        *keys, F.lit(2).alias("section"), F.col(ordinal).cast("long").alias("ord"), note_line().alias("line")
    )
    return (
        top.withColumn("ord", F.col("ord").cast("long"))
        .unionByName(closing.withColumn("ord", F.col("ord").cast("long")))
        .unionByName(body)
    )


def write_lines(lines: DataFrame, key: str, order: Sequence[str], path: str) -> None:
    """Write one folder per key with the ordered lines of its file."""
    ordered = lines.repartition(key).sortWithinPartitions(key, *order)
    ordered.select(key, "line").write.mode("overwrite").partitionBy(key).text(path)


__all__ = [
    "SPACE", "decode_text", "header_lines", "header_tags", "note_line", "parse_line", "parse_notes",
    "parse_songs", "parse_strict", "raw_header", "read_corpus", "render", "song_row", "text_lines",
    "write_lines",
]
