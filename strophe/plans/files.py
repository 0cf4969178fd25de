"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import lyrics as L
from strophe.operators import generate as G

from strophe.plans import roles
from strophe.plans.registry import query, table
from strophe.session import fresh_path, stage
from strophe.sources import charts, stages, transcripts

# One text line per lineitem row, in every shape the readers must cope with.
_LINES = """ln AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_linenumber AS n, l_partkey AS p,
   CASE l_partkey % 12 WHEN 0 THEN ': ' || l_linenumber || ' 4 60 la' WHEN 1 THEN '* ' || l_partkey || ' 3 -5  la '
     WHEN 2 THEN '  F 12 ' || l_linenumber || ' 61' WHEN 3 THEN '- ' || l_partkey WHEN 4 THEN '-' || l_partkey || ': ' || l_partkey || ' 2 69 Om'
     WHEN 5 THEN '-' || l_partkey || ':' WHEN 6 THEN '- ' || l_partkey || ' ' || l_linenumber WHEN 7 THEN ': 3 4'
     WHEN 8 THEN '#KEY:' || l_partkey WHEN 9 THEN '- x' WHEN 10 THEN ': ' || l_partkey || ' 4 60 dé' || chr(13) ELSE 'E' END AS line FROM lineitem)"""
_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]


def _raw_lines(spark, sf):
    n, p = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    kinds = [
        F.concat(F.lit(": "), n, F.lit(" 4 60 la")),
        F.concat(F.lit("* "), p, F.lit(" 3 -5  la ")),
        F.concat(F.lit("  F 12 "), n, F.lit(" 61")),
        F.concat(F.lit("- "), p),
        F.concat(F.lit("-"), p, F.lit(": "), p, F.lit(" 2 69 Om")),
        F.concat(F.lit("-"), p, F.lit(":")),
        F.concat(F.lit("- "), p, F.lit(" "), n),
        F.lit(": 3 4"),
        F.concat(F.lit("#KEY:"), p),
        F.lit("- x"),
        F.concat(F.lit(": "), p, F.lit(" 4 60 dé\r")),
        F.lit("E"),
    ]
    line = F.lit(None).cast("string")
    for k, expr in enumerate(kinds):
        line = F.when(F.col("l_partkey") % 12 == k, expr).otherwise(line)
    return table(spark, sf, "lineitem").select(*_ID, line.alias("line"))


@query(
    "parse_note_lines",
    f"""WITH {_LINES} SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice,
      CASE p % 12 WHEN 1 THEN '*' WHEN 2 THEN 'F' ELSE ':' END AS note_type,
      CASE p % 12 WHEN 0 THEN n WHEN 1 THEN p WHEN 2 THEN 12 ELSE p END AS start_beat,
      CAST(CASE p % 12 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN n ELSE 4 END AS BIGINT) AS duration,
      CASE p % 12 WHEN 0 THEN 60 WHEN 1 THEN -5 WHEN 2 THEN 61 ELSE 60 END AS pitch,
      CASE p % 12 WHEN 0 THEN 'la' WHEN 1 THEN ' la ' WHEN 2 THEN '' ELSE 'dé' END AS syllable
    FROM ln WHERE p % 12 IN (0, 1, 2, 10)""",
)
def _(spark, sf):
    parsed = _raw_lines(spark, sf).where(~F.startswith(F.ltrim("line"), F.lit("-")))
    return parsed.withColumn("n", charts.parse_line(F.col("line"))).where("n IS NOT NULL").select(*_ID, "n.*")


@query(
    "parse_rest_lines",
    f"""WITH {_LINES} SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice,
      CASE WHEN p % 12 = 4 THEN ':' ELSE '-' END AS note_type,
      CASE WHEN p % 12 = 5 THEN p ELSE p END AS start_beat,
      CAST(CASE WHEN p % 12 = 4 THEN 2 ELSE 0 END AS BIGINT) AS duration,
      CASE WHEN p % 12 = 4 THEN 69 ELSE 0 END AS pitch,
      CASE WHEN p % 12 = 4 THEN 'Om' ELSE '' END AS syllable
    FROM ln WHERE p % 12 IN (3, 4, 5, 6)""",
)
def _(spark, sf):
    parsed = _raw_lines(spark, sf).where(F.startswith(F.ltrim("line"), F.lit("-")))
    return parsed.withColumn("n", charts.parse_line(F.col("line"))).where("n IS NOT NULL").select(*_ID, "n.*")


def _headers(spark, sf):
    key = F.col("o_orderkey")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("#Title: Song "), key.cast("string")),
        F.lit("#TITLE:old"),
        F.concat(F.lit("#title:Song:"), key.cast("string"), F.lit(" \r")),
        F.concat(F.lit("#ARTIST:"), F.col("o_orderpriority")),
        F.when(key % 5 != 0, F.concat(F.lit("#BPM:"), (60 + key % 120).cast("string"), F.lit(",50"))),
        F.when(key % 7 != 0, F.concat(F.lit("#GAP:"), (key % 2000).cast("string"), F.lit(".9"))),
        F.when(key % 3 == 0, F.lit("#START:abc")).otherwise(F.lit("#START:1,5")),
        F.when(key % 4 == 0, F.lit("#END:")).otherwise(F.lit("#END:678000.7")),
        F.lit("#COVER:c.jpg"),
        F.lit("#NOCOLON"),
        F.lit(": 0 4 60 la"),
        F.lit("#VIDEO:late.mp4"),
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


@query(
    "parse_headers",
    """SELECT o_orderkey, 'Song:' || o_orderkey AS title, o_orderpriority AS artist, '' AS mp3,
      CASE WHEN o_orderkey % 5 = 0 THEN 120.0::DOUBLE ELSE 60 + o_orderkey % 120 + 0.5::DOUBLE END AS bpm,
      CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 2000 END AS gap, 'late.mp4' AS video, 'c.jpg' AS cover,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.5::DOUBLE END AS start,
      CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 678000 END AS BIGINT) AS end_ms
    FROM orders""",
)
def _(spark, sf):
    songs = charts.parse_songs(_headers(spark, sf))
    return songs.select("o_orderkey", "title", "artist", "mp3", "bpm", "gap", "video", "cover", "start", "end_ms")


@query(
    "raw_header",
    r"""WITH t AS (SELECT doc_id, parts, len(parts) AS n FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', chr(13) || chr(10)) ELSE text END, chr(10)) AS parts FROM documents)),
    h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE least(n, doc_id % 4 + 1) END AS k, parts FROM t)
    SELECT doc_id, CAST(k AS INTEGER) AS n_lines, array_to_string(list_transform(list_slice(parts, 1, k), lambda x: '#' || rtrim(x, chr(13))), '|') AS header FROM h""",
)
def _(spark, sf):
    """The first lines of each document made into header lines, then found again."""
    d = F.col("doc_id")
    text = F.when(d % 2 == 0, F.replace("text", F.lit(". "), F.lit("\r\n"))).otherwise(F.col("text"))
    parts = F.split(text, "\n")
    k = F.when(d % 3 == 0, 0).otherwise((d % 4 + 1).cast("int"))
    made = F.concat_ws("\n", F.transform(parts, lambda x, i: F.when(i < k, F.concat(F.lit("#"), x)).otherwise(F.concat(F.lit("."), x))))
    return table(spark, sf, "documents").select("doc_id", charts.raw_header(made).alias("h")).select(
        "doc_id", F.size("h").alias("n_lines"), F.concat_ws("|", "h").alias("header")
    )


@query(
    "decode_text",
    r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN text
      ELSE '€…' || regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') END AS decoded FROM documents""",
)
def _(spark, sf):
    """Documents as UTF-8, UTF-8 with a mark, and Windows-1252 bytes."""
    d = F.col("doc_id")
    raw = (
        F.when(d % 3 == 0, F.encode("text", "UTF-8"))
        .when(d % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .otherwise(F.concat(F.unhex(F.lit("8085")), F.encode("text", "ISO-8859-1")))
    )
    return table(spark, sf, "documents").select("doc_id", charts.decode_text(raw).alias("decoded"))


def _songs(notes):
    """One header row per song of the note table."""
    ids = notes.groupBy("song").agg(F.count(F.lit(1)).alias("n"))
    return ids.select(
        "song",
        F.concat(F.lit("Song "), F.col("song").cast("string")).alias("title"),
        F.lit("Various").alias("artist"),
        F.lit("audio.mp3").alias("mp3"),
        F.when(F.col("song") % 2 == 0, "clip.mp4").otherwise("").alias("video"),
        (60 + F.col("song") % 120 + 0.125).alias("bpm"),
        (F.col("song") % 2000).alias("gap"),
        F.when(F.col("song") % 3 == 0, F.lit(1.25)).alias("start"),
        F.when(F.col("song") % 3 == 1, F.col("song") / 10 + 0.1).alias("preview_start"),
    )


_BODY = """SELECT song, 2 AS section, pos AS ord, CASE WHEN note_type = '-' THEN '- ' || start_beat
  ELSE note_type || ' ' || start_beat || ' ' || duration || ' ' || pitch || ' ' || syllable END AS line FROM chart"""
_HEAD = """h AS (SELECT song, list_filter(['#TITLE:Song ' || song, '#ARTIST:Various', '#MP3:audio.mp3', CASE WHEN song % 2 = 0 THEN '#VIDEO:clip.mp4' END,
    '#BPM:' || printf('%.2f', 60 + song % 120 + 0.13), '#GAP:' || song % 2000, CASE WHEN song % 3 = 0 THEN '#START:1.3' END,
    CASE WHEN song % 3 = 1 THEN '#PREVIEWSTART:' || replace(printf('%.2f', song / 10.0 + 0.1), '.', ',') END], lambda x: x IS NOT NULL) AS ls
  FROM (SELECT DISTINCT song FROM chart))"""


@query(
    "render_chart",
    "WITH " + roles.CHART_SQL + ", " + _HEAD + f"""
    {_BODY}
    UNION ALL SELECT song, 0, k - 1, ls[k] FROM (SELECT song, ls, unnest(range(1, len(ls) + 1)) AS k FROM h)
    UNION ALL SELECT song, 1, 0, '' FROM h UNION ALL SELECT song, 3, 0, 'E' FROM h""",
)
def _(spark, sf):
    notes = roles.chart(spark, sf)
    songs = _songs(notes)
    heads = songs.select("song", charts.header_lines(songs).alias("header"))
    return charts.render(heads, notes, ["song"], "header", "pos")


_BREAKS = """brk AS (SELECT *, last_value(CASE WHEN note_type <> '-' THEN start_beat + duration END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
   first_value(CASE WHEN note_type <> '-' THEN start_beat END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns
   FROM chart WINDOW w AS (PARTITION BY song ORDER BY pos)),
 placed AS (SELECT * EXCLUDE (start_beat), CASE WHEN note_type <> '-' OR pe IS NULL OR ns IS NULL THEN start_beat
     WHEN ns - pe > 3 THEN pe + (ns - pe) // 3 ELSE pe END AS start_beat FROM brk)"""


@query(
    "render_edited",
    "WITH " + roles.CHART_SQL + ", " + _BREAKS + """
    SELECT song, 2 AS section, pos AS ord, CASE WHEN note_type = '-' THEN '- ' || start_beat
      ELSE note_type || ' ' || start_beat || ' ' || duration || ' ' || pitch || ' ' || syllable END AS line FROM placed
    UNION ALL SELECT DISTINCT song, 0, k, ['#X-TAG:keep ' || song, '#COVER:'][k + 1] FROM chart, range(0, 2) r(k)
    UNION ALL SELECT DISTINCT song, 1, 0, '' FROM chart UNION ALL SELECT DISTINCT song, 3, 0, 'E' FROM chart""",
)
def _(spark, sf):
    """Verbatim header plus a body whose breaks are placed anew."""
    notes = roles.chart(spark, sf)
    ids = notes.groupBy("song").agg(F.count(F.lit(1)).alias("n"))
    heads = ids.select(
        "song", F.array(F.concat(F.lit("#X-TAG:keep "), F.col("song").cast("string")), F.lit("#COVER:")).alias("header")
    )
    placed = G.place_breaks_between(notes, ["song"], "pos")
    return charts.render(heads, placed, ["song"], "header", "pos")


@query(
    "roundtrip",
    "WITH " + roles.CHART_SQL + """
    SELECT song, pos AS note_idx, note_type, start_beat, duration, pitch, syllable FROM chart""",
)
def _(spark, sf):
    """Every chart row written as a line and read back."""
    lines = roles.chart(spark, sf).select("song", F.col("pos").alias("note_idx"), charts.note_line().alias("line"))
    return lines.select("song", "note_idx", charts.parse_line(F.col("line")).alias("n")).select("song", "note_idx", "n.*")


def _corpus(spark, sf):
    """Charts of all songs written as one text file each, and read back."""
    notes = stage(roles.chart(spark, sf))
    songs = _songs(notes)
    heads = songs.select("song", charts.header_lines(songs).alias("header"))
    path = fresh_path(spark, "corpus")
    charts.write_lines(charts.render(heads, notes, ["song"], "header", "pos"), "song", ["section", "ord"], path)
    return charts.read_corpus(spark, path).select(
        F.regexp_extract("path", r"song=(\d+)", 1).cast("long").alias("song"), "text"
    )


@query(
    "read_corpus",
    "WITH " + roles.CHART_SQL + """
    SELECT song, pos AS note_idx, note_type, start_beat, duration, pitch, syllable FROM chart""",
)
def _(spark, sf):
    return charts.parse_notes(_corpus(spark, sf)).select(
        "song", "note_idx", "note_type", "start_beat", "duration", "pitch", "syllable"
    )


@query(
    "read_strict4",
    "WITH " + roles.CHART_SQL + """,
    k AS (SELECT *, 60 + song % 120 + 0.13::DOUBLE AS bpm FROM chart WHERE note_type <> '-' AND trim(syllable) <> '')
    SELECT song, row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS note_idx, dense_rank() OVER (PARTITION BY song ORDER BY pos // 5) - 1 AS verse,
      round(song % 2000 + start_beat * (60000.0::DOUBLE / bpm / 4), 6) AS start_ms, round(duration * (60000.0::DOUBLE / bpm / 4), 6) AS length_ms, pitch,
      ltrim(syllable) AS syllable, note_type = '*' AS golden FROM k""",
)
def _(spark, sf):
    corpus = _corpus(spark, sf)
    tags = charts.header_tags(F.col("text"))
    with_numbers = corpus.select("song", "text", *[c for c in charts.song_row(tags)][3:5])
    out = charts.parse_strict(with_numbers, "bpm", "gap")
    return out.withColumn("start_ms", F.round("start_ms", 6)).withColumn("length_ms", F.round("length_ms", 6))


@query(
    "read_transcripts",
    "WITH " + roles.TIMED_SQL + """
    SELECT song * 100 + run AS song, pos AS word_idx, word, start_ms / 1000.0 AS start, end_ms / 1000.0 AS end,
      CAST(0 AS INTEGER) AS n_characters, CAST(CASE WHEN run % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_pauses FROM timed""",
)
def _(spark, sf):
    """Runs written as nested JSON documents, read back and flattened."""
    words = roles.timed_words(spark, sf)
    one = F.struct(
        "pos", "word", (F.col("start_ms") / F.lit(1000.0)).alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end")
    )
    docs = words.groupBy("song", "run").agg(F.array_sort(F.collect_list(one)).alias("words"))
    shaped = docs.select(
        (F.col("song") * 100 + F.col("run")).alias("song"),
        "words",
        F.lit("fr").alias("language"),
        F.when(F.col("run") % 2 == 0, F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end")))).alias("pauses"),
    )
    path = fresh_path(spark, "transcripts")
    shaped.write.json(path)
    read = transcripts.read_transcripts(spark, path, multi_line=False)
    flat = transcripts.document_words(read).select(
        "song", "word_idx", "word", "start", "end", F.size("characters").alias("n_characters")
    )
    return flat.join(read.select("song", F.size("pauses").alias("n_pauses")), "song")


@query(
    "pitch_overlay",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS word, round(value * 1000, 6) AS start_ms,
      round(CASE WHEN event_id % 2 = 0 THEN 0 ELSE value * 1000 + 500 END, 6) AS end_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS midi,
      CAST(1 AS INTEGER) AS n_frames, round(value * 1000, 6) AS t_ms, CAST(0 AS INTEGER) AS m FROM events""",
)
def _(spark, sf):
    v = F.col("value")
    word = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("word"),
        v.alias("start"),
        F.when(F.col("event_id") % 2 != 0, v + 0.5).alias("end"),
        F.get_json_object("props", "$.k").cast("int").alias("midi"),
        F.array(F.struct(v.alias("time"), F.lit(0.5).alias("confidence"))).alias("pitchFrames"),
    )
    docs = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.array(word).alias("words"))).alias("doc"))
    rows = docs.select("event_id", F.inline(transcripts.pitch_overlay(F.col("doc"))))
    return rows.select(
        "event_id", "word", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"), "midi",
        F.size("frames").alias("n_frames"), F.round(F.col("frames")[0]["t_ms"], 6).alias("t_ms"), F.col("frames")[0]["m"].alias("m"),
    )


@query(
    "recover_frames",
    "WITH " + roles.FRAMES_SQL + """
    SELECT song, CAST(floor(t / 86400) AS BIGINT) AS day, arg_max(midi, id) AS midi, arg_max(amp, id) AS amp FROM frames GROUP BY song, floor(t / 86400)""",
)
def _(spark, sf):
    rows = roles.frames(spark, sf).withColumn("day", F.floor(F.col("t") / roles.DAY))
    return transcripts.recover_frames(rows, ["song"], "day", ["id"]).select("song", "day", "midi", "amp")


@query(
    "passes_dump",
    "WITH " + roles.WORDS_SQL + """
    SELECT song, run, count(*) AS word_count, string_agg(word, ' ' ORDER BY pos) AS text FROM words GROUP BY song, run""",
)
def _(spark, sf):
    dumped = transcripts.dump_runs(roles.run_words(spark, sf), ["song", "run"], "pos", "word")
    return stages.save_stage(dumped, fresh_path(spark, "passes"), ["run"]).select(
        "song", F.col("run").cast("long").alias("run"), "word_count", "text"
    )


@query(
    "lyrics_sink",
    "WITH " + roles.SUNG_SQL + L.LYRICS_SQL + """
    SELECT song, line_no, text FROM lyric""",
)
def _(spark, sf):
    """Lyrics written as one text file per song and read back line by line."""
    rows = L.reassemble(roles.sung(spark, sf), ["song"], "pos", "note_type", "syllable")
    path = fresh_path(spark, "lyrics")
    charts.write_lines(rows.withColumnRenamed("text", "line"), "song", ["line_no"], path)
    back = charts.read_corpus(spark, path).select(
        F.regexp_extract("path", r"song=(\d+)", 1).cast("long").alias("song"),
        F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line_no", "text"),
    )
    return back.withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "pending_songs",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _(spark, sf):
    songs = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return stages.pending(songs, done, ["o_orderkey"])


@query(
    "artifact_filter",
    r"""WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'run/a.JSON' WHEN 1 THEN 'note_segments_plots/x.html' WHEN 2 THEN url || '/view.html'
        WHEN 3 THEN 'note_segments_plots.txt' ELSE url END AS path, epoch_us(ts) / 1000000.0 AS modified FROM pages JOIN events ON page_id = event_id)
    SELECT page_id, path FROM f WHERE (page_id % 5 IN (0, 2, 3) OR page_id % 5 = 4 AND regexp_matches(lower(path), '[^/]\.(json|html|txt)$')) AND modified >= 1704067200.0 + 20000 - 2""",
)
def _(spark, sf):
    p = F.col("page_id")
    path = (
        F.when(p % 5 == 0, "run/a.JSON").when(p % 5 == 1, "note_segments_plots/x.html")
        .when(p % 5 == 2, F.concat("url", F.lit("/view.html"))).when(p % 5 == 3, "note_segments_plots.txt").otherwise(F.col("url"))
    )
    events = table(spark, sf, "events").select(F.col("event_id").alias("page_id"), roles.seconds("ts").alias("modified"))
    files = table(spark, sf, "pages").select("page_id", path.alias("path")).join(events, "page_id")
    return files.where(
        stages.is_kept_artifact(F.col("path"), F.col("modified"), F.lit(1704067200.0 + 20000))
    ).select("page_id", "path")


@query(
    "song_json",
    "WITH " + roles.CHART_SQL + """
    SELECT song, pos AS id, '{"id":' || pos || ',"type":"' || note_type || '","start":' || start_beat || ',"dur":' || duration || ',"pitch":'
      || CASE WHEN note_type = '-' THEN pitch ELSE pitch END || ',"syl":"' || syllable || '"}' AS note,
      round(60000.0::DOUBLE / (60 + song % 120) / 4, 6) AS beat_ms, round(60000.0::DOUBLE / (60 + song % 120), 6) AS pulse_ms FROM chart""",
)
def _(spark, sf):
    notes = roles.chart(spark, sf).withColumn("bpm", 60 + F.col("song") % 120)
    return L.editor_rows(notes, ["song"], "pos", "bpm").select(
        "song", "id", "note", F.round("beat_ms", 6).alias("beat_ms"), F.round("pulse_ms", 6).alias("pulse_ms")
    )


