"""Queries on ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.text import normalize_line
from strophe.operators import generate as G
from strophe.operators import lyrics as L
from strophe.operators import ordered as O
from strophe.operators import stats as S
from strophe.plans import roles
from strophe.plans.registry import query, table
from strophe.sources import charts

HALF_DAY = 43200.0


@query(
    "gap_sessions",
    "WITH " + roles.FRAMES_SQL + """,
    g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 43200.0 THEN 1 ELSE 0 END AS o FROM frames WINDOW w AS (PARTITION BY song ORDER BY t, id))
    SELECT song, id, CAST(sum(o) OVER (PARTITION BY song ORDER BY t, id) AS BIGINT) AS verse FROM g""",
)
def _(spark, sf):
    out = O.gap_sessions(
        roles.frames(spark, sf), ["song"], roles.FRAME_ORDER, roles.day_block(), "t", "t", HALF_DAY
    )
    return out.select("song", "id", "verse")


_MARKED = roles.SUNG_SQL + ", mk AS (SELECT song, pos, is_break OR pos % 5 = 3 OR pos % 11 = 0 AS mark FROM sung)"


def _marked(spark, sf):
    mark = F.col("is_break") | (F.col("pos") % 5 == 3) | (F.col("pos") % 11 == 0)
    return roles.sung(spark, sf).select("song", "pos", mark.alias("mark"))


@query(
    "delimited_groups",
    "WITH " + _MARKED + """,
    g AS (SELECT song, pos, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY pos) AS k, mark FROM mk)
    SELECT song, pos, dense_rank() OVER (PARTITION BY song ORDER BY k) - 1 AS grp FROM g WHERE NOT mark""",
)
def _(spark, sf):
    return O.delimited_groups(_marked(spark, sf), ["song"], "pos", F.col("mark")).select("song", "pos", "grp")


@query(
    "delimited_groups_all",
    "WITH " + _MARKED + """
    SELECT song, pos, grp FROM (SELECT song, pos, CAST(sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY pos) AS BIGINT) AS grp, mark FROM mk) WHERE NOT mark""",
)
def _(spark, sf):
    out = O.delimited_groups(_marked(spark, sf), ["song"], "pos", F.col("mark"), drop_empty=False)
    return out.select("song", "pos", "grp")


@query(
    "quiet_runs",
    "WITH " + roles.FRAMES_N_SQL + """,
    p AS (SELECT song, quantile_cont(amp, 0.95) AS p95, max(n) AS last FROM framesn GROUP BY song),
    q AS (SELECT song, n, n - row_number() OVER (PARTITION BY song ORDER BY n) AS isl, last FROM framesn JOIN p USING (song) WHERE p95 >= 0.000001 AND amp < 0.3::DOUBLE * p95)
    SELECT song, min(n) AS first_frame, least(max(n) + 1, max(last)) AS end_frame FROM q GROUP BY song, isl HAVING count(*) >= 3""",
)
def _(spark, sf):
    return O.quiet_runs(roles.numbered_frames(spark, sf), ["song"], "n", "amp", 3, ratio=0.3)


@query(
    "active_bounds",
    "WITH " + roles.FRAMES_SQL + """,
    p AS (SELECT song, quantile_cont(amp, 0.05) AS p5, max(t) AS dur FROM frames GROUP BY song)
    SELECT song, coalesce(min(t) FILTER (amp > p5), 0) AS start, coalesce(max(t) FILTER (amp > p5) + 100, max(dur)) AS end FROM frames JOIN p USING (song) GROUP BY song""",
)
def _(spark, sf):
    return O.active_bounds(roles.frames(spark, sf).withColumn("dur", F.col("t")), ["song"], "t", "amp", 100.0, "dur")


# A "syllable" is a user's ten days; the gate is a fixed level.
_GATED = roles.FRAMES_SQL + """,
    s AS (SELECT *, CAST(floor(t / 864000) AS BIGINT) AS syl FROM frames),
    a AS (SELECT *, conf >= 0.3 AND amp >= 60 + song % 5 * 40 AS ok FROM s),
    b AS (SELECT *, bool_or(ok) OVER (PARTITION BY song, syl) AS has FROM a),
    act AS (SELECT song, syl, id, t, amp, conf, midi FROM b WHERE CASE WHEN has THEN ok ELSE conf >= 0.5 END),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY song, syl ORDER BY t, id) > 86400.0 THEN 1 ELSE 0 END AS o FROM act),
    h AS (SELECT *, sum(o) OVER (PARTITION BY song, syl ORDER BY t, id) AS isl FROM g),
    e AS (SELECT song, syl, isl, sum(amp * conf) AS en FROM h GROUP BY song, syl, isl),
    bi AS (SELECT song, syl, isl FROM (SELECT *, row_number() OVER (PARTITION BY song, syl ORDER BY round(en, 6) DESC, isl) AS rn FROM e) WHERE rn = 1),
    sel AS (SELECT h.* FROM h JOIN bi USING (song, syl, isl))"""


def _gated(spark, sf):
    rows = roles.frames(spark, sf).withColumn("syl", F.floor(F.col("t") / 864000)).withColumn(
        "gate", (60 + F.col("song") % 5 * 40).cast("double")
    )
    return O.active_frames(rows, ["song", "syl"], "conf", "amp", "gate")


def _selected(spark, sf):
    energy = F.col("amp") * F.col("conf")
    return O.strongest_island(
        _gated(spark, sf), ["song", "syl"], roles.FRAME_ORDER, roles.day_block(), "t", energy, 86400.0
    )


@query("activity_gate", "WITH " + _GATED + " SELECT song, syl, id FROM act")
def _(spark, sf):
    return _gated(spark, sf).select("song", "syl", "id")


@query("strongest_island", "WITH " + _GATED + " SELECT song, syl, id FROM sel")
def _(spark, sf):
    return _selected(spark, sf).select("song", "syl", "id")


@query(
    "rolling_median",
    "WITH " + roles.FRAMES_N_SQL + """
    SELECT song, n, CAST(round_even(median(midi) OVER (PARTITION BY song ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS BIGINT) AS smooth FROM framesn""",
)
def _(spark, sf):
    return O.rolling_median(roles.numbered_frames(spark, sf), ["song"], "n", "midi").select("song", "n", "smooth")


def _runs(spark, sf):
    """Pitch runs of the numbered frames of each user's ten days."""
    rows = roles.numbered_frames(spark, sf).select(
        "song", "n", "t", "midi", "amp", "conf", F.floor(F.col("t") / 864000).alias("syl"), F.lit(60).alias("fallback")
    )
    return O.pitch_runs(rows, ["song", "syl"], "n", "t", "midi", "fallback", gap=86400.0, tolerance=12)


_RUNS = roles.FRAMES_N_SQL + """,
fr AS (SELECT song, n, t, midi, amp, conf, CAST(floor(t / 864000) AS BIGINT) AS syl, row_number() OVER (PARTITION BY song, floor(t / 864000) ORDER BY n) AS k FROM framesn),
go AS (SELECT song, syl, k, n, t, midi, amp, conf, CAST(0 AS BIGINT) AS run, [midi] AS ps FROM fr WHERE k = 1
  UNION ALL SELECT song, syl, k, n, t, midi, amp, conf, CASE WHEN joins THEN run ELSE run + 1 END, CASE WHEN joins THEN list_sort(list_append(ps, midi)) ELSE [midi] END
  FROM (SELECT fr.*, go.run, go.ps, fr.t - go.t <= 86400 AND abs(fr.midi - round_even((ps[(len(ps) - 1) // 2 + 1] + ps[len(ps) // 2 + 1]) / 2.0, 0)) <= 12 AS joins
    FROM go JOIN fr ON fr.song = go.song AND fr.syl = go.syl AND fr.k = go.k + 1))"""


@query("pitch_runs", "WITH RECURSIVE " + _RUNS + " SELECT song, syl, n, midi, run FROM go")
def _(spark, sf):
    """Runs of frames near the median pitch of the run so far."""
    return _runs(spark, sf).select("song", "syl", "n", "midi", "run")


@query(
    "merge_short_runs",
    "WITH RECURSIVE " + _RUNS + """,
    ru AS (SELECT song, syl, run, min(t) AS a, max(t) AS b FROM go GROUP BY song, syl, run),
    nu AS (SELECT *, sum(CASE WHEN b - a >= 14400 OR run = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY song, syl ORDER BY run) AS num FROM ru),
    le AS (SELECT song, syl, max(b) FILTER (num = 1) - min(a) FILTER (num = 1) AS len, max(num) AS k FROM nu GROUP BY song, syl),
    mp AS (SELECT song, syl, run, CAST(CASE WHEN num = 1 AND k > 1 AND len < 14400 THEN 2 ELSE num END AS BIGINT) AS note FROM nu JOIN le USING (song, syl))
    SELECT song, syl, note, min(t) AS start, max(t) AS "end", count(*) AS frames,
      CAST(round_even(sum(midi * greatest(0.001, amp * conf)) / sum(greatest(0.001, amp * conf)), 0) AS BIGINT) AS pitch FROM go JOIN mp USING (song, syl, run) GROUP BY song, syl, note""",
)
def _(spark, sf):
    """Runs shorter than four hours joined to their neighbours, with weighted pitches."""
    notes = O.merge_short_runs(_runs(spark, sf), ["song", "syl"], "run", "t", 14400.0)
    pitch = S.weighted_pitch(notes, ["song", "syl", "note"], "midi", F.col("amp") * F.col("conf"))
    spans = notes.groupBy("song", "syl", "note").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("frames"))
    return spans.join(pitch, ["song", "syl", "note"])


# ---- the beat grid -----------------------------------------------------------------

_GRID = roles.SUNG_SQL + """,
r AS (SELECT *, CAST(round_even(start_ms / 1000.0::DOUBLE * ((60 + song % 120) / 60.0::DOUBLE) * 4 / 2, 0) AS BIGINT) AS raw,
    CAST(round_even(end_ms / 1000.0::DOUBLE * ((60 + song % 120) / 60.0::DOUBLE) * 4 / 2, 0) AS BIGINT) AS rawend FROM sung),
i AS (SELECT *, CASE WHEN NOT is_break THEN count(*) FILTER (NOT is_break) OVER (PARTITION BY song ORDER BY pos) END AS nth FROM r),
q AS (SELECT *, CASE WHEN NOT is_break THEN max(raw - nth) OVER (PARTITION BY song ORDER BY pos) + nth END AS start_beat FROM i),
nx AS (SELECT *, first_value(start_beat IGNORE NULLS) OVER (PARTITION BY song ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM q),
cp AS (SELECT *, CASE WHEN NOT is_break THEN coalesce(least(greatest(start_beat + 1, rawend), next_start), greatest(start_beat + 1, rawend)) END AS end_beat FROM nx),
pb AS (SELECT *, lag(end_beat) OVER (PARTITION BY song ORDER BY pos) AS pe FROM cp)"""


def _raw(name):
    return F.rint(F.col(name) / 1000 * ((60 + F.col("song") % 120) / F.lit(60.0)) * 4 / 2).cast("long")


def _quantized(spark, sf):
    return G.quantize_unique(roles.sung(spark, sf), ["song"], "pos", _raw("start_ms"), ~F.col("is_break"))


@query("quantize_unique", "WITH " + _GRID + " SELECT song, pos, start_beat FROM q WHERE NOT is_break")
def _(spark, sf):
    return _quantized(spark, sf).where("NOT is_break").select("song", "pos", "start_beat")


@query("next_onset", "WITH " + _GRID + " SELECT song, pos, next_start FROM nx")
def _(spark, sf):
    rows = _quantized(spark, sf)
    return G.next_onset(rows, ["song"], "pos", F.col("start_beat"), ~F.col("is_break")).select("song", "pos", "next_start")


@query("cap_duration", "WITH " + _GRID + " SELECT song, pos, end_beat - start_beat AS duration FROM cp WHERE NOT is_break")
def _(spark, sf):
    rows = _quantized(spark, sf)
    out = G.next_onset(rows, ["song"], "pos", F.col("start_beat"), ~F.col("is_break")).where("NOT is_break")
    end = G.capped_end(F.col("start_beat"), _raw("end_ms"), F.col("next_start"))
    return out.select("song", "pos", (end - F.col("start_beat")).alias("duration"))


@query(
    "place_breaks",
    "WITH " + roles.CHART_SQL + """,
    b AS (SELECT *, last_value(CASE WHEN note_type <> '-' THEN start_beat + duration END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
      first_value(CASE WHEN note_type <> '-' THEN start_beat END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM chart WINDOW w AS (PARTITION BY song ORDER BY pos))
    SELECT song, pos, CASE WHEN pe IS NULL OR ns IS NULL THEN start_beat WHEN ns - pe > 3 THEN pe + (ns - pe) // 3 ELSE pe END AS start_beat FROM b WHERE note_type = '-'""",
)
def _(spark, sf):
    out = G.place_breaks_between(roles.chart(spark, sf), ["song"], "pos")
    return out.where("note_type = '-'").select("song", "pos", "start_beat")


_ANCHOR = """an AS (SELECT o_orderkey AS song, o_orderkey % 3000 + 0.4::DOUBLE AS f, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5000) * 1.5::DOUBLE END AS b, (60 + o_orderkey % 120) * 2 AS bpm FROM orders),
w AS (SELECT *, greatest(0, CAST(round_even(coalesce(b, f - 500), 0) AS BIGINT)) AS gap0, CAST(round_even(f, 0) AS BIGINT) AS f0, 60000.0::DOUBLE / bpm / 4 AS bm FROM an)"""


@query(
    "anchor_gap",
    f"""WITH {_ANCHOR} SELECT song, CASE WHEN gap0 > f0 THEN greatest(0, CAST(round_even(gap0 - ceil((gap0 - f0) / bm) * bm, 0) AS BIGINT)) ELSE gap0 END AS gap FROM w""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("song"),
        G.anchor_gap(k % 3000 + 0.4, F.when(k % 3 == 0, (k % 5000) * 1.5), (60 + k % 120) * 2).alias("gap"),
    )


# Charts from the note rows: song tempo and first beat follow from the song number.
_GENERATED = roles.SUNG_SQL + """,
f AS (SELECT song, arg_min(start_ms, pos) AS first FROM sung WHERE NOT is_break GROUP BY song),
g0 AS (SELECT song, (60 + song % 120) * 2 AS bpm, first, greatest(0, CAST(round_even(coalesce(CASE WHEN song % 3 = 0 THEN (song % 50) * 33.5::DOUBLE END, first - 500), 0) AS BIGINT)) AS gap0 FROM f),
g1 AS (SELECT song, bpm, CASE WHEN gap0 > first THEN greatest(0, CAST(round_even(gap0 - ceil((gap0 - first) / (60000.0::DOUBLE / bpm / 4)) * (60000.0::DOUBLE / bpm / 4), 0) AS BIGINT)) ELSE gap0 END AS gap FROM g0),
r AS (SELECT sung.*, bpm, gap, CAST(round_even((start_ms - gap) / 1000.0::DOUBLE * (bpm / 60.0::DOUBLE) * 4, 0) AS BIGINT) AS raw, CAST(round_even((end_ms - gap) / 1000.0::DOUBLE * (bpm / 60.0::DOUBLE) * 4, 0) AS BIGINT) AS rawend FROM sung JOIN g1 USING (song)),
i AS (SELECT *, CASE WHEN NOT is_break THEN count(*) FILTER (NOT is_break) OVER (PARTITION BY song ORDER BY pos) END AS nth FROM r),
q AS (SELECT *, CASE WHEN NOT is_break THEN max(raw - nth) OVER (PARTITION BY song ORDER BY pos) + nth END AS sb FROM i),
nx AS (SELECT *, first_value(sb IGNORE NULLS) OVER (PARTITION BY song ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM q),
cp AS (SELECT *, CASE WHEN NOT is_break THEN coalesce(least(greatest(sb + 1, rawend), ns), greatest(sb + 1, rawend)) END AS eb FROM nx),
pb AS (SELECT *, coalesce(lag(eb) OVER (PARTITION BY song ORDER BY pos), 0) AS pe FROM cp),
gen AS (SELECT song, pos, CASE WHEN is_break THEN '-' ELSE ':' END AS note_type, CASE WHEN NOT is_break THEN sb WHEN ns - pe > 3 THEN pe + (ns - pe) // 3 ELSE pe END AS start_beat,
   CASE WHEN is_break THEN 0 ELSE eb - sb END AS duration, CASE WHEN is_break THEN 0 ELSE pitch END AS pitch, CASE WHEN is_break THEN '' WHEN syllable = '' THEN '~' ELSE syllable END AS syllable
   FROM pb WHERE NOT is_break OR ns IS NOT NULL)"""


def _song_table(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("song"), F.concat(F.lit("Song "), k.cast("string")).alias("title"), F.col("s_name").alias("artist"),
        F.lit("audio.mp3").alias("mp3"), (60 + k % 120).alias("bpm"),
        F.when(k % 3 == 0, (k % 50) * 33.5).alias("first_beat_ms"),
    )


@query(
    "generate_charts",
    "WITH " + _GENERATED + """,
    fb AS (SELECT song, arg_min(start_beat, pos) AS b FROM gen WHERE note_type <> '-' GROUP BY song),
    h AS (SELECT song, ['#TITLE:Song ' || song, '#ARTIST:' || s_name, '#MP3:audio.mp3', '#BPM:' || printf('%.2f', bpm::DOUBLE), '#GAP:' || gap,
       '#PREVIEWSTART:' || replace(printf('%.2f', (gap + b * (60000.0::DOUBLE / bpm / 4)) / 1000.0 + 0.00000001), '.', ',')] AS ls FROM g1 JOIN fb USING (song) JOIN supplier ON s_suppkey = song)
    SELECT song, 2 AS section, pos AS ord, CASE WHEN note_type = '-' THEN '- ' || start_beat ELSE note_type || ' ' || start_beat || ' ' || duration || ' ' || pitch || ' ' || syllable END AS line FROM gen
    UNION ALL SELECT song, 0, k - 1, ls[k] FROM (SELECT song, ls, unnest(range(1, len(ls) + 1)) AS k FROM h)
    UNION ALL SELECT song, 1, 0, '' FROM h UNION ALL SELECT song, 3, 0, 'E' FROM h""",
)
def _(spark, sf):
    """Charts of all songs, as ordered lines: timed syllables to the finished text."""
    headers, notes = G.generate(roles.sung(spark, sf), _song_table(spark, sf), ["song"], "pos")
    heads = headers.select("song", charts.header_lines(headers).alias("header"))
    return charts.render(heads, notes, ["song"], "header", "pos")


_LYRIC = """ll AS (SELECT song, line AS line_no, 'w' || (arg_min(pitch, pos) % 4) || CASE WHEN line % 2 = 0 THEN '!' ELSE '' END AS line FROM
   (SELECT *, sum(CASE WHEN note_type = '-' THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY pos) AS line FROM gen) WHERE note_type <> '-' GROUP BY song, line),
lx AS (SELECT song, CAST(line_no AS BIGINT) AS line_no, trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS line FROM ll WHERE NOT (song % 5 = 0 AND line_no = 7))"""

# Brute force: every pair of equal lines, walked along its diagonal.
_BLOCK = """nl AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY line_no) - 1 AS i, line FROM lx),
cnt AS (SELECT song, count(*) AS n FROM nl GROUP BY song),
eq AS (SELECT a.song, a.i, b.i - a.i AS d FROM nl a JOIN nl b ON a.song = b.song AND a.line = b.line AND b.i <> a.i),
rn AS (SELECT *, i - row_number() OVER (PARTITION BY song, d ORDER BY i) AS g FROM eq),
ln AS (SELECT song, d, i, max(i) OVER (PARTITION BY song, d, g) - i + 1 AS len FROM rn),
ca AS (SELECT DISTINCT song, i, len AS l FROM ln WHERE len >= 2),
oc AS (SELECT ca.song, ca.i, ca.l, 1 + count(*) AS c FROM ca JOIN ln ON ln.song = ca.song AND ln.i = ca.i AND ln.len >= ca.l GROUP BY ca.song, ca.i, ca.l),
bb AS (SELECT song, i AS first_line, i + l - 1 AS last_line, c AS times FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY c DESC, l DESC, i) AS k FROM oc JOIN cnt USING (song) WHERE n >= 4) WHERE k = 1)"""


@query(
    "repeated_block",
    "WITH " + roles.LINES_SQL + r""", lx AS (SELECT song, line_no, trim(regexp_replace(lower(line), '[^\p{L}\p{N}_]+', ' ', 'g')) AS line FROM lines), """ + _BLOCK + " SELECT * FROM bb",
)
def _(spark, sf):
    rows = roles.lines(spark, sf).select("song", "line_no", normalize_line(F.col("line")).alias("line"))
    return L.repeated_block(rows, ["song"], "line", "line_no")


@query(
    "block_to_beats",
    "WITH " + _GENERATED + ", " + _LYRIC + ", " + _BLOCK + """,
    gl AS (SELECT song, pos, start_beat, duration, line FROM (SELECT *, CAST(sum(CASE WHEN note_type = '-' THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY pos) AS BIGINT) AS line FROM gen) WHERE note_type <> '-'),
    pl AS (SELECT song, line, arg_min(start_beat, pos) AS a, arg_max(start_beat + duration, pos) AS z FROM gl GROUP BY song, line),
    wh AS (SELECT song, max(line) + 1 AS groups, arg_min(a, line) AS fb FROM pl GROUP BY song),
    m AS (SELECT bb.song, s.a AS ms, e.z AS me FROM bb JOIN wh USING (song) JOIN cnt USING (song) JOIN pl s ON s.song = bb.song AND s.line = first_line JOIN pl e ON e.song = bb.song AND e.line = last_line WHERE groups = n)
    SELECT song, ms AS medley_start_beat, me AS medley_end_beat, round((gap + coalesce(ms, fb) * (60000.0::DOUBLE / bpm / 4)) / 1000.0, 6) AS preview_start FROM wh JOIN g1 USING (song) LEFT JOIN m USING (song)""",
)
def _(spark, sf):
    headers, notes = G.generate(roles.sung(spark, sf), _song_table(spark, sf), ["song"], "pos")
    numbered = G.line_numbers(notes, ["song"], "pos").where("note_type <> '-'")
    first = numbered.groupBy("song", "line_no").agg(F.min_by("pitch", "pos").alias("p"))
    shown = F.concat(F.lit("w"), (F.col("p") % 4).cast("string"), F.when(F.col("line_no") % 2 == 0, "!").otherwise(""))
    kept = first.where(~((F.col("song") % 5 == 0) & (F.col("line_no") == 7)))
    lines = kept.select("song", F.col("line_no").alias("_n"), shown.alias("line"))
    dense = O.dense_order(lines, ["song"], ["_n"], F.floor(F.col("_n") / 4096), "line_no")
    out = G.block_to_beats(notes, dense, headers.select("song", "bpm", "gap"), ["song"], "pos")
    return out.withColumn("preview_start", F.round("preview_start", 6))


# ---- filling ----------------------------------------------------------------------------

_HOLES = roles.TIMED_SQL + """,
hl AS (SELECT song, run, pos, CASE WHEN pos % 6 IN (1, 2) AND pos > 3 AND run <> 3 THEN start_ms / 1000.0::DOUBLE END AS s, CASE WHEN pos % 6 IN (1, 2) AND pos > 3 AND run <> 3 THEN end_ms / 1000.0::DOUBLE END AS e, CAST(48 + pos % 25 AS INTEGER) AS m FROM timed),
an AS (SELECT *, max(CASE WHEN s IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po, min(CASE WHEN s IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS no,
   count(*) OVER (PARTITION BY song, run) AS n, avg(e - s) OVER (PARTITION BY song, run) AS av FROM hl WINDOW w AS (PARTITION BY song, run ORDER BY pos)),
jn AS (SELECT an.*, p.e AS pe, p.m AS pm, x.s AS xs, x.m AS xm, an.pos - po AS k, no - po - 1 AS mi FROM an LEFT JOIN hl p ON p.song = an.song AND p.run = an.run AND p.pos = po LEFT JOIN hl x ON x.song = an.song AND x.run = an.run AND x.pos = no)"""


def _holes(spark, sf):
    hit = (F.col("pos") % 6).isin(1, 2) & (F.col("pos") > 3) & (F.col("run") != 3)
    return roles.timed_words(spark, sf).select(
        "song", "run", "pos", F.when(hit, F.col("start_ms") / F.lit(1000.0)).alias("s"),
        F.when(hit, F.col("end_ms") / F.lit(1000.0)).alias("e"), (48 + F.col("pos") % 25).cast("int").alias("m"),
        F.lit(0.5).alias("lo"), F.lit(90.0).alias("hi"),
    )


@query(
    "interpolate_gaps",
    "WITH " + _HOLES + """,
    f AS (SELECT *, greatest(0.1, xs / no) AS bs, least(greatest(0, xs - pe), mi * 0.8::DOUBLE) AS sp, greatest(0.2, av) AS asl, greatest(0.01, (90.0::DOUBLE - 0.5) / n) AS al FROM jn)
    SELECT song, run, pos, round(CASE WHEN s IS NOT NULL THEN s WHEN po IS NOT NULL AND no IS NOT NULL THEN pe + (k - 1) * sp / mi WHEN no IS NOT NULL THEN greatest(0, xs - (no - pos) * bs)
        WHEN po IS NOT NULL THEN pe + (k - 1) * asl ELSE 0.5 + pos * al END, 6) AS start,
      round(CASE WHEN s IS NOT NULL THEN e WHEN po IS NOT NULL AND no IS NOT NULL THEN pe + k * sp / mi WHEN no IS NOT NULL THEN greatest(0, xs - (no - pos - 1) * bs)
        WHEN po IS NOT NULL THEN pe + (k - 1) * asl + asl ELSE 0.5 + (pos + 1) * al END, 6) AS end,
      CAST(CASE WHEN s IS NOT NULL THEN m WHEN po IS NOT NULL AND no IS NOT NULL THEN round_even(pm + k / (mi + 1)::DOUBLE * (xm - pm), 0) ELSE coalesce(xm, pm, m) END AS INTEGER) AS midi,
      CASE WHEN s IS NOT NULL THEN 'aligned' WHEN po IS NOT NULL AND no IS NOT NULL THEN 'between' WHEN no IS NOT NULL OR po IS NULL THEN 'before' ELSE 'after' END AS source FROM f""",
)
def _(spark, sf):
    out = O.interpolate_gaps(_holes(spark, sf), ["song", "run"], "pos", "s", "e", "final", "lo", "hi", "m")
    return out.select(
        "song", "run", "pos", F.round("s", 6).alias("start"), F.round("e", 6).alias("end"), F.col("m").alias("midi"), "source"
    )


@query(
    "interpolate_approx",
    "WITH " + _HOLES + """,
    f AS (SELECT *, greatest(0.01, (xs - 0.5) / no) AS bs, greatest(0.01, (xs - pe) / mi) AS sp, greatest(0.01, (90.0::DOUBLE - pe) / (n - po - 1)) AS asl, greatest(0.01, (90.0::DOUBLE - 0.5) / n) AS al FROM jn)
    SELECT song, run, pos, round(CASE WHEN s IS NOT NULL THEN s WHEN po IS NOT NULL AND no IS NOT NULL THEN pe + (k - 1) * sp WHEN no IS NOT NULL THEN 0.5 + pos * bs
        WHEN po IS NOT NULL THEN pe + (k - 1) * asl ELSE 0.5 + pos * al END, 6) AS start,
      round(CASE WHEN s IS NOT NULL THEN e WHEN po IS NOT NULL AND no IS NOT NULL THEN least(xs, pe + k * sp) WHEN no IS NOT NULL THEN 0.5 + (pos + 1) * bs
        WHEN po IS NOT NULL THEN pe + k * asl ELSE 0.5 + (pos + 1) * al END, 6) AS end FROM f""",
)
def _(spark, sf):
    out = O.interpolate_gaps(_holes(spark, sf), ["song", "run"], "pos", "s", "e", "approx", "lo", "hi")
    return out.select("song", "run", "pos", F.round("s", 6).alias("start"), F.round("e", 6).alias("end"))


@query(
    "split_shared",
    "WITH " + roles.TIMED_SQL + """,
    g AS (SELECT *, CASE WHEN pos // 3 % 4 = 3 THEN NULL ELSE pos // 3 END AS sig FROM timed),
    w AS (SELECT *, greatest(1, length(word)) AS wt FROM g),
    t AS (SELECT *, min(start_ms) OVER (p) AS gs, max(end_ms) OVER (p) AS ge, sum(wt) OVER (p) AS tw, sum(wt) OVER (PARTITION BY song, run, sig ORDER BY pos) AS cw, count(*) OVER (p) AS k FROM w WINDOW p AS (PARTITION BY song, run, sig))
    SELECT song, run, pos, round(CASE WHEN sig IS NOT NULL AND k > 1 THEN gs + (ge - gs)::DOUBLE * (cw - wt) / tw ELSE start_ms END, 6) AS start, round(CASE WHEN sig IS NOT NULL AND k > 1 THEN gs + (ge - gs)::DOUBLE * cw / tw ELSE end_ms END, 6) AS end FROM t""",
)
def _(spark, sf):
    third = F.floor(F.col("pos") / 3)
    rows = roles.timed_words(spark, sf).select(
        "song", "run", "pos", "word", F.col("start_ms").cast("double").alias("s"), F.col("end_ms").cast("double").alias("e"),
        F.when(third % 4 != 3, third).alias("sig"),
    )
    out = O.split_shared(rows, ["song", "run"], "pos", "sig", "s", "e", F.length("word"))
    return out.select("song", "run", "pos", F.round("s", 6).alias("start"), F.round("e", 6).alias("end"))


@query(
    "fill_intervals",
    "WITH " + roles.TIMED_SQL + """,
    sy AS (SELECT song, run, pos // 4 AS wd, pos % 4 AS i, CASE WHEN (pos // 4) % 5 = 0 OR pos % 3 = 1 THEN NULL ELSE start_ms::DOUBLE END AS s, CASE WHEN (pos // 4) % 5 = 0 OR pos % 3 = 1 THEN NULL ELSE end_ms::DOUBLE + 300 END AS e,
       (pos // 4) * 1600.0::DOUBLE AS lo, (pos // 4) * 1600.0::DOUBLE + 1700 AS hi FROM timed),
    c AS (SELECT *, greatest(lo, s) AS cs, least(hi, e) AS ce, count(*) OVER (p) AS k, count(s) OVER (p) AS hits, max(i) OVER (p) AS o1 FROM sy WINDOW p AS (PARTITION BY song, run, wd)),
    d AS (SELECT *, max(CASE WHEN s IS NOT NULL THEN i END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po, min(CASE WHEN s IS NOT NULL THEN i END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS no FROM c WINDOW w AS (PARTITION BY song, run, wd ORDER BY i)),
    j AS (SELECT d.*, coalesce(p.ce, d.lo) AS l, coalesce(x.cs, d.hi) AS r, coalesce(d.po + 1, 0) AS fi, coalesce(d.no, d.o1 + 1) AS st FROM d LEFT JOIN c p ON p.song = d.song AND p.run = d.run AND p.wd = d.wd AND p.i = d.po LEFT JOIN c x ON x.song = d.song AND x.run = d.run AND x.wd = d.wd AND x.i = d.no),
    f AS (SELECT song, run, wd, i, hits, CASE WHEN hits = 0 THEN lo + i * greatest(0.01, (hi - lo) / k) WHEN s IS NOT NULL THEN cs ELSE l + (i - fi) * greatest(0, r - l) / (st - fi) END AS fs,
        CASE WHEN hits = 0 THEN lo + (i + 1) * greatest(0.01, (hi - lo) / k) WHEN s IS NOT NULL THEN ce ELSE l + (i - fi + 1) * greatest(0, r - l) / (st - fi) END AS fe FROM j),
    n AS (SELECT *, lag(fe) OVER w AS pe, lead(fs) OVER w AS ns FROM f WINDOW w AS (PARTITION BY song, run, wd ORDER BY i)),
    o AS (SELECT *, CASE WHEN hits > 0 AND pe > fs THEN least(fe, (pe + fs) / 2) ELSE fs END AS a FROM n)
    SELECT song, run, wd, i, round(a, 6) AS start, round(CASE WHEN hits > 0 AND fe > ns THEN greatest(a, (fe + ns) / 2) ELSE fe END, 6) AS end FROM o""",
)
def _(spark, sf):
    word = F.floor(F.col("pos") / 4)
    gone = (word % 5 == 0) | (F.col("pos") % 3 == 1)
    rows = roles.timed_words(spark, sf).select(
        "song", "run", word.alias("wd"), (F.col("pos") % 4).alias("i"),
        F.when(~gone, F.col("start_ms").cast("double")).alias("s"),
        F.when(~gone, F.col("end_ms").cast("double") + 300).alias("e"),
        (word * 1600.0).alias("lo"), (word * 1600.0 + 1700).alias("hi"),
    )
    out = O.fill_intervals(rows, ["song", "run", "wd"], "i", "s", "e", "lo", "hi")
    return out.select("song", "run", "wd", "i", F.round("s", 6).alias("start"), F.round("e", 6).alias("end"))


@query(
    "resolve_overlaps",
    "WITH RECURSIVE " + roles.TIMED_SQL + """,
    w AS (SELECT song, run, pos, start_ms / 1000.0::DOUBLE AS s, (end_ms + pos % 4 * 80) / 1000.0::DOUBLE AS e FROM timed),
    p AS (SELECT song, run, list({'a': s + 0.2::DOUBLE, 'b': s + 0.2::DOUBLE + pos % 9 * 0.06::DOUBLE} ORDER BY pos) AS ps FROM w WHERE pos % 5 = 2 GROUP BY song, run),
    nx AS (SELECT w.*, p.ps FROM w LEFT JOIN p USING (song, run)),
    go AS (SELECT song, run, pos, s, e, CAST(NULL AS DOUBLE) AS os, CAST(NULL AS DOUBLE) AS oe FROM w WHERE pos = 0
      UNION ALL SELECT song, run, pos, CASE WHEN e1 > s1 THEN least(e, (e1 + s1) / 2) ELSE s1 END, e, os, CASE WHEN e1 > s1 THEN greatest(os, (e1 + s1) / 2) ELSE e1 END
      FROM (SELECT song, run, pos, e, os, CASE WHEN pa IS NULL THEN oe ELSE least(oe, pa.a) END AS e1, CASE WHEN pa IS NULL THEN s ELSE greatest(s, pa.b) END AS s1
        FROM (SELECT nx.song, nx.run, nx.pos, nx.s, nx.e, go.s AS os, go.e AS oe, list_filter(nx.ps, lambda x: go.s <= x.a AND x.b <= nx.e)[1] AS pa
          FROM go JOIN nx ON nx.song = go.song AND nx.run = go.run AND nx.pos = go.pos + 1))),
    lt AS (SELECT song, run, max(pos) AS top FROM w GROUP BY song, run)
    SELECT song, run, pos - 1 AS pos, os AS s, oe AS e FROM go WHERE pos > 0
    UNION ALL SELECT song, run, pos, s, e FROM go JOIN lt USING (song, run) WHERE pos = top""",
)
def _(spark, sf):
    """Words of each turn cut at pauses and in the middle of overlaps."""
    words = roles.timed_words(spark, sf).select(
        "song", "run", "pos", (F.col("start_ms") / F.lit(1000.0)).alias("s"),
        ((F.col("end_ms") + F.col("pos") % 4 * 80) / F.lit(1000.0)).alias("e"),
    )
    pauses = words.where("pos % 5 = 2").select(
        "song", "run", F.col("pos").alias("pause_idx"), (F.col("s") + 0.2).alias("pause_start"),
        (F.col("s") + 0.2 + F.col("pos") % 9 * 0.06).alias("pause_end"),
    )
    return O.resolve_overlaps(words, pauses, ["song", "run"], "pos", "s", "e", 2.0)


@query(
    "monotone_mid",
    "WITH " + roles.TIMED_SQL + """,
    a AS (SELECT song, run, pos, greatest(0, start_ms::DOUBLE - pos % 5 * 700) AS s, greatest(greatest(0, start_ms::DOUBLE - pos % 5 * 700), end_ms::DOUBLE - pos % 5 * 500) AS e FROM timed),
    b AS (SELECT *, greatest(0, max((s + e) / 2) OVER (PARTITION BY song, run ORDER BY pos)) AS mid FROM a)
    SELECT song, run, pos, greatest(0, mid - (e - s) / 2) AS start, mid + (e - s) / 2 AS end FROM b""",
)
def _(spark, sf):
    back = F.col("pos") % 5
    rows = roles.timed_words(spark, sf).select(
        "song", "run", "pos", (F.col("start_ms").cast("double") - back * 700).alias("start"),
        (F.col("end_ms").cast("double") - back * 500).alias("end"),
    )
    return O.monotone_mid(rows, ["song", "run"], "pos", "start", "end")


@query(
    "neighbour_gap",
    "WITH " + roles.FRAMES_SQL + """,
    w AS (SELECT *, CAST(floor(t / 432000) AS BIGINT) AS word FROM frames),
    g AS (SELECT song, word, coalesce(min(t) FILTER (midi > 60), min(word * 432000)) AS lo, coalesce(max(t) FILTER (midi > 60), max(word * 432000 + 432000)) AS hi FROM w GROUP BY song, word),
    n AS (SELECT song, word, lead(lo) OVER (PARTITION BY song ORDER BY word) - hi AS gap FROM g)
    SELECT song, word, round(gap, 6) AS gap FROM n WHERE gap IS NOT NULL""",
)
def _(spark, sf):
    word = F.floor(F.col("t") / 432000)
    rows = roles.frames(spark, sf).withColumn("word", word).withColumns(
        {"ws": (word * 432000).cast("double"), "we": (word * 432000 + 432000).cast("double")}
    )
    out = O.neighbour_gap(rows, ["song"], "word", "t", F.col("midi") > 60, "ws", "we")
    return out.withColumn("gap", F.round("gap", 6))


@query(
    "insert_breaks",
    "WITH " + roles.NOTES_SQL + """,
    l AS (SELECT *, idx // 7 AS line, CASE WHEN lag(idx // 7) OVER (PARTITION BY song ORDER BY idx) <> idx // 7 THEN 1 ELSE 0 END AS turn FROM notes),
    c AS (SELECT *, sum(turn) OVER (PARTITION BY song ORDER BY idx) AS b FROM l)
    SELECT song, CAST(idx + b AS BIGINT) AS pos, idx, FALSE AS is_break FROM c UNION ALL SELECT song, CAST(idx + b - 1 AS BIGINT), idx, TRUE FROM c WHERE turn = 1""",
)
def _(spark, sf):
    rows = roles.notes(spark, sf).select("song", "idx", "start_ms", F.floor(F.col("idx") / 7).alias("line"))
    return O.insert_breaks(rows, ["song"], "idx", "line", "start_ms").select("song", "pos", "idx", "is_break")


@query(
    "queue_position",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS queue_pos FROM orders WHERE o_orderstatus = 'O'""",
)
def _(spark, sf):
    jobs = table(spark, sf, "orders").withColumn("created", roles.seconds("o_orderdate"))
    out = O.queue_position(
        jobs, ["o_orderpriority"], ["created", "o_orderkey"], F.floor(F.col("created") / (30 * roles.DAY)), "o_orderstatus", "O"
    )
    return out.select("o_orderkey", "queue_pos")


@query(
    "page_window",
    "WITH " + roles.SUNG_SQL + """
    SELECT song, pos // 5 AS line, greatest(0, min(start_ms) - 200) AS from_ms, greatest(greatest(0, min(start_ms) - 200) + 250, max(end_ms) + 400) AS to_ms FROM sung WHERE NOT is_break GROUP BY song, pos // 5""",
)
def _(spark, sf):
    rows = roles.sung(spark, sf).where("NOT is_break").withColumn("line", F.floor(F.col("pos") / 5))
    return O.page_window(rows, ["song", "line"], "start_ms", "end_ms")


@query(
    "first_strong_slot",
    "WITH " + roles.FRAMES_N_SQL + """,
    m AS (SELECT song, max(amp) AS top FROM framesn GROUP BY song),
    g AS (SELECT song, n AS slot, n AS f FROM framesn WHERE n % 4 = 1)
    SELECT song, min(slot) AS slot FROM g JOIN m USING (song) WHERE EXISTS (SELECT 1 FROM framesn x WHERE x.song = g.song AND x.n BETWEEN f - 2 AND f + 2 AND x.amp >= 0.5 * top) GROUP BY song""",
)
def _(spark, sf):
    fr = roles.numbered_frames(spark, sf)
    grid = fr.where("n % 4 = 1").select("song", F.col("n").alias("slot"), F.col("n").alias("f"))
    return O.first_strong_slot(grid, fr, ["song"], "slot", "f", "amp", "n")


# ---- slices ------------------------------------------------------------------------------


@query(
    "position_slices",
    "WITH " + roles.NOTES_SQL + """, k AS (SELECT song, idx, count(*) OVER (PARTITION BY song) AS n FROM notes)
    SELECT song, idx, 'head' AS slice FROM k WHERE idx < 15 UNION ALL SELECT song, idx, 'middle' FROM k WHERE idx >= 60 AND idx < 76 UNION ALL SELECT song, idx, 'tail' FROM k WHERE idx >= n - 15""",
)
def _(spark, sf):
    rows = roles.notes(spark, sf).select("song", "idx")
    return O.position_slices(rows, ["song"], "idx", {"head": (0, 15), "middle": (60, 76), "tail": (-15, None)})


@query(
    "tail_per_key",
    "WITH " + roles.FRAMES_N_SQL + """ SELECT song, id, n FROM (SELECT *, max(n) OVER (PARTITION BY song) AS last FROM framesn) WHERE last - n < 20""",
)
def _(spark, sf):
    return O.tail_per_key(roles.numbered_frames(spark, sf), ["song"], "n", 4000, 20).select("song", "id", "n")


@query(
    "retention",
    """SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN epoch_us(o_orderdate) / 1000000.0 END, epoch_us(o_orderdate) / 1000000.0 - 864000) >= 915148800.0 - 300 * 86400.0""",
)
def _(spark, sf):
    at = roles.seconds("o_orderdate")
    created = F.when(F.col("o_orderkey") % 4 != 0, at)
    return O.retention(table(spark, sf, "orders"), created, at - 864000, F.lit(915148800.0), 300).select("o_orderkey")


