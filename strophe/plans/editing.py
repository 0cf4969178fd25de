"""Queries for set-based chart edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import edits as E
from strophe.operators import generate as G
from strophe.plans import roles
from strophe.plans.registry import query
from strophe.session import stage

KEYS, POS = ["song"], "pos"
_ALL = "song, pos, note_type, start_beat, duration, pitch, syllable"


def _pick(chart, cond, **extra):
    return chart.where(cond).select("song", "pos", *[v.alias(k) for k, v in extra.items()])


def _out(df):
    return df.select(*[c.strip() for c in _ALL.split(",")])


@query(
    "edit_split",
    "WITH " + roles.CHART_SQL + """,
    e AS (SELECT *, pos % 6 = 1 AS hit, CASE WHEN pos % 12 = 1 THEN start_beat + 3 ELSE CAST(floor(start_beat + duration / 2.0 + 0.5) AS BIGINT) END AS cut_at FROM chart),
    f AS (SELECT *, hit AND note_type <> '-' AND duration >= 2 AND cut_at > start_beat AND cut_at < start_beat + duration AS ok FROM e),
    p AS (SELECT song, pos, 0 AS i, note_type, start_beat, CASE WHEN ok THEN cut_at - start_beat ELSE duration END AS duration, pitch, syllable FROM f
      UNION ALL SELECT song, pos, 1, note_type, cut_at, start_beat + duration - cut_at, pitch, '~' FROM f WHERE ok)
    SELECT song, row_number() OVER (PARTITION BY song ORDER BY pos, i) - 1 AS pos, note_type, start_beat, duration, pitch, syllable FROM p""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    at = F.when(F.col("pos") % 12 == 1, F.col("start_beat") + 3)
    return _out(E.split_notes(chart, _pick(chart, "pos % 6 = 1", at=at), KEYS, POS))


@query(
    "edit_merge",
    "WITH " + roles.CHART_SQL + """,
    a AS (SELECT *, lag(pos % 7 = 2 AND note_type <> '-' OR pos % 7 = 3 AND note_type <> '-') OVER (PARTITION BY song ORDER BY pos) AS pm FROM chart),
    g AS (SELECT *, sum(CASE WHEN coalesce(pm, FALSE) AND note_type <> '-' THEN 0 ELSE 1 END) OVER (PARTITION BY song ORDER BY pos) AS k FROM a)
    SELECT song, CAST(k - 1 AS BIGINT) AS pos, arg_min(note_type, pos) AS note_type, arg_min(start_beat, pos) AS start_beat, CAST(sum(duration) AS BIGINT) AS duration, arg_min(pitch, pos) AS pitch, string_agg(syllable, '' ORDER BY pos) AS syllable FROM g GROUP BY song, k""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    return _out(E.merge_notes(chart, _pick(chart, "pos % 7 IN (2, 3)"), KEYS, POS))


@query(
    "edit_delete",
    "WITH " + roles.CHART_SQL + """
    SELECT song, row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS pos, note_type, start_beat, duration, pitch, syllable FROM chart WHERE NOT (pos % 8 = 4 AND note_type <> '-')""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    return _out(E.delete_notes(chart, _pick(chart, "pos % 8 = 4"), KEYS, POS))


@query(
    "edit_toggle",
    "WITH " + roles.CHART_SQL + """
    SELECT song, pos, CASE WHEN note_type = '-' OR pos % 3 = 2 THEN note_type WHEN pos % 3 = 0 THEN CASE WHEN note_type = '*' THEN ':' ELSE '*' END ELSE CASE WHEN note_type = 'F' THEN ':' ELSE 'F' END END AS note_type,
      start_beat, duration, pitch, syllable FROM chart""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    op = F.when(F.col("pos") % 3 == 0, "gold").otherwise("freestyle")
    return _out(E.toggle_type(chart, _pick(chart, "pos % 3 <> 2", op=op), KEYS, POS))


@query(
    "edit_lyric",
    "WITH " + roles.CHART_SQL + """
    SELECT song, pos, note_type, start_beat, duration, pitch, CASE WHEN pos % 9 = 1 AND note_type <> '-' THEN '  new ' || pos ELSE syllable END AS syllable FROM chart""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    text = F.concat(F.lit("  new "), F.col("pos").cast("string"))
    return _out(E.set_lyric(chart, _pick(chart, "pos % 9 = 1", text=text), KEYS, POS))


_AROUND = """ar AS (SELECT *, coalesce(last_value(CASE WHEN note_type <> '-' THEN start_beat + duration END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pe,
  coalesce(first_value(CASE WHEN note_type <> '-' THEN start_beat END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1000000000) AS ns FROM chart WINDOW w AS (PARTITION BY song ORDER BY pos))"""


@query(
    "edit_move",
    f"WITH {roles.CHART_SQL}, {_AROUND}" + """
    SELECT song, pos, note_type, CASE WHEN pos % 4 = 1 AND note_type <> '-' THEN greatest(pe, least(ns - 1, start_beat + pos % 21 - 10)) ELSE start_beat END AS start_beat, duration,
      CAST(CASE WHEN pos % 4 = 1 AND note_type <> '-' THEN greatest(50, least(70, pitch + pos % 13 - 6)) ELSE pitch END AS INTEGER) AS pitch, syllable FROM ar""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    moves = _pick(chart, "pos % 4 = 1", d_beat=F.col("pos") % 21 - 10, d_pitch=F.col("pos") % 13 - 6)
    return _out(E.move_notes(chart, moves, KEYS, POS, 50, 70))


@query(
    "edit_resize",
    f"WITH {roles.CHART_SQL}, {_AROUND}, " + """
    z AS (SELECT *, pos % 4 = 2 AND note_type <> '-' AS hit, pos % 8 = 2 AS lft, greatest(pe, least(start_beat + duration - 1, start_beat + pos % 17 - 8)) AS nl FROM ar)
    SELECT song, pos, note_type, CASE WHEN hit AND lft THEN nl ELSE start_beat END AS start_beat,
      CASE WHEN hit AND lft THEN start_beat + duration - nl WHEN hit THEN greatest(1, least(ns - start_beat, duration + pos % 17 - 8)) ELSE duration END AS duration, pitch, syllable FROM z""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    side = F.when(F.col("pos") % 8 == 2, "left").otherwise("right")
    return _out(E.resize_notes(chart, _pick(chart, "pos % 4 = 2", d_beat=F.col("pos") % 17 - 8, side=side), KEYS, POS))


_LINED = roles.CHART_SQL + ", li AS (SELECT *, CAST(sum(CASE WHEN note_type = '-' THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY pos) AS BIGINT) AS line FROM chart)"


def _lines(chart, cond, **extra):
    lines = G.line_numbers(chart, KEYS, POS).select("song", "line_no").distinct()
    return lines.where(cond).select("song", "line_no", *[v.alias(k) for k, v in extra.items()])


@query(
    "shift_line",
    "WITH " + _LINED + """
    SELECT song, pos, note_type, CASE WHEN note_type <> '-' AND line % 3 = 0 THEN greatest(0, start_beat + CASE WHEN line % 2 = 0 THEN -1 ELSE 1 END) ELSE start_beat END AS start_beat, duration, pitch, syllable FROM li""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    step = F.when(F.col("line_no") % 2 == 0, -1).otherwise(1)
    return _out(E.shift_lines(chart, _lines(chart, "line_no % 3 = 0", d_beat=step), KEYS, POS))


@query(
    "edit_lines",
    "WITH " + _LINED + """,
    op AS (SELECT *, CASE WHEN (line + song) % 4 = 0 THEN 'remove' WHEN (line + song) % 4 = 2 THEN 'insert' END AS op FROM li),
    kp AS (SELECT * FROM op WHERE op IS NULL OR op <> 'remove'),
    k2 AS (SELECT * FROM (SELECT *, min(pos) OVER (PARTITION BY song) AS top FROM kp) WHERE NOT (pos = top AND note_type = '-' AND line > 0)),
    la AS (SELECT song, line, max(pos) AS o, arg_max(start_beat + duration, pos) AS en, arg_max(pitch, pos) AS pitch FROM op WHERE op = 'insert' AND note_type <> '-' GROUP BY song, line),
    u AS (SELECT song, pos AS o, 0 AS s, note_type, start_beat, duration, pitch, syllable FROM k2 UNION ALL SELECT song, o, 1, '-', en, 0, 0, '' FROM la UNION ALL SELECT song, o, 2, ':', en, 1, pitch, 'New Line' FROM la)
    SELECT song, row_number() OVER (PARTITION BY song ORDER BY o, s) - 1 AS pos, note_type, start_beat, duration, pitch, syllable FROM u""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    turn = (F.col("line_no") + F.col("song")) % 4
    ops = _lines(chart, turn.isin(0, 2), op=F.when(turn == 0, "remove").otherwise("insert"))
    return _out(E.edit_lines(chart, ops, KEYS, POS))


@query(
    "copy_to_repeats",
    "WITH " + _LINED + """,
    sg AS (SELECT * FROM li WHERE note_type <> '-'),
    hd AS (SELECT song, line, arg_min(start_beat, pos) AS first, min(pos) AS o0, arg_min(pitch, pos) % 6 AS k FROM sg GROUP BY song, line),
    sr AS (SELECT song, k, min(line) AS src FROM hd WHERE line % 5 = 1 GROUP BY song, k),
    tg AS (SELECT song, line, src, first, o0 FROM hd JOIN sr USING (song, k) WHERE line <> src),
    cp AS (SELECT t.song, t.line, t.o0 AS o, s.pos AS sub, s.note_type, t.first + s.start_beat - h.first AS start_beat, s.duration, s.pitch, s.syllable, TRUE AS c FROM tg t JOIN sg s ON s.song = t.song AND s.line = t.src JOIN hd h ON h.song = t.song AND h.line = t.src),
    kp AS (SELECT song, line, pos AS o, -1 AS sub, note_type, start_beat, duration, pitch, syllable, FALSE AS c FROM li WHERE note_type = '-' OR (song, line) NOT IN (SELECT (song, line) FROM tg)),
    al AS (SELECT * FROM kp UNION ALL SELECT * FROM cp),
    en AS (SELECT song, line, max(start_beat + duration) AS z, arg_min(start_beat, o * 100000 + sub) AS a, bool_or(c) AS c FROM al WHERE note_type <> '-' GROUP BY song, line),
    fl AS (SELECT song, line, c AND coalesce(z > lead(a) OVER (PARTITION BY song ORDER BY line), FALSE) AS too_long FROM en)
    SELECT al.song, row_number() OVER (PARTITION BY al.song ORDER BY o, sub) - 1 AS pos, note_type, start_beat, duration, pitch, syllable, coalesce(too_long, FALSE) AS too_long FROM al LEFT JOIN fl ON fl.song = al.song AND fl.line = al.line""",
)
def _(spark, sf):
    chart = roles.chart(spark, sf)
    lined = stage(G.line_numbers(chart, KEYS, POS))
    keys = lined.where("note_type <> '-'").groupBy("song", "line_no").agg((F.min_by("pitch", "pos") % 6).alias("line_key"))
    sources = keys.where("line_no % 5 = 1").select("song", "line_no")
    out = E.copy_to_repeats(lined.drop("line_no"), sources, keys, KEYS, POS, lined)
    return out.select(*[c.strip() for c in _ALL.split(",")], "too_long")
