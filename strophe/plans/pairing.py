"""Queries that pair rows of two sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.text import line_key, normalize_token
from strophe.operators import lyrics as L
from strophe.operators import matching as M
from strophe.operators import ordered as O
from strophe.operators.ranges import overlap_join, points_in_intervals
from strophe.plans import roles
from strophe.plans.registry import query, table
from strophe.plans.scalars import SCORE_SQL

# A second version of each chart: beats, lengths and pitches moved, some notes lost.
_GEN = roles.CHART_SQL + """,
gen AS (SELECT song, pos, note_type, start_beat + pos % 11 - 5 AS start_beat, duration + pos % 3 AS duration, CAST(pitch + pos % 9 - 4 AS INTEGER) AS pitch,
    CASE WHEN pos % 13 = 0 THEN 'x' ELSE syllable END AS syllable FROM chart WHERE NOT (song % 4 = 0 AND pos % 53 = 0)),
oi AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS nth FROM chart WHERE note_type <> '-'),
gi AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS nth FROM gen WHERE note_type <> '-'),
d AS (SELECT o.song, o.nth, o.syllable AS os, g.syllable AS gs, o.syllable = g.syllable AS syllable_match, o.start_beat AS ob, g.start_beat AS gb,
    g.start_beat - o.start_beat AS beat_offset, g.duration - o.duration AS duration_diff, g.pitch - o.pitch AS pitch_diff, o.start_beat AS osb, o.duration AS od, g.duration AS gd, o.pitch AS op, g.pitch AS gp,
    abs(g.start_beat - o.start_beat) <= 4 AND abs(g.duration - o.duration) <= 4 AND abs(g.pitch - o.pitch) <= 3 AS passed
  FROM oi o JOIN gi g ON o.song = g.song AND o.nth = g.nth)"""


def _both(spark, sf):
    chart = roles.chart(spark, sf)
    pos = F.col("pos")
    gen = chart.where(~((F.col("song") % 4 == 0) & (pos % 53 == 0))).select(
        "song", "pos", "note_type",
        (F.col("start_beat") + pos % 11 - 5).alias("start_beat"),
        (F.col("duration") + pos % 3).alias("duration"),
        (F.col("pitch") + pos % 9 - 4).cast("int").alias("pitch"),
        F.when(pos % 13 == 0, "x").otherwise(F.col("syllable")).alias("syllable"),
    )
    return chart, gen


@query(
    "diff_notes",
    "WITH " + _GEN + " SELECT song, nth, syllable_match, beat_offset, duration_diff, pitch_diff, passed FROM d",
)
def _(spark, sf):
    chart, gen = _both(spark, sf)
    return M.diff_notes(chart, gen, ["song"], "pos").select(
        "song", "nth", "syllable_match", "beat_offset", "duration_diff", "pitch_diff", "passed"
    )


_HEADERS = """h AS (SELECT o_orderkey AS song, o_orderpriority AS t, CASE WHEN o_orderkey % 10 = 0 THEN 'other' ELSE o_orderpriority END AS t2,
    o_orderstatus AS a, CASE WHEN o_orderkey % 17 = 0 THEN '?' ELSE o_orderstatus END AS a2, 60 + o_orderkey % 120 AS b, (o_orderkey % 7 - 3) * 0.9::DOUBLE AS db,
    o_orderkey % 2000 AS g, o_orderkey % 2000 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS g2 FROM orders)"""


def _headers(spark, sf, song="o_orderkey"):
    k = F.col("o_orderkey")
    base = table(spark, sf, "orders")
    bpm = (60 + k % 120).cast("double")
    a = base.select(k.alias("song"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("artist"), bpm.alias("bpm"), (k % 2000).alias("gap"))
    b = base.select(
        k.alias("song"),
        F.when(k % 10 == 0, "other").otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(k % 17 == 0, "?").otherwise(F.col("o_orderstatus")).alias("artist"),
        (bpm + (k % 7 - 3) * 0.9).alias("bpm"),
        (k % 2000 + F.when(k % 19 == 0, 1).otherwise(0)).alias("gap"),
    )
    return a, b


@query(
    "diff_headers",
    f"""WITH {_HEADERS} SELECT song, t = t2 AS title_match, a = a2 AS artist_match, round(abs(b - (b + db)), 6) AS bpm_diff, abs(b - (b + db)) <= 2.0 AS bpm_pass, g = g2 AS gap_pass FROM h""",
)
def _(spark, sf):
    a, b = _headers(spark, sf)
    return M.diff_headers(a, b, ["song"]).withColumn("bpm_diff", F.round("bpm_diff", 6))


@query(
    "diff_report",
    "WITH " + _GEN + f""", {_HEADERS},
    oc AS (SELECT song, count(*) FILTER (note_type <> '-') AS orig_notes, count(*) FILTER (note_type = '-') AS orig_breaks FROM chart GROUP BY song),
    gc AS (SELECT song, count(*) FILTER (note_type <> '-') AS gen_notes, count(*) FILTER (note_type = '-') AS gen_breaks FROM gen GROUP BY song),
    f AS (SELECT song, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS ok FROM d GROUP BY song)
    SELECT h.song, coalesce(orig_notes, 0) AS orig_notes, coalesce(gen_notes, 0) AS gen_notes, coalesce(orig_notes, 0) = coalesce(gen_notes, 0) AS note_count_pass,
      coalesce(orig_breaks, 0) AS orig_breaks, coalesce(gen_breaks, 0) AS gen_breaks, coalesce(failed, 0) AS failed,
      t = t2 AND a = a2 AND abs(b - (b + db)) <= 2.0 AND g = g2 AND coalesce(orig_notes, 0) = coalesce(gen_notes, 0) AND coalesce(ok, TRUE) AS passed
    FROM h LEFT JOIN oc USING (song) LEFT JOIN gc USING (song) LEFT JOIN f USING (song)""",
)
def _(spark, sf):
    chart, gen = _both(spark, sf)
    a, b = _headers(spark, sf)
    notes = M.diff_notes(chart, gen, ["song"], "pos")
    return M.diff_report(chart, gen, ["song"], M.diff_headers(a, b, ["song"]), notes)


@query(
    "first_failures",
    "WITH " + _GEN + """ SELECT song, nth, beat_offset, pitch_diff FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY nth) AS k FROM d WHERE NOT passed) WHERE k <= 20""",
)
def _(spark, sf):
    chart, gen = _both(spark, sf)
    return M.first_failures(M.diff_notes(chart, gen, ["song"], "pos"), ["song"]).select(
        "song", "nth", "beat_offset", "pitch_diff"
    )


@query(
    "score_pairs",
    "WITH " + _GEN + """ SELECT song, count(*) AS matched, round(sqrt(avg((ob - gb) * (ob - gb))), 6) AS timing_rmse, round(sqrt(avg((od - gd) * (od - gd))), 6) AS duration_rmse,
      round(avg(abs(((op - gp + 6) % 12 + 12) % 12 - 6)), 6) AS pitch_distance, max(abs(ob - gb)) AS worst_start FROM d GROUP BY song""",
)
def _(spark, sf):
    chart, gen = _both(spark, sf)
    pairs = M.diff_notes(chart, gen, ["song"], "pos").select(
        "song", F.col("orig_start_beat").alias("a_start"), F.col("gen_start_beat").alias("b_start"),
        F.col("orig_duration").alias("a_duration"), F.col("gen_duration").alias("b_duration"),
        F.col("orig_pitch").alias("a_pitch"), F.col("gen_pitch").alias("b_pitch"),
    )
    out = M.score_pairs(pairs, ["song"])
    return out.withColumns({c: F.round(c, 6) for c in ("timing_rmse", "duration_rmse", "pitch_distance")})


_DRIFT = roles.CHART_SQL + """,
n AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS nth, song % 500 + start_beat * (60000.0::DOUBLE / 150 / 4) AS ns, song % 500 + (start_beat + duration) * (60000.0::DOUBLE / 150 / 4) AS ne
      FROM chart WHERE note_type <> '-'),
s AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS nth, start_ms / 1000.0::DOUBLE AS st, end_ms / 1000.0::DOUBLE AS en, CASE WHEN pos % 3 = 0 THEN 0 ELSE end_ms / 1000.0::DOUBLE + 0.02 END AS pe
      FROM sung WHERE NOT is_break),
dr AS (SELECT song, nth, ns - st * 1000 AS drift_start, ne - en * 1000 AS drift_end, en, pe FROM n JOIN s USING (song, nth))"""


def _drift(spark, sf):
    s = roles.sung(spark, sf).where("NOT is_break").select(
        "song", "pos", (F.col("start_ms") / F.lit(1000.0)).alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end"),
        F.when(F.col("pos") % 3 == 0, F.lit(0.0)).otherwise(F.col("end_ms") / F.lit(1000.0) + 0.02).alias("pitch_end"),
    )
    return M.drift_pairs(roles.chart(spark, sf), s, ["song"], "pos", F.lit(150), F.col("song") % 500)


@query(
    "drift_pairs",
    "WITH " + _DRIFT + " SELECT song, nth, round(drift_start, 6) AS drift_start, round(drift_end, 6) AS drift_end FROM dr",
)
def _(spark, sf):
    return _drift(spark, sf).select(
        "song", "nth", F.round("drift_start", 6).alias("drift_start"), F.round("drift_end", 6).alias("drift_end")
    )


@query(
    "drift_stats",
    "WITH " + _DRIFT + """ SELECT song, round(avg(drift_start), 4) AS mean_start, round(avg(drift_end), 4) AS mean_end, round(max(abs(drift_start)), 4) AS max_start, round(max(abs(drift_end)), 4) AS max_end,
      round(100.0::DOUBLE * count(*) FILTER (pe > 0) / count(*), 4) AS extended_pct, round(coalesce(avg(pe - en) FILTER (pe > 0) * 1000, 0), 4) AS mean_extension FROM dr GROUP BY song""",
)
def _(spark, sf):
    out = M.drift_stats(_drift(spark, sf), ["song"])
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "song"})


# ---- intervals -----------------------------------------------------------------------


@query(
    "overlap_join",
    """WITH o AS (SELECT o_custkey % 100 AS song, o_orderkey, epoch_us(o_orderdate) / 1000000.0 AS os, epoch_us(o_orderdate) / 1000000.0 + (o_orderkey % 9) * 86400 AS oe FROM orders),
    l AS (SELECT l_suppkey % 100 AS song, l_orderkey, l_partkey, epoch_us(l_shipdate) / 1000000.0 AS ls, epoch_us(l_shipdate) / 1000000.0 + (l_partkey % 5) * 86400 AS le FROM lineitem)
    SELECT song, o_orderkey, l_orderkey, l_partkey, least(oe, le) - greatest(os, ls) AS overlap FROM o JOIN l USING (song) WHERE le > os AND ls < oe""",
)
def _(spark, sf):
    day = roles.DAY
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).alias("song"), "o_orderkey", roles.seconds("o_orderdate").alias("os")
    ).withColumn("oe", F.col("os") + (F.col("o_orderkey") % 9) * day)
    li = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 100).alias("song"), "l_orderkey", "l_partkey", roles.seconds("l_shipdate").alias("ls")
    ).withColumn("le", F.col("ls") + (F.col("l_partkey") % 5) * day)
    return overlap_join(o, li, ["song"], ("os", "oe"), ("ls", "le"), 8 * day).select(
        "song", "o_orderkey", "l_orderkey", "l_partkey", "overlap"
    )


# Notes, words and verses on the timeline of each user: every third event is a note, the others are words.
_SPANS = roles.FRAMES_SQL + """,
nt AS (SELECT song, id AS note, t AS s, t + 40000 AS e, CAST(floor(t / 432000) AS BIGINT) AS verse FROM frames WHERE id % 3 = 0),
wd AS (SELECT song, id AS word, t - 20000 AS ws, t + 30000 AS we FROM frames WHERE id % 3 <> 0),
vs AS (SELECT song, verse, arg_min(s, note) AS vs, arg_max(e, note) AS ve FROM nt GROUP BY song, verse),
cl AS (SELECT word FROM wd WHERE word % 2 = 0),
fr AS (SELECT song, id AS frame, t FROM frames)"""


def _spans(spark, sf):
    fr = roles.frames(spark, sf)
    notes = fr.where("id % 3 = 0").select(
        "song", F.col("id").alias("note"), F.col("t").alias("s"), (F.col("t") + 40000).alias("e"),
        F.floor(F.col("t") / 432000).alias("verse"),
    )
    words = fr.where("id % 3 <> 0").select(
        "song", F.col("id").alias("word"), (F.col("t") - 20000).alias("ws"), (F.col("t") + 30000).alias("we")
    )
    verses = notes.groupBy("song", "verse").agg(F.min_by("s", "note").alias("vs"), F.max_by("e", "note").alias("ve"))
    return notes, words, verses, fr.select("song", F.col("id").alias("frame"), "t")


W = 50000.0


@query(
    "frames_in_interval",
    "WITH " + _SPANS + " SELECT song, note, frame, t - s AS lag FROM nt JOIN fr USING (song) WHERE t >= s AND t <= e",
)
def _(spark, sf):
    notes, _, _, frames = _spans(spark, sf)
    return points_in_intervals(frames, notes, ["song"], "t", ("s", "e"), W).select(
        "song", "note", "frame", (F.col("t") - F.col("s")).alias("lag")
    )


@query(
    "claim_best_overlap",
    "WITH RECURSIVE " + _SPANS + """,
    pr AS (SELECT song, note, word, least(e, we) - greatest(s, ws) AS shared FROM nt JOIN wd USING (song) WHERE e > ws AND s < we AND least(e, we) > greatest(s, ws)),
    cand AS (SELECT song, note, list(word ORDER BY shared DESC, word) AS words, row_number() OVER (PARTITION BY song ORDER BY note) AS k FROM pr GROUP BY song, note),
    go AS (SELECT song, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS note, CAST(NULL AS BIGINT) AS word, CAST([] AS BIGINT[]) AS taken FROM cand WHERE k = 1
      UNION ALL SELECT song, k, note, word, CASE WHEN word IS NULL THEN taken ELSE list_append(taken, word) END
      FROM (SELECT go.song, cand.k, cand.note, go.taken, list_filter(cand.words, lambda x: NOT list_contains(go.taken, x))[1] AS word FROM go JOIN cand ON cand.song = go.song AND cand.k = go.k + 1))
    SELECT song, note, word FROM go WHERE word IS NOT NULL""",
)
def _(spark, sf):
    """Each note in turn claims the free word it overlaps most."""
    notes, words, _, _ = _spans(spark, sf)
    return M.claim_best_overlap(notes, words, ["song"], "note", "word", ("s", "e"), ("ws", "we"), W)


@query(
    "orphans",
    "WITH " + _SPANS + """
    SELECT song, word, min(verse) AS verse, max(greatest(we - ws, 10)) AS length FROM wd JOIN vs USING (song) WHERE word NOT IN (SELECT word FROM cl) AND we > vs AND ws < ve GROUP BY song, word""",
)
def _(spark, sf):
    _, words, verses, _ = _spans(spark, sf)
    claimed = words.where("word % 2 = 0").select("song", "word")
    return M.orphan_words(words, claimed, verses, ["song"], "word", "verse", ("ws", "we"), ("vs", "ve"), W).select(
        "song", "word", "verse", "length"
    )


@query(
    "union_orphans",
    "WITH " + _SPANS + """,
    o AS (SELECT song, word, min(verse) AS verse FROM wd JOIN vs USING (song) WHERE word NOT IN (SELECT word FROM cl) AND we > vs AND ws < ve GROUP BY song, word)
    SELECT song, note AS id, s AS start, verse, FALSE AS orphan FROM nt UNION ALL SELECT song, word, ws, verse, TRUE FROM o JOIN wd USING (song, word)""",
)
def _(spark, sf):
    notes, words, verses, _ = _spans(spark, sf)
    claimed = words.where("word % 2 = 0").select("song", "word")
    orphans = M.orphan_words(words, claimed, verses, ["song"], "word", "verse", ("ws", "we"), ("vs", "ve"), W)
    return M.with_orphans(
        notes.select("song", F.col("note").alias("id"), F.col("s").alias("start"), "verse"),
        orphans.select("song", F.col("word").alias("id"), F.col("ws").alias("start"), "verse"),
    )


@query(
    "orphan_frames",
    "WITH " + _SPANS + """,
    iv AS (SELECT song, verse, frame, t FROM fr JOIN vs USING (song) WHERE t >= vs AND t <= ve),
    og AS (SELECT * FROM iv WHERE NOT EXISTS (SELECT 1 FROM nt WHERE nt.song = iv.song AND nt.verse = iv.verse AND iv.t >= nt.s AND iv.t <= nt.e)),
    f AS (SELECT song, verse, arg_min(t, frame) AS t0 FROM og GROUP BY song, verse),
    tg AS (SELECT song, verse, note FROM (SELECT *, row_number() OVER (PARTITION BY song, verse ORDER BY abs(s - t0), note) AS rn FROM nt JOIN f USING (song, verse)) WHERE rn = 1)
    SELECT song, verse, frame, note FROM og JOIN tg USING (song, verse)""",
)
def _(spark, sf):
    notes, _, verses, frames = _spans(spark, sf)
    return M.orphan_frames(
        notes, frames, verses, ["song"], "note", "frame", "verse", ("s", "e"), ("vs", "ve"), "t", W
    )


@query(
    "except_used",
    "WITH " + _SPANS + """
    SELECT song, frame FROM fr WHERE NOT EXISTS (SELECT 1 FROM nt WHERE nt.song = fr.song AND fr.t >= nt.s AND fr.t <= nt.e)""",
)
def _(spark, sf):
    notes, _, _, frames = _spans(spark, sf)
    used = points_in_intervals(frames, notes, ["song"], "t", ("s", "e"), W)
    return M.except_used(frames, used, ["song", "frame"]).select("song", "frame")


@query(
    "nearest_interval",
    "WITH " + _SPANS + """
    SELECT song, word, verse FROM (SELECT song, word, verse, row_number() OVER (PARTITION BY song, word ORDER BY least(abs(vs - ws), abs(ve - we)), verse) AS rn FROM wd JOIN vs USING (song)) WHERE rn = 1""",
)
def _(spark, sf):
    _, words, verses, _ = _spans(spark, sf)
    return M.nearest_verse(words, verses, ["song"], "word", "verse", ("ws", "we"), ("vs", "ve"), roles.DAY)


@query(
    "match_by_label",
    "WITH RECURSIVE " + roles.FRAMES_SQL + """,
    a AS (SELECT song, trim(kind) AS label, id, t, row_number() OVER (PARTITION BY song, trim(kind) ORDER BY id) AS k FROM frames WHERE id % 2 = 0),
    b AS (SELECT song, trim(kind) AS label, list({'i': id, 't': t}) AS bs FROM frames WHERE id % 2 = 1 GROUP BY ALL),
    go AS (SELECT song, label, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS a_id, CAST(NULL AS BIGINT) AS b_id, bs AS free FROM b
      UNION ALL SELECT song, label, k, a_id, pick.i, list_filter(free, lambda x: x.i <> pick.i)
      FROM (SELECT go.song, go.label, a.k, a.id AS a_id, go.free, list_sort(list_transform(go.free, lambda x: {'d': abs(x.t - a.t), 'i': x.i}))[1] AS pick
        FROM go JOIN a ON a.song = go.song AND a.label = go.label AND a.k = go.k + 1 WHERE len(go.free) > 0))
    SELECT song, a_id, b_id FROM go WHERE b_id IS NOT NULL""",
)
def _(spark, sf):
    """Notes with the same label paired nearest first, each used once."""
    fr = roles.frames(spark, sf).select("song", F.col("kind").alias("label"), F.col("t").alias("at"), "id")
    return M.match_by_label(fr.where("id % 2 = 0"), fr.where("id % 2 = 1"), ["song"], "label", "at", "id")


@query("preview_dataset")
def _(spark, sf):
    """Notes with the words they claim, orphan words placed in verses, and frames per note."""
    notes, words, verses, frames = _spans(spark, sf)
    return M.preview(notes, words, verses, frames, ["song"], W, roles.DAY)


@query(
    "attach_pitch",
    "WITH " + roles.FRAMES_SQL + """,
    wd AS (SELECT song, id AS word, t AS s, t + 200000 AS e FROM frames WHERE id % 10 = 0),
    h AS (SELECT w.song, word, amp, conf FROM wd w JOIN frames f ON f.song = w.song AND t >= s AND t <= e AND amp > 0 AND conf > 0.1),
    g AS (SELECT song, word, count(*) AS n, coalesce(median(amp) FILTER (conf > 0.5), median(amp) FILTER (conf > 0.3), median(amp) FILTER (conf > 0.1)) AS hz FROM h GROUP BY song, word)
    SELECT song, word, CAST(coalesce(round_even(12 * log2(hz / 440) + 69, 0), 60) AS INTEGER) AS midi, coalesce(n, 0) AS n_frames FROM wd LEFT JOIN g USING (song, word)""",
)
def _(spark, sf):
    fr = roles.frames(spark, sf)
    words = fr.where("id % 10 = 0").select("song", F.col("id").alias("word"), F.col("t").alias("s"), (F.col("t") + 200000).alias("e"))
    return M.attach_pitch(words, fr, ["song"], "word", ("s", "e"), "t", "amp", "conf", 200000.0)


# ---- pauses, regions, lines -------------------------------------------------------------

_PAUSES = roles.TIMED_SQL + """,
ps AS (SELECT song, run, pos AS pause_idx, start_ms + 200 AS pause_start, start_ms + 200 + pos % 9 * 60 AS pause_end FROM timed WHERE pos % 5 = 2)"""


def _pauses(words):
    return words.where("pos % 5 = 2").select(
        "song", "run", F.col("pos").alias("pause_idx"), (F.col("start_ms") + 200).alias("pause_start"),
        (F.col("start_ms") + 200 + F.col("pos") % 9 * 60).alias("pause_end"),
    )


@query(
    "first_gap_between",
    "WITH " + _PAUSES + """,
    p AS (SELECT *, lead(end_ms) OVER (PARTITION BY song, run ORDER BY pos) AS ne FROM timed)
    SELECT p.song, p.run, p.pos, min(pause_idx) AS pause_idx FROM p JOIN ps ON p.song = ps.song AND p.run = ps.run AND p.start_ms <= pause_start AND pause_end <= ne GROUP BY p.song, p.run, p.pos""",
)
def _(spark, sf):
    words = roles.timed_words(spark, sf)
    return M.first_gap_between(words, _pauses(words), ["song", "run"], "pos", "start_ms", "end_ms", 2000)


@query(
    "unused_between",
    "WITH " + roles.TIMED_SQL + """,
    a AS (SELECT song, run, pos, pos AS lo, pos + pos % 3 AS hi FROM timed WHERE pos % 7 IN (0, 1)),
    g AS (SELECT *, lag(pos) OVER w AS po, lag(hi) OVER w AS ph FROM a WINDOW w AS (PARTITION BY song, run ORDER BY pos))
    SELECT g.song, g.run, g.pos, x.start_ms AS unused_start, y.end_ms AS unused_end FROM g JOIN timed x ON x.song = g.song AND x.run = g.run AND x.pos = ph + 1
      JOIN timed y ON y.song = g.song AND y.run = g.run AND y.pos = lo - 1 WHERE g.pos - po > 1 AND lo - ph > 1""",
)
def _(spark, sf):
    words = roles.timed_words(spark, sf)
    anchors = words.where("pos % 7 IN (0, 1)").select(
        "song", "run", "pos", F.col("pos").alias("lo"), (F.col("pos") + F.col("pos") % 3).alias("hi")
    )
    return M.unused_between(anchors, words, ["song", "run"], "pos", "lo", "hi", "pos", "start_ms", "end_ms")


_CUTS = roles.TIMED_SQL + """,
cut AS (SELECT song, run, start_ms / 1000.0::DOUBLE AS cut FROM timed WHERE pos % 20 = 10),
mids AS (SELECT song, run, pos, (start_ms + end_ms) / 2000.0::DOUBLE - pos % 4 * 3 AS mid FROM timed)"""


def _cuts(words):
    cuts = words.where("pos % 20 = 10").select("song", "run", (F.col("start_ms") / F.lit(1000.0)).alias("cut"))
    return cuts, (F.col("start_ms") + F.col("end_ms")) / F.lit(2000.0) - F.col("pos") % 4 * 3


_REGION = """rg AS (SELECT song, run, pos, max(c) OVER (PARTITION BY song, run ORDER BY pos) AS region FROM
    (SELECT m.song, m.run, m.pos, count(cut) AS c FROM mids m LEFT JOIN cut ON cut.song = m.song AND cut.run = m.run AND cut <= mid GROUP BY m.song, m.run, m.pos))"""


@query("assign_region", f"WITH {_CUTS}, {_REGION} SELECT * FROM rg")
def _(spark, sf):
    words = roles.timed_words(spark, sf)
    cuts, mid = _cuts(words)
    return O.assign_region(words, cuts, ["song", "run"], "pos", mid, 60.0).select("song", "run", "pos", "region")


@query(
    "pause_chunks",
    f"""WITH {_CUTS}, {_REGION},
    cn AS (SELECT song, run, cut, row_number() OVER (PARTITION BY song, run ORDER BY cut) AS k FROM cut),
    pr AS (SELECT song, run, region, count(*) AS n, min(pos) AS f, max(pos) AS l, string_agg(word, ' ' ORDER BY pos) AS tx FROM rg JOIN timed USING (song, run, pos) GROUP BY song, run, region),
    sp AS (SELECT pr.*, coalesce(a.cut, 0.0) AS s, coalesce(b.cut, 2000.0) AS e FROM pr LEFT JOIN cn a ON a.song = pr.song AND a.run = pr.run AND a.k = region LEFT JOIN cn b ON b.song = pr.song AND b.run = pr.run AND b.k = region + 1),
    fl AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND e > s AND n / (e - s) > 2.4 THEN 0 ELSE 1 END AS opens FROM sp WINDOW w AS (PARTITION BY song, run ORDER BY region)),
    gr AS (SELECT *, sum(opens) OVER (PARTITION BY song, run ORDER BY region) - 1 AS c FROM fl)
    SELECT song, run, CAST(c AS BIGINT) AS chunk_idx, string_agg(tx, ' ' ORDER BY region) AS text, min(s) AS start, max(e) AS end, min(f) AS first_word, max(l) AS last_word FROM gr GROUP BY song, run, c""",
)
def _(spark, sf):
    words = roles.timed_words(spark, sf)
    cuts, mid = _cuts(words)
    placed = O.assign_region(words, cuts, ["song", "run"], "pos", mid, 60.0)
    songs = words.select("song", "run").distinct().withColumn("duration", F.lit(2000.0))
    return O.pause_chunks(placed, cuts, songs, ["song", "run"], "region", "pos", "word", densest=2.4)


@query(
    "repeated_lines",
    "WITH " + roles.LINES_SQL + r""",
    k AS (SELECT song, line_no, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM lines),
    n AS (SELECT *, count(*) OVER (PARTITION BY song, key) - 1 AS repeats, min(line_no) OVER (PARTITION BY song, key) AS first_at FROM k)
    SELECT song, line_no, repeats, first_at FROM n WHERE repeats > 0""",
)
def _(spark, sf):
    keyed = roles.lines(spark, sf).select("song", "line_no", line_key(F.col("line")).alias("key"))
    return L.repeated_lines(keyed, ["song"], "key", "line_no").select("song", "line_no", "repeats", "first_at")


@query(
    "top_candidates",
    f"""WITH {roles.WORDS_SQL}, {SCORE_SQL},
    nw AS (SELECT song, run, pos, strip_accents(lower(word)) AS norm FROM words),
    u AS (SELECT song, run, pos, norm FROM nw), tr AS (SELECT song, run - 1 AS run, pos AS word, norm AS wn FROM nw),
    pr AS (SELECT DISTINCT norm AS a, wn AS b FROM u JOIN tr USING (song, run)),
    ai AS (SELECT a, i, substr(a, i, 1) AS c FROM (SELECT DISTINCT a FROM pr), range(1, 60) r(i) WHERE i <= length(a)),
    bj AS (SELECT DISTINCT b, substr(b, j, 1) AS c FROM (SELECT DISTINCT b FROM pr), range(1, 60) r(j) WHERE j <= length(b)),
    bs AS (SELECT b, list(c) AS pool FROM bj GROUP BY b),
    cs AS (SELECT x.c AS x, y.c AS y, CASE WHEN x.c = y.c THEN 1.0::DOUBLE ELSE coalesce(s, -0.3::DOUBLE) END AS s FROM (SELECT DISTINCT c FROM ai) x CROSS JOIN (SELECT DISTINCT c FROM bj) y LEFT JOIN pairs p ON p.x = x.c AND p.y = y.c),
    best AS (SELECT x, b, max(s) AS m FROM cs JOIN bj ON bj.c = y GROUP BY x, b),
    sc AS (SELECT pr.a, pr.b, list_reduce(list_prepend(0.0::DOUBLE, list(m ORDER BY i)), lambda p, q: p + q) / count(*) AS score FROM pr JOIN ai ON ai.a = pr.a JOIN best ON best.x = ai.c AND best.b = pr.b GROUP BY pr.a, pr.b),
    rk AS (SELECT u.song, u.run, u.pos, tr.word, score, row_number() OVER (PARTITION BY u.song, u.run, u.pos ORDER BY score DESC, tr.word) AS rank FROM u JOIN tr USING (song, run) JOIN sc ON sc.a = norm AND sc.b = wn)
    SELECT song, run, pos, CAST(rank AS INTEGER) AS rank, word, round(score, 6) AS score FROM rk WHERE rank <= 3""",
)
def _(spark, sf):
    """The words of each turn that sound most like those of the turn before it."""
    words = roles.run_words(spark, sf).select("song", "run", "pos", normalize_token(F.col("word")).alias("norm"))
    transcript = words.select("song", (F.col("run") - 1).alias("run"), F.col("pos").alias("word"), "norm")
    out = M.top_candidates(words, transcript, ["song", "run"], "pos", "norm", "word")
    return out.withColumn("score", F.round("score", 6))


@query(
    "distinct_values",
    "WITH " + roles.CHART_SQL + """ SELECT song, count(DISTINCT pitch) AS pitches, string_agg(DISTINCT pitch, ',' ORDER BY pitch) AS listed FROM chart WHERE note_type <> '-' GROUP BY song""",
)
def _(spark, sf):
    """Distinct pitches per song; at most 128 of them, so they fit a list."""
    pitches = roles.chart(spark, sf).where("note_type <> '-'").select("song", "pitch").distinct()
    return pitches.groupBy("song").agg(
        F.count(F.lit(1)).alias("pitches"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("pitch")), lambda p: p.cast("string"))).alias("listed"),
    )


