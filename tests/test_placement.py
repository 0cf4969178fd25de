"""Pitches of placed words: from frames, from the transcript, and without any match."""

import pytest
from pyspark.sql import functions as F

from strophe.functions.text import first_problem, suffix
from strophe.operators import matching as M
from strophe.operators import placement as P
from strophe.operators.stats import ladder_median
from strophe.operators.words import dictionary_language

SONGS = {
    "frames": [("alpha", 1.0, 2.0, 50), ("bravo", 3.0, 4.0, 52), ("charlie", 5.0, 6.0, 54), ("delta", 7.0, 8.0, 56), ("echo", 9.0, 9.5, 58)],
    "unlike": [("mm", 0.0, 1.0, 55), ("ll", 1.0, 2.0, 57)],
    "partly": [("alpha", 0.0, 1.0, 50), ("mm", 1.0, 2.0, 57)],
}
LYRICS = {"frames": [w for w, *_ in SONGS["frames"]], "unlike": ["xxxx", "qqqq", "vvvv"], "partly": ["alpha", "qqqq"]}
FRAMES = [(1.0, 70, 0.9), (1.5, 71, 0.6), (2.0, 80, 0.9), (1.2, 40, 0.4)]  # above 0.5: 70, 71, 80
FRAMES += [(3.1, 61, 0.35), (3.2, 62, 0.45), (3.3, 90, 0.2)]  # above 0.3 only: 61.5, a half to even
FRAMES += [(5.5, 33, 0.05), (5.6, 0, 0.9)]  # frames, but none that counts
FRAMES += [(7.5, 62, 0.2), (7.6, 63, 0.15), (8.5, 99, 0.9)]  # above 0.1: 62.5; the last lies in no word
PITCHES = {
    "frames": [71, 62, 60, 62, 58],  # the last word has no frame: its transcript word's pitch
    "unlike": [55, 57, 57],  # no match: the transcript words' pitches in order, the last one's beyond them
    "partly": [50, 50],
}


def test_pitches_of_placed_words(spark):
    words = [(s, k, w, 0) for s, ws in LYRICS.items() for k, w in enumerate(ws)]
    said = [(s, k, *w) for s, ws in SONGS.items() for k, w in enumerate(ws)]
    out = P.place_words(
        spark.createDataFrame(words, "song string, pos long, word string, line_no long"),
        spark.createDataFrame(said, "song string, pos long, word string, start double, end double, midi int"),
        spark.createDataFrame([], "song string, pause_idx long, pause_start double, pause_end double"), ["song"],
        frames=spark.createDataFrame([("frames", *f) for f in FRAMES], "song string, t double, midi int, conf double"),
    ).orderBy("pos").collect()
    assert {s: [r.midi for r in out if r.song == s] for s in SONGS} == PITCHES


def test_frames_of_orphan_words_are_theirs(spark):
    notes = [(1, 0, 0, 0.0, 1.0), (1, 1, 0, 2.0, 3.0), (1, 2, 1, 20.0, 21.0), (1, 3, 1, 24.0, 25.0)]
    words = [(1, 0, 0.1, 0.9), (1, 1, 1.2, 1.8), (1, 2, 10.0, 11.0), (1, 3, 22.0, 22.5)]
    frames = [(1, 0, 0.5), (1, 1, 1.5), (1, 2, 1.9), (1, 3, 10.5), (1, 4, 21.9), (1, 5, 22.2), (1, 6, 23.9)]
    out = M.preview(
        spark.createDataFrame(notes, "song long, note long, verse long, s double, e double"),
        spark.createDataFrame(words, "song long, word long, ws double, we double"),
        spark.createDataFrame([(1, 0, 0.0, 3.0), (1, 1, 20.0, 25.0)], "song long, verse long, vs double, ve double"),
        spark.createDataFrame(frames, "song long, frame long, t double"), ["song"], 50.0, 1000.0,
    )
    got = {(r.verse, r.orphan, r.id, r.word, r.n_frames) for r in out.collect()}
    assert got == {
        (0, False, 0, 0, 1), (0, False, 1, None, 1), (0, True, 1, 1, 1),  # 1.9 goes to the note at 2.0
        (1, False, 2, None, 0), (1, False, 3, None, 0), (1, True, 3, 3, 3),  # 21.9 is first: both strays to the orphan at 22.0
        (0, True, 2, 2, 1),  # outside all verses: its own frame
    }


def test_bounded_ladder_equals_the_counted_one(spark):
    rows = [(k % 5, (k * 37) % 23, ((k * 13) % 10) / 10) for k in range(200)] + [(9, 0, 0.9), (8, 5, 0.0)]
    df = spark.createDataFrame(rows, "k long, v long, c double")
    one, two = (ladder_median(df, ["k"], "v", "c", bounded=b).select("k", "median", F.col("used").cast("long")) for b in (True, False))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0 and one.count() == 5


@pytest.mark.parametrize(
    "name, want", [("a.MP3", ".mp3"), ("x/y.z/clip", ""), (".mp3", ""), ("take.2.ogg", ".ogg"), ("", ""), (None, "")]
)
def test_suffix(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(suffix(F.col("n"))).first()[0] == want


def test_upload_rules(spark):
    schema = "ok boolean, title string, artist string, lyrics string, mode string, name string, n long, cover string, m long"
    good = (True, "t", "a", "l", "full", "s.mp3", 5, "c.jpg", 5)
    cases = {
        None: good, "no_media": (False, *good[1:]), "no_title": (True, " ", *good[2:]), "media_type": (*good[:5], "s.txt", *good[6:]),
        "media_size": (*good[:6], 1 << 40, *good[7:]), "cover_type": (*good[:7], "c.png", 5), "cover_size": (*good[:8], 1 << 40),
    }
    rows = [*cases.values(), (True, "", "", "", "split", "s.ogg", 5, None, None), (*good[:7], None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(first_problem(*[F.col(c) for c in df.columns])).collect()]
    assert got == [*cases, None, None]


def test_language_falls_back_to_its_first_part(spark):
    codes = ["en", "de-ch", "it-it", "xx-yy-zz", "EN", "zz"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r[0] for r in df.select(dictionary_language(F.col("c"))).collect()]
    assert got == ["en_US", "de_DE", "it", "xx", "EN", "zz"]
