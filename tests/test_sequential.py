"""Rules without SQL: worked examples, invariants and counts by other ways."""

import random

import pytest
from pyspark.sql import functions as F

from strophe.functions import text as T
from strophe.operators import consensus as C
from strophe.operators import generate as G
from strophe.operators import lyrics as L
from strophe.operators import matching as M
from strophe.operators import ordered as O
from strophe.operators import placement as P
from strophe.operators import spectral as X


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_claims_follow_the_notes_in_turn(spark):
    rng = random.Random(1)
    notes, words = [], []
    for song in range(4):
        for k in range(60):
            a = rng.randrange(0, 200) / 2
            notes.append((song, k, a, a + rng.choice([1.0, 2.0, 4.0])))
            b = rng.randrange(0, 200) / 2
            words.append((song, k, b, b + rng.choice([0.0, 1.0, 3.0])))
    want = set()
    for song in range(4):
        taken = set()
        for s, n, a, b in [x for x in notes if x[0] == song]:
            best, most = None, 0.0
            for _, w, c, d in [x for x in words if x[0] == song]:
                shared = min(b, d) - max(a, c)
                if d > a and c < b and w not in taken and shared > most:
                    best, most = w, shared
            if best is not None:
                taken.add(best)
                want.add((song, n, best))
    got = M.claim_best_overlap(
        frame(spark, notes, "song long, note long, s double, e double"),
        frame(spark, words, "song long, word long, ws double, we double"),
        ["song"], "note", "word", ("s", "e"), ("ws", "we"), 2.0,
    )
    assert {tuple(r) for r in got.collect()} == want


def test_labels_are_matched_nearest_first_in_turn(spark):
    rng = random.Random(2)
    a = [(s, k, rng.choice(["la", " la ", "do", "x"]), float(rng.randrange(40))) for s in range(3) for k in range(50)]
    b = [(s, k, rng.choice(["la", "do "]), float(rng.randrange(40))) for s in range(3) for k in range(40)]
    want = set()
    for s in range(3):
        used = set()
        for _, k, label, at in [x for x in a if x[0] == s]:
            free = [x for x in b if x[0] == s and x[1] not in used and x[2].strip() == label.strip()]
            if free:
                best = min(free, key=lambda x: abs(x[3] - at))
                used.add(best[1])
                want.add((s, k, best[1]))
    schema = "song long, id long, label string, at double"
    got = M.match_by_label(frame(spark, a, schema), frame(spark, b, schema), ["song"], "label", "at", "id")
    assert {tuple(r) for r in got.collect()} == want


def test_pause_between_two_words(spark):
    words = frame(spark, [(1, 0, 0.0, 0.8), (1, 1, 0.7, 1.5)], "song long, pos long, s double, e double")
    pauses = frame(spark, [(1, 0, 0.6, 0.9)], "song long, pause_idx long, pause_start double, pause_end double")
    got = O.resolve_overlaps(words, pauses, ["song"], "pos", "s", "e", 1.0).orderBy("pos").collect()
    assert [(r.s, r.e) for r in got] == [(0.0, 0.6), (0.9, 1.5)]


def run_segments(spark, frames, syllables, gate):
    got = P.note_segments(
        frame(spark, syllables, "song long, syl long, start double, end double, fallback int"),
        frame(spark, frames, "song long, t double, midi int, conf double, amp double"),
        frame(spark, [(s, gate) for s in {x[0] for x in syllables}], "song long, threshold double"),
        ["song"], "syl",
    ).orderBy("song", "syl", "seg_idx").collect()
    out = {}
    for r in got:
        out.setdefault((r.song, r.syl), []).append((round(r.start, 6), round(r.end, 6), r.midi))
    return out


def test_amplitude_trims_a_note(spark):
    frames = [(1, k / 100, 60, 0.9 if 20 <= k <= 50 else 0.1, 0.8 if 20 <= k <= 50 else 0.01) for k in range(101)]
    assert run_segments(spark, frames, [(1, 0, 0.0, 1.0, 60)], 0.1) == {(1, 0): [(0.2, 0.51, 60)]}


def test_pitch_change_splits_a_note(spark):
    frames = [(1, k / 100, 60 if k <= 50 else 64, 0.9, 0.8) for k in range(101)]
    notes = run_segments(spark, frames, [(1, 0, 0.0, 1.0, 60)], 0.1)[(1, 0)]
    assert [m for _, _, m in notes] == [60, 64]


def runs_table(spark, runs):
    rows = [
        (1, r, k, w, float(k) + r * 0.01, float(k) + 0.5 + r * 0.01, s)
        for r, words in enumerate(runs)
        for k, (w, s) in enumerate(words)
    ]
    return frame(spark, rows, "song long, run long, pos long, word string, start double, end double, score double")


@pytest.mark.parametrize(
    "readings, winner",
    [(["hello", "hallo", "hello"], "hello"), (["hello", "hallo"], "hello"), (["Wörld", "hallo", "hallo"], "hallo")],
)
def test_consensus_votes(spark, readings, winner):
    runs = [[("so", None), (r, None), ("there", None)] for r in readings]
    out = C.consensus_runs(runs_table(spark, runs), ["song"], "run", "pos", "word").orderBy("ref_pos").collect()
    assert [r.word for r in out] == ["so", winner, "there"]


def test_consensus_prefers_the_better_score(spark):
    runs = [[("one", 0.2), ("two", 0.9)], [("one", 0.8), ("two", 0.1)]]
    out = C.consensus_runs(runs_table(spark, runs), ["song"], "run", "pos", "word").orderBy("ref_pos").collect()
    assert [r.run for r in out] == [1, 0]


def test_consensus_takes_the_longest_run(spark):
    runs = [[("one", None)], [("one", None), ("two", None), ("three", None)]]
    out = C.consensus_runs(runs_table(spark, runs), ["song"], "run", "pos", "word").orderBy("ref_pos").collect()
    assert [r.word for r in out] == ["one", "two", "three"]


def test_timing_outliers_lose(spark):
    rows = [(1, r, 0, "hello", s, s + 0.5, None) for r, s in enumerate([0.0, 0.2, 4.0])]
    words = frame(spark, rows, "song long, run long, pos long, word string, start double, end double, score double")
    out = C.consensus_timing(words, ["song"], "run", "pos", "word").collect()
    assert [r.start for r in out] == [0.2]


def best_block(lines):
    """Every block at every place, counted the long way."""
    found = None
    for i in range(len(lines) if len(lines) >= 4 else 0):
        for n in range(2, len(lines) - i + 1):
            block = lines[i : i + n]
            at = [k for k in range(len(lines) - n + 1) if lines[k : k + n] == block]
            if len(at) < 2:
                break
            key = (len(at), n, -at[0])
            if found is None or key > found:
                found = key
    return None if found is None else (-found[2], -found[2] + found[1] - 1, found[0])


def test_repeated_block_equals_counting(spark):
    rng = random.Random(6)
    songs = {s: [rng.choice("abc" if s % 2 else "abcdefg") for _ in range(rng.randrange(1, 22))] for s in range(120)}
    songs[500] = list("hkxabcdhkyabcdhk")
    rows = [(s, k, x) for s, xs in songs.items() for k, x in enumerate(xs)]
    out = L.repeated_block(frame(spark, rows, "song long, line_no long, line string"), ["song"], "line", "line_no")
    got = {r.song: (r.first_line, r.last_line, r.times) for r in out.collect()}
    assert got == {s: best_block(xs) for s, xs in songs.items() if best_block(xs)}
    assert got[500] == (0, 1, 3)


def test_quantized_starts_rise_one_by_one(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for song in range(5):
        last = None
        for k in range(9000 if song == 0 else 50):
            brk = rng.random() < 0.2
            raw = k // 2 + rng.randrange(-3, 4)
            rows.append((song, k, brk, raw))
            if not brk:
                last = raw if last is None else max(raw, last + 1)
                want[(song, k)] = last
    df = frame(spark, rows, "song long, pos long, is_break boolean, raw long")
    out = G.quantize_unique(df, ["song"], "pos", F.col("raw"), ~F.col("is_break"))
    assert {(r.song, r.pos): r.start_beat for r in out.where("NOT is_break").collect()} == want


def test_folding_octaves(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rate, n = 1024.0, 128
    spec = rng.random((5, n // 2 + 1))
    centers = np.arange(n // 2 + 1) * rate / n
    bands = X.octave_bands(55.0, 500.0)
    cells = int(round(220 / (rate / n)))
    want = np.zeros((5, cells))
    for low, high in bands:
        if (low, high) == (220.0, 440.0):
            first = int(round(low / (rate / n)))
            want += spec[:, first : first + cells]
        else:
            edges = np.linspace(low, high, cells + 1)
            levels = np.array([np.interp(edges, centers, row) for row in spec])
            want += np.clip(np.diff(levels, axis=1), 0, None)
    df = frame(spark, [(1, k, [float(x) for x in row]) for k, row in enumerate(spec)], "song long, frame_no long, mags array<double>")
    got = np.zeros((5, cells))
    for r in X.octave_fold(df, ["song"], rate, n, 55.0, 500.0).collect():
        got[r.frame_no, r.cell] = r.level
    assert np.allclose(got, want)


def test_band_energy_of_a_burst(spark):
    import numpy as np

    audio = np.zeros(32000)
    audio[16000:16640] = np.sin(2 * np.pi * 220 * np.arange(640) / 16000)
    chunks = [(1, k, [float(x) for x in audio[k * 4000 : (k + 1) * 4000]]) for k in range(8)]
    df = frame(spark, chunks, "song long, chunk long, x array<double>")
    out = X.band_energy(df, ["song"], "chunk", "x", 4000, 16000.0, 160).collect()
    assert sorted(r.frame_no for r in out) == list(range(1 + 32000 // 160))
    assert sorted(r.frame_no for r in out if r.energy > 0) == list(range(97, 108))


def test_overlaps_leave_no_overlap_and_no_longer_word(spark):
    rng = random.Random(3)
    # No word ends before the middle of its overlap with the word before it.
    words = [(s, k, k * 0.5, k * 0.5 + rng.choice([0.3, 0.6, 0.7])) for s in range(25) for k in range(30)]
    none = frame(spark, [], "song long, pause_idx long, pause_start double, pause_end double")
    got = O.resolve_overlaps(
        frame(spark, words, "song long, pos long, s double, e double"), none, ["song"], "pos", "s", "e", 1.0
    ).orderBy("song", "pos").collect()
    before = {(s, k): (a, b) for s, k, a, b in words}
    for r in got:
        a, b = before[r.song, r.pos]
        assert a <= r.s <= r.e <= b
    for r, q in zip(got, got[1:]):
        if r.song == q.song:
            assert r.e <= q.s + 1e-9
            if before[r.song, r.pos][1] <= before[q.song, q.pos][0]:
                assert r.e == before[r.song, r.pos][1]


def test_a_silent_syllable_keeps_its_fallback(spark):
    frames = [(1, k / 100, 0, 0.9, 0.8) for k in range(101)]
    assert run_segments(spark, frames, [(1, 0, 0.0, 1.0, 61)], 0.1) == {(1, 0): [(0.0, 1.0, 61)]}


@pytest.mark.parametrize(
    "rule, given, left",
    [
        (T.strip_char_runs, "aaaaaaaab", " b"),
        (T.strip_char_runs, "aaaaaaab", "aaaaaaab"),
        (T.strip_char_runs, "xx ééééééééé tail", "xx   tail"),
        (T.strip_char_runs, "........", None),
        (T.strip_fragments, "mississippi issippi namon", "mississippi  "),
        (T.strip_fragments, "hotissippicold", "hot cold"),
        (T.strip_fragments, "cinnamon Namon", "cinnamon "),
        (T.strip_fragments, "issippi", None),
    ],
)
def test_character_runs_and_fragments(spark, rule, given, left):
    rows = T.drop_artefacts(frame(spark, [(given,)], "text string"), "text", rule(F.col("text"))).collect()
    assert [r.text for r in rows] == ([] if left is None else [left])


def test_character_scores_choose_word_and_characters(spark):
    """The mean of the character scores counts before the word's own; timing looks at characters alone."""
    schema = "song long, run long, pos long, word string, start double, end double, score double, chars array<double>"
    rows = [(1, 0, 0, "one", 0.0, 1.0, 0.9, [0.1, None]), (1, 1, 0, "one", 0.0, 1.0, 0.1, [0.4, 0.8]), (1, 2, 0, "one", 0.0, 1.0, 0.5, [])]
    words = frame(spark, rows, schema)
    (won,) = C.consensus_runs(words, ["song"], "run", "pos", "word", "chars").collect()
    assert (won.run, won.chars) == (1, [0.4, 0.8])
    (plain,) = C.consensus_runs(words, ["song"], "run", "pos", "word").collect()
    assert plain.run == 0
    (timed,) = C.consensus_timing(words, ["song"], "run", "pos", "word", "chars").collect()
    assert (timed.run, timed.chars) == (1, [0.4, 0.8])
    (first,) = C.consensus_timing(words, ["song"], "run", "pos", "word").collect()
    assert first.run == 0  # word scores do not count


def test_frames_of_a_syllable_are_exchanged_once(spark, monkeypatch):
    """Below the fold frames cross the interval join and one exchange by syllable, which its islands' sums reuse; none is staged."""
    staged, stage = [], P.stage
    monkeypatch.setattr(P, "stage", lambda df: staged.append(df.columns) or stage(df))
    frames = [(1, k / 100, 60, 0.9, 0.8) for k in range(101)]
    df = P.note_segments(
        frame(spark, [(1, 0, 0.0, 1.0, 60)], "song long, syl long, start double, end double, fallback int"),
        frame(spark, frames, "song long, t double, midi int, conf double, amp double"),
        frame(spark, [(1, 0.1)], "song long, threshold double"), ["song"], "syl",
    )
    assert staged == [["song", "threshold"]]
    assert {tuple(r)[2:] for r in df.collect()} == {(0, 0.0, 1.0, 60)}
    below = df._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[1]
    assert below.count("RepartitionByExpression") == 2
