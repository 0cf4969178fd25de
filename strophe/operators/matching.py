"""Pairing rows of two sources: by position, overlap, nearness and label."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import music, phonetics
from strophe.functions.phonetics import EQUAL, MISMATCH, SCORES, word_coverage
from strophe.functions.text import strip
from strophe.operators.folds import ordered_fold
from strophe.operators.ranges import nearest, overlap_join, points_in_intervals
from strophe.operators.scan import (
    halo,
    max_before,
    ordinal_block,
    position,
    run_count,
    scan,
)
from strophe.operators.stats import ladder_median
from strophe.session import stage

BPM_TOLERANCE, BEAT_TOLERANCE, DURATION_TOLERANCE, PITCH_TOLERANCE = 2.0, 4, 4, 3
MIN_ORPHAN_MS = 10
WORD_CONFIDENCE = 0.1
REPORTED_CANDIDATES = 3
LARGEST_SETS = 8  # letter sets of a song that every text is scored against first
REPORTED_FAILURES = 20


# ---- comparing charts -------------------------------------------------------------


def numbered_sung(notes: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Sung notes with ``nth``, their 0-based number in the chart."""
    sung = notes.where("note_type <> '-'")
    out = scan(sung, keys, [ordinal], ordinal_block(ordinal), nth=position())
    return out.withColumn("nth", F.col("nth") - 1)


def diff_notes(original: DataFrame, generated: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Compare the i-th sung notes of two charts, up to the shorter one."""
    keys = list(keys)
    fields = ["syllable", "start_beat", "duration", "pitch"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = numbered_sung(df, keys, ordinal)
        return rows.select(*keys, "nth", *[F.col(f).alias(f"{tag}_{f}") for f in fields])

    both = side(original, "orig").join(side(generated, "gen"), [*keys, "nth"])
    beat = F.col("gen_start_beat") - F.col("orig_start_beat")
    duration = F.col("gen_duration") - F.col("orig_duration")
    pitch = F.col("gen_pitch") - F.col("orig_pitch")
    passed = (
        (F.abs(beat) <= BEAT_TOLERANCE)
        & (F.abs(duration) <= DURATION_TOLERANCE)
        & (F.abs(pitch) <= PITCH_TOLERANCE)
    )
    return both.select(
        "*",
        F.expr("orig_syllable = gen_syllable").alias("syllable_match"),
        beat.alias("beat_offset"),
        duration.alias("duration_diff"),
        pitch.alias("pitch_diff"),
        passed.alias("passed"),
    )


def diff_headers(original: DataFrame, generated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compare title, artist, tempo and gap of two charts."""
    keys = list(keys)
    fields = ["title", "artist", "bpm", "gap"]
    a = original.select(*keys, *[F.col(f).alias(f"orig_{f}") for f in fields])
    b = generated.select(*keys, *[F.col(f).alias(f"gen_{f}") for f in fields])
    off = F.abs(F.col("orig_bpm") - F.col("gen_bpm"))
    return a.join(b, keys).select(
        *keys,
        F.expr("orig_title = gen_title").alias("title_match"),
        F.expr("orig_artist = gen_artist").alias("artist_match"),
        off.alias("bpm_diff"),
        (off <= BPM_TOLERANCE).alias("bpm_pass"),
        F.expr("orig_gap = gen_gap").alias("gap_pass"),
    )


def diff_report(
    original: DataFrame, generated: DataFrame, keys: Sequence[str], headers: DataFrame, notes: DataFrame
) -> DataFrame:
    """One row per chart pair: counts and whether everything is within tolerance.

    ``headers`` and ``notes`` are the results of the two comparisons. Charts
    without notes pass on that count; equal syllables are not required.
    """
    keys = list(keys)

    def counts(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count_if(F.col("note_type") != "-").alias(f"{tag}_notes"),
            F.count_if(F.col("note_type") == "-").alias(f"{tag}_breaks"),
        )

    failed = notes.groupBy(*keys).agg(
        F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("_all")
    )
    out = (
        headers.join(counts(original, "orig"), keys, "left")
        .join(counts(generated, "gen"), keys, "left")
        .join(failed, keys, "left")
        .fillna(0, ["orig_notes", "orig_breaks", "gen_notes", "gen_breaks", "failed"])
    )
    same = F.col("orig_notes") == F.col("gen_notes")
    passed = (
        F.col("title_match") & F.col("artist_match") & F.col("bpm_pass") & F.col("gap_pass") & same
        & F.coalesce("_all", F.lit(True))
    )
    return out.select(
        *keys, "orig_notes", "gen_notes", same.alias("note_count_pass"), "orig_breaks", "gen_breaks", "failed",
        passed.alias("passed"),
    )


def first_failures(notes: DataFrame, keys: Sequence[str], limit: int = REPORTED_FAILURES) -> DataFrame:
    """The first failed notes of each report."""
    bad = notes.where(~F.col("passed"))
    return scan(bad, keys, ["nth"], ordinal_block("nth"), _k=position()).where(F.col("_k") <= limit).drop("_k")


def drift_pairs(
    notes: DataFrame, syllables: DataFrame, keys: Sequence[str], ordinal: str, bpm: Column, gap: Column
) -> DataFrame:
    """(keys, nth, drift_start, drift_end, ...): chart notes against timed syllables, in ms."""
    keys = list(keys)
    a = numbered_sung(notes, keys, ordinal)
    start = music.beats_to_ms("start_beat", bpm, gap)
    end = music.beats_to_ms(F.col("start_beat") + F.col("duration"), bpm, gap)
    a = a.select(*keys, "nth", start.alias("note_start"), end.alias("note_end"))
    b = scan(syllables, keys, [ordinal], ordinal_block(ordinal), nth=position())
    b = b.withColumn("nth", F.col("nth") - 1).select(*keys, "nth", "start", "end", "pitch_end")
    return a.join(b, [*keys, "nth"]).select(
        *keys, "nth",
        (F.col("note_start") - F.col("start") * 1000).alias("drift_start"),
        (F.col("note_end") - F.col("end") * 1000).alias("drift_end"),
        "end", "pitch_end",
    )


def drift_stats(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and largest drift, and how often and far pitches outlast their syllable."""
    longer = F.coalesce(F.col("pitch_end"), F.lit(0.0)) > 0
    return pairs.groupBy(*keys).agg(
        F.avg("drift_start").alias("mean_start"),
        F.avg("drift_end").alias("mean_end"),
        F.max(F.abs("drift_start")).alias("max_start"),
        F.max(F.abs("drift_end")).alias("max_end"),
        (100.0 * F.count_if(longer) / F.count(F.lit(1))).alias("extended_pct"),
        F.coalesce(F.avg(F.when(longer, F.col("pitch_end") - F.col("end"))) * 1000, F.lit(0.0)).alias("mean_extension"),
    )


def score_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Timing and length RMSE and mean octave-blind pitch distance; null without pairs.

    ``pairs`` has a_/b_ columns start, duration and pitch.
    """
    def rmse(name: str) -> Column:
        d = F.col(f"a_{name}") - F.col(f"b_{name}")
        return F.sqrt(F.avg((d * d).cast("double")))

    off = F.abs(F.col("a_start") - F.col("b_start"))
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched"),
        rmse("start").alias("timing_rmse"),
        rmse("duration").alias("duration_rmse"),
        F.avg(music.octave_distance("a_pitch", "b_pitch")).alias("pitch_distance"),
        F.max(off).alias("worst_start"),
    )


# ---- overlaps ------------------------------------------------------------------------


class _Claims:
    """Words taken so far in one island of overlapping notes and words."""

    def __init__(self, keys, note, word):
        self.names, self.taken, self.served = (keys, note, word), set(), None

    def push(self, row):
        keys, note, word = self.names
        n, w = getattr(row, note), getattr(row, word)
        if n == self.served or w in self.taken:
            return []
        self.served = n
        self.taken.add(w)
        return [(*[getattr(row, k) for k in keys], n, w)]

    def end(self):
        return []


def overlap_islands(
    notes: DataFrame, words: DataFrame, keys: Sequence[str], note: str, span: tuple[str, str],
    word_span: tuple[str, str], width: float,
) -> DataFrame:
    """(keys, note, island): notes numbered by stretches in which anything overlaps.

    A stretch ends where the next interval starts at or after all ends so far.
    """
    keys = list(keys)
    a = notes.select(*keys, F.col(note).alias("_id"), F.lit(0).alias("_k"), F.col(span[0]).alias("_s"), F.col(span[1]).alias("_e"))
    b = words.select(*keys, F.lit(-1).cast("long").alias("_id"), F.lit(1).alias("_k"), F.col(word_span[0]).alias("_s"), F.col(word_span[1]).alias("_e"))
    lane = a.unionByName(b)
    order, block = ["_s", "_e", "_k", "_id"], F.floor(F.col("_s") / F.lit(width * 64))
    reach = scan(lane, keys, order, block, _top=max_before(F.col("_e")))
    opens = F.coalesce(F.col("_s") >= F.col("_top"), F.lit(True))
    numbered = scan(reach, keys, order, block, island=run_count(opens))
    return numbered.where("_k = 0").select(*keys, F.col("_id").alias(note), "island")


def claim_best_overlap(
    notes: DataFrame, words: DataFrame, keys: Sequence[str], note: str, word: str,
    span: tuple[str, str], word_span: tuple[str, str], width: float,
) -> DataFrame:
    """(keys, note, word): each note in turn claims the free word it shares most time with.

    The earlier word wins a tie. Claims only depend on each other where
    intervals overlap, so the fold runs per island of overlapping intervals.
    """
    keys = list(keys)
    pairs = overlap_join(
        notes.select(*keys, note, *span), words.select(*keys, word, *word_span), keys, span, word_span, width
    ).where("overlap > 0")
    isl = overlap_islands(notes, words, keys, note, span, word_span, width)
    rows = pairs.join(isl, [*keys, note]).select(*keys, "island", note, word, (-F.col("overlap")).alias("_less"))
    types = dict(rows.dtypes)
    group = [*keys, "island"]
    schema = ", ".join(f"{c} {types[c]}" for c in (*group, note, word))
    return ordered_fold(rows, group, [note, "_less", word], lambda: _Claims(group, note, word), schema).drop("island")


def orphan_words(
    words: DataFrame, claimed: DataFrame, verses: DataFrame, keys: Sequence[str], word: str, verse: str,
    word_span: tuple[str, str], verse_span: tuple[str, str], width: float,
) -> DataFrame:
    """Unclaimed words that overlap a verse, with the first such verse and a note's length."""
    keys = list(keys)
    free = words.join(claimed.select(*keys, word), [*keys, word], "left_anti")
    hits = overlap_join(verses.select(*keys, verse, *verse_span), free, keys, verse_span, word_span, width)
    first = hits.groupBy(*keys, word).agg(F.min(verse).alias(verse))
    length = F.greatest(F.col(word_span[1]) - F.col(word_span[0]), F.lit(MIN_ORPHAN_MS))
    return free.join(first, [*keys, word]).withColumn("length", length)


def nearest_verse(
    words: DataFrame, verses: DataFrame, keys: Sequence[str], word: str, verse: str,
    word_span: tuple[str, str], verse_span: tuple[str, str], block_width: float,
) -> DataFrame:
    """(keys, word, verse): the verse whose start or end lies closest to the word's.

    Starts and ends are each matched on a merged timeline; of the four nearest
    candidates the closest stands, the earlier verse on a tie.
    """
    keys = list(keys)
    near = nearest(words.select(*keys, word, *word_span), verses, keys, word_span[0], verse_span[0], verse, block_width, "s")
    near = nearest(near, verses, keys, word_span[1], verse_span[1], verse, block_width, "e")

    def candidate(c: str, at: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct(F.abs(F.col(f"{c}.at") - F.col(at)).alias("d"), F.col(f"{c}.id").alias("v")),
        )

    s, e = word_span
    best = F.array_min(
        F.filter(
            F.array(candidate("s_lo", s), candidate("s_hi", s), candidate("e_lo", e), candidate("e_hi", e)),
            lambda x: x.isNotNull(),
        )
    )
    return near.select(*keys, word, best["v"].alias(verse)).where(F.col(verse).isNotNull())


def frames_in_notes(
    notes: DataFrame, frames: DataFrame, keys: Sequence[str], span: tuple[str, str], at: str, width: float
) -> DataFrame:
    """(note columns, frame columns): frames inside each note, both ends included."""
    return points_in_intervals(frames, notes, keys, at, span, width)


def orphan_frames(
    notes: DataFrame, frames: DataFrame, verses: DataFrame, keys: Sequence[str], note: str, frame: str, verse: str,
    span: tuple[str, str], verse_span: tuple[str, str], at: str, width: float,
) -> DataFrame:
    """(keys, verse, frame, note): frames of a verse on none of its notes.

    All of them go to the note that starts nearest to the first such frame, the
    earlier note on a tie. ``notes`` carries the verse of each note.
    """
    keys = list(keys)
    in_verse = points_in_intervals(
        frames.select(*keys, frame, at), verses.select(*keys, verse, *verse_span), keys, at, verse_span, width
    ).select(*keys, verse, frame, at)
    on_note = points_in_intervals(
        frames.select(*keys, frame, at), notes.select(*keys, note, verse, *span), keys, at, span, width
    ).select(*keys, verse, frame).distinct()
    orphans = in_verse.join(on_note, [*keys, verse, frame], "left_anti")
    first = orphans.groupBy(*keys, verse).agg(F.min_by(at, frame).alias("_t"))
    target = notes.join(first, [*keys, verse]).groupBy(*keys, verse).agg(
        F.min_by(note, F.struct(F.abs(F.col(span[0]) - F.col("_t")), F.col(note))).alias(note)
    )
    return orphans.join(target, [*keys, verse]).select(*keys, verse, frame, note)


def attach_pitch(
    words: DataFrame, frames: DataFrame, keys: Sequence[str], word: str, span: tuple[str, str], at: str,
    hz: str, confidence: str, width: float,
) -> DataFrame:
    """(keys, word, midi, n_frames): median pitch of each word from its frames.

    The median is taken over frequencies of the most confident frames, then
    turned into a pitch; frames count when voiced and above the word's limit.
    """
    keys = list(keys)
    voiced = frames.where((F.col(hz) > 0) & (F.col(confidence) > WORD_CONFIDENCE))
    hits = points_in_intervals(
        voiced.select(*keys, at, hz, confidence), words.select(*keys, word, *span), keys, at, span, width
    )
    med = ladder_median(hits, [*keys, word], hz, confidence)
    counts = hits.groupBy(*keys, word).agg(F.count(F.lit(1)).alias("n_frames"))
    return words.select(*keys, word).join(med, [*keys, word], "left").join(counts, [*keys, word], "left").select(
        *keys, word,
        F.coalesce(music.hz_to_midi("median"), F.lit(music.UNKNOWN_PITCH)).alias("midi"),
        F.coalesce("n_frames", F.lit(0).cast("long")).alias("n_frames"),
    )


# ---- labels --------------------------------------------------------------------------


class _Labels:
    """Free B rows of one label, ordered by start; A rows take the nearest in turn."""

    def __init__(self, keys):
        self.keys, self.starts, self.ids, self.right, self.left = keys, [], [], None, None

    def _find(self, parent, i):
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    def push(self, row):
        if row.side == 0:
            self.starts.append(row.at)
            self.ids.append(row.id)
            return []
        n = len(self.ids)
        if self.right is None:
            # Slots 1..n are rows; each points to the next free slot on its side.
            self.right, self.left = list(range(n + 2)), list(range(n + 2))
        at = bisect_left(self.starts, row.at) + 1
        up = self._find(self.right, at)
        down = self._find(self.left, at - 1)
        options = []
        if up <= n:
            options.append((abs(self.starts[up - 1] - row.at), self.ids[up - 1], up))
        if down >= 1:
            first = bisect_left(self.starts, self.starts[down - 1]) + 1
            slot = self._find(self.right, first)
            options.append((abs(self.starts[slot - 1] - row.at), self.ids[slot - 1], slot))
        if not options:
            return []
        _, chosen, slot = min(options)
        self.right[slot], self.left[slot] = slot + 1, slot - 1
        return [(*[getattr(row, k) for k in self.keys], row.id, chosen)]

    def end(self):
        return []


def match_by_label(
    a: DataFrame, b: DataFrame, keys: Sequence[str], label: str, at: str, id_: str
) -> DataFrame:
    """(keys, a_id, b_id): each A row in turn takes the nearest free B row of its label.

    The rule is sequential within one label of one song, and that group is what
    is folded; labels are stripped before they are compared. The state holds the
    start and id of the label's B rows.
    """
    keys = list(keys)
    name = strip(F.col(label)).alias("label_")

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*keys, name, F.lit(n).alias("side"), F.col(at).cast("double").alias("at"), F.col(id_).cast("long").alias("id"))

    labels = b.select(*keys, name).distinct()
    wanted = side(a, 1).join(labels, [*keys, "label_"], "left_semi")
    lane = side(b, 0).unionByName(wanted)
    # B rows come first, by start; A rows follow in their own order.
    lane = lane.withColumn("_o1", F.when(F.col("side") == 0, F.col("at")).otherwise(0.0))
    types = dict(lane.dtypes)
    group = [*keys, "label_"]
    schema = ", ".join([*[f"{k} {types[k]}" for k in group], "a_id bigint", "b_id bigint"])
    out = ordered_fold(lane, group, ["side", "_o1", "id"], lambda: _Labels(group), schema)
    return out.drop("label_")


# ---- pauses and candidates ---------------------------------------------------------------


def first_gap_between(
    words: DataFrame, pauses: DataFrame, keys: Sequence[str], ordinal: str, start: str, end: str, width: float
) -> DataFrame:
    """(keys, ordinal, pause_idx): the first pause between a word's start and the next word's end."""
    keys = list(keys)
    pairs = halo(words, keys, ordinal, 1, {"_b": lambda w: F.lead(end).over(w)})
    spans = pairs.where(F.col("_b") >= F.col(start)).select(*keys, ordinal, F.col(start).alias("_a"), "_b")
    hits = points_in_intervals(pauses, spans, keys, "pause_start", ("_a", "_b"), width)
    return hits.where(F.col("pause_end") <= F.col("_b")).groupBy(*keys, ordinal).agg(
        F.min("pause_idx").alias("pause_idx")
    )


def unused_between(
    anchors: DataFrame, transcript: DataFrame, keys: Sequence[str], ordinal: str, low: str, high: str,
    word: str, start: str, end: str,
) -> DataFrame:
    """(keys, ordinal, unused_start, unused_end) for anchors with spare words before them.

    ``anchors`` are the matched rows: the lowest and highest transcript word each
    uses, and their ordinal in the lyrics. Where two neighbouring anchors leave
    lyrics between them, the transcript words strictly between are unused; only
    the first and the last of those words are looked up, by key.
    """
    keys = list(keys)
    numbered = scan(anchors, keys, [ordinal], ordinal_block(ordinal), _n=position())
    prev = halo(
        numbered.withColumn("_n", F.col("_n") - 1), keys, "_n", 1,
        {"_po": lambda w: F.lag(ordinal).over(w), "_ph": lambda w: F.lag(high).over(w)},
    )
    gaps = prev.where((F.col(ordinal) - F.col("_po") > 1) & (F.col(low) - F.col("_ph") > 1)).select(
        *keys, ordinal, (F.col("_ph") + 1).alias("_w0"), (F.col(low) - 1).alias("_w1")
    )
    first = transcript.select(*keys, F.col(word).alias("_w0"), F.col(start).alias("unused_start"))
    last = transcript.select(*keys, F.col(word).alias("_w1"), F.col(end).alias("unused_end"))
    return gaps.join(first, [*keys, "_w0"]).join(last, [*keys, "_w1"]).select(
        *keys, ordinal, "unused_start", "unused_end"
    )


def _sounds_like() -> Column:
    """A map from each letter with a score of its own to the letters that score above a mismatch with it."""
    return F.create_map(*[
        part for x, row in sorted(SCORES.items())
        for part in (F.lit(x), F.array(*[F.lit(y) for y, score in sorted(row.items()) if score > MISMATCH]))
    ])


def _listed_under(letter: Column) -> Column:
    """The letters of sets that are listed under a letter, as one text: itself and those that it sounds like."""
    heard = {}
    for x, row in sorted(SCORES.items()):
        for y, score in sorted(row.items()):
            if score > MISMATCH and len(x) == 1:  # sets hold single letters
                heard.setdefault(y, []).append(x)
    others = F.create_map(*[part for y, xs in sorted(heard.items()) for part in (F.lit(y), F.lit("".join(xs)))])
    return F.concat(letter, F.coalesce(F.try_element_at(others, letter), F.lit("")))


def top_candidates(
    unmatched: DataFrame, transcript: DataFrame, keys: Sequence[str], ordinal: str, norm: str, word: str,
    limit: int = REPORTED_CANDIDATES, hubs: int = LARGEST_SETS,
) -> DataFrame:
    """(keys, ordinal, rank, word, score): the best transcript words for each unmatched one.

    A score depends on the set of letters alone, so each song's transcript is
    reduced to its distinct letter sets. Of every set only the first ``limit`` words can
    rank, which is exact: they share one score and earlier words go first.

    Texts meet sets through an inverted index of letters, from the sets that hold a
    letter or one that sounds like it. First each text is scored against a few sets
    of its song: those with the most letters, those of the first words, the empty
    one. The score of the ``limit``-th word found is a bar. A set that lacks the letters P
    of a text of n letters scores at most 1 - (1 - mismatch) |P| / n, so a set that
    reaches the bar is listed under one of the text's rarest letters, taken until
    that bound is below it. A set listed under no letter scores a mismatch throughout,
    and so ranks behind the first words. Texts without letters score 0 everywhere.
    Of the pairs that meet only those before the bar are exchanged. A text brings along
    what its rarer letters list, so that a set is exchanged with its own letters alone.
    """
    keys = list(keys)
    pool_of = F.array_join(F.array_sort(F.array_distinct(F.split(F.col(norm), ""))), "")
    pools = transcript.select(*keys, word, pool_of.alias("_pool"))
    ranked = scan(
        pools, [*keys, "_pool"], [word], F.floor(F.col(word) / 65536), _k=position()
    ).where(F.col("_k") <= limit)
    sets = stage(ranked.groupBy(*keys, "_pool").agg(F.array_sort(F.collect_list(word)).alias("_words")))
    less = (-word_coverage(F.col(norm), F.col("_pool"))).alias("less")

    size = F.struct((-F.length("_pool")).alias("size"), F.col("_pool").alias("pool"))
    first = F.struct(F.element_at("_words", 1).alias("size"), F.col("_pool").alias("pool"))
    few = (
        top_k(sets, keys, [size.alias("of")], hubs).select(*keys, F.col("_t.of.pool").alias("_pool"))
        .unionByName(top_k(sets, keys, [first.alias("of")], limit).select(*keys, F.col("_t.of.pool").alias("_pool")))
        .unionByName(sets.where(F.col("_pool") == "").select(*keys, "_pool"))
        .distinct()
    )
    marked = stage(sets.join(few.withColumn("_few", F.lit(True)), [*keys, "_pool"], "left"))
    hub_sets = marked.where("_few").groupBy(*keys).agg(F.collect_list(F.struct("_pool", "_words")).alias("_hubs"))

    listed = F.transform(phonetics.chars_of(F.col("_pool")), lambda c: F.concat(F.array(c), F.coalesce(F.try_element_at(_sounds_like(), c), F.array().cast("array<string>"))))
    index = marked.where("_few IS NULL").select(*keys, "_pool", "_words", F.array_distinct(F.flatten(listed)).alias("_lists"))
    index = index.withColumn("_c", F.explode("_lists")).drop("_lists")
    # One count for each letter of a song's alphabet.
    sizes = index.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_sets")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_c", "_sets"))).alias("_sizes")
    )

    def by_words(sets: Column) -> Column:
        """The ``limit`` best words of some sets, with their negative scores: the highest scores, then the earliest."""
        words = F.transform(sets, lambda x: F.transform(x["words"], lambda w: F.struct(x["less"].alias("less"), w.alias("w"))))
        return F.slice(F.array_sort(F.flatten(words)), 1, limit)

    scored = F.transform("_hubs", lambda h: F.struct((-word_coverage(F.col(norm), h["_pool"])).alias("less"), h["_words"].alias("words")))
    letters = F.filter(phonetics.chars_of(F.col(norm)), lambda c: c != " ")

    def weighed(own: Column, sizes: Column) -> Column:
        """A text's distinct letters, the rarest first: the number of sets, the letter and its occurrences."""
        return F.array_sort(F.transform(F.array_distinct(own), lambda c: F.struct(
            F.coalesce(F.try_element_at(sizes, c), F.lit(0)).alias("sets"), c.alias("c"), F.size(F.filter(own, lambda x: x == c)).alias("w")
        )))

    def bound(i: Column) -> Column:
        lacking = F.aggregate(F.slice("_letters", F.lit(1), i), F.lit(0), lambda n, x: n + x["w"])
        return F.lit(EQUAL) - F.lit(EQUAL - MISMATCH) * lacking / F.col("_n")

    # A song's few sets and its alphabet come to its texts in one row.
    texts = unmatched.select(*keys, norm).distinct().join(hub_sets, keys).join(sizes, keys, "left")
    texts = texts.withColumn("_seen", by_words(scored)).withColumn("_bar", F.try_element_at("_seen", F.lit(limit)))
    none = F.create_map().cast("map<string,bigint>")
    texts = texts.withColumns({"_letters": weighed(letters, F.coalesce("_sizes", none)), "_n": F.size(letters)})
    wanted = F.filter("_letters", lambda x, i: (bound(i) > -F.col("_bar.less") - 1e-9) & (x["sets"] > 0))
    met = stage(texts.select(*keys, norm, "_seen", "_bar", F.transform(wanted, lambda x: x["c"]).alias("_wanted")))

    # A pair meets under the first of the letters it has in common; only what comes before the bar goes on.
    probes = met.select(*keys, norm, "_bar", "_wanted", F.posexplode("_wanted").alias("_at", "_c"))
    before = F.array_join(F.transform(F.slice("_wanted", F.lit(1), F.col("_at")), _listed_under), "")
    probes = probes.withColumn("_before", before).drop("_wanted", "_at")
    left = F.call_function("translate", F.col("_pool"), F.col("_before"), F.lit(""))
    pairs = probes.join(index, [*keys, "_c"]).where(F.length(left) == F.length("_pool"))
    own = F.struct("less", F.element_at("_words", 1).alias("w"))
    better = pairs.select(*keys, norm, "_bar", "_words", less).where(own < F.col("_bar"))
    ahead = Window.partitionBy(*keys, norm).orderBy("less", F.element_at("_words", 1))
    better = better.withColumn("_r", F.row_number().over(ahead)).where(F.col("_r") <= limit)
    more = better.groupBy(*keys, norm).agg(F.collect_list(F.struct("less", F.col("_words").alias("words"))).alias("_more"))
    found = met.select(*keys, norm, "_seen").join(more, [*keys, norm], "left")
    all_words = F.when(F.col("_more").isNull(), F.col("_seen")).otherwise(
        F.slice(F.array_sort(F.concat("_seen", by_words(F.col("_more")))), 1, limit)
    )
    found = found.select(*keys, norm, all_words.alias("_best"))
    out = unmatched.select(*keys, ordinal, norm).join(found, [*keys, norm])
    return out.select(*keys, ordinal, F.posexplode("_best").alias("_at", "_t")).select(
        *keys, ordinal, (F.col("_at") + 1).alias("rank"), F.col("_t.w").alias(word), (-F.col("_t.less")).alias("score")
    )


def top_k(df: DataFrame, keys: Sequence[str], rank: list[Column], limit: int, lanes: int = 32) -> DataFrame:
    """The ``limit`` smallest rank structs per key: (keys, _at, _t).

    Taken in two steps, first in random lanes of each key, so that a key with
    very many rows is not ranked in one task.
    """
    keys = list(keys)
    rows = df.select(*keys, F.struct(*rank).alias("_t"))
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64("_t"), F.lit(lanes)))
    w1 = Window.partitionBy(*keys, "_lane").orderBy("_t")
    kept = laned.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= limit)
    w2 = Window.partitionBy(*keys).orderBy("_t")
    return kept.withColumn("_at", F.row_number().over(w2) - 1).where(F.col("_at") < limit).select(*keys, "_at", "_t")


# ---- sets and the preview -----------------------------------------------------------------


def with_orphans(notes: DataFrame, orphans: DataFrame) -> DataFrame:
    """Sung and orphan rows together, told apart by ``orphan``."""
    return notes.withColumn("orphan", F.lit(False)).unionByName(
        orphans.withColumn("orphan", F.lit(True)), allowMissingColumns=True
    )


def except_used(rows: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur among the used ones."""
    return rows.join(used.select(*keys), list(keys), "left_anti")


def preview(
    notes: DataFrame, words: DataFrame, verses: DataFrame, frames: DataFrame, keys: Sequence[str],
    width: float, block_width: float,
) -> DataFrame:
    """(keys, verse, id, orphan, word, n_frames): everything a preview shows.

    ``notes`` has note, verse, s, e; ``words`` word, ws, we; ``verses`` verse,
    vs, ve; ``frames`` frame, t. Notes carry the word they claim. Free words
    become orphan rows of the first verse they overlap, or else of the nearest
    verse as the notes alone span it. Frames count for the notes and orphans they lie
    in; frames of a verse on none of these go to one of them, the one that starts
    nearest to the first such frame, notes before orphans on a tie.
    """
    keys = list(keys)
    notes, words, verses, frames = (stage(t) for t in (notes, words, verses, frames))
    claimed = stage(claim_best_overlap(notes, words, keys, "note", "word", ("s", "e"), ("ws", "we"), width))
    inner = stage(orphan_words(words, claimed, verses, keys, "word", "verse", ("ws", "we"), ("vs", "ve"), width))
    rest = stage(except_used(except_used(words, claimed, [*keys, "word"]), inner, [*keys, "word"]))
    outer = nearest_verse(rest, verses, keys, "word", "verse", ("ws", "we"), ("vs", "ve"), block_width)
    outer = outer.select(*keys, "word", "verse").join(words.select(*keys, "word", "ws", "we"), [*keys, "word"])

    def held(rows: DataFrame, orphan: bool, id_: str, start: str, end: str) -> DataFrame:
        both = F.struct(F.lit(orphan).alias("orphan"), F.col(id_).alias("id"))
        return rows.select(*keys, both.alias("note"), "verse", F.col(start).alias("s"), F.col(end).alias("e"))

    within = stage(held(notes, False, "note", "s", "e").unionByName(held(inner, True, "word", "ws", "we")))
    beyond = stage(held(outer, True, "word", "ws", "we"))
    on_note = points_in_intervals(
        frames.select(*keys, "frame", "t"), within.unionByName(beyond), keys, "t", ("s", "e"), width
    ).select(*keys, "note", "frame")
    strays = orphan_frames(within, frames, verses, keys, "note", "frame", "verse", ("s", "e"), ("vs", "ve"), "t", width)
    counts = on_note.unionByName(strays.select(*keys, "note", "frame")).groupBy(*keys, "note").agg(
        F.count(F.lit(1)).alias("_n")
    )
    frames_of = F.coalesce("_n", F.lit(0).cast("long")).alias("n_frames")
    placed = within.unionByName(beyond).select(*keys, "note", "verse").join(counts, [*keys, "note"], "left")
    own = claimed.select(*keys, F.struct(F.lit(False).alias("orphan"), F.col("note").alias("id")).alias("note"), F.col("word").alias("_w"))
    rows = placed.join(own, [*keys, "note"], "left")
    word = F.when(F.col("note.orphan"), F.col("note.id")).otherwise(F.col("_w")).alias("word")
    return rows.select(*keys, "verse", F.col("note.id").alias("id"), F.col("note.orphan").alias("orphan"), word, frames_of)
