"""Queries that use the chart, or the words of the turns, several times work them out once."""

import __spark_entry__ as entry
from strophe.plans import alignments, editing


def test_repeats_are_copied_from_one_reading_of_the_notes(spark, small, monkeypatch):
    taken = []

    def stop(chart, *_):
        taken.append(chart)
        raise InterruptedError

    queries = entry.queries()
    monkeypatch.setattr(editing.E, "copy_to_repeats", stop)
    try:
        queries["copy_to_repeats"](spark, small)
    except InterruptedError:
        pass
    assert taken and not [f for f in taken[0].inputFiles() if "lineitem" in f]


def test_lyrics_are_placed_by_one_reading_of_the_turns(spark, small, monkeypatch):
    taken = []

    def stop(lyric, transcript, pauses, frames, *_):
        taken.extend([lyric, transcript, pauses, frames])
        raise InterruptedError

    queries = entry.queries()
    monkeypatch.setattr(alignments.P, "place_lyrics", stop)
    try:
        queries["place_lyrics"](spark, small)
    except InterruptedError:
        pass
    assert len(taken) == 4 and not [f for df in taken for f in df.inputFiles() if "conversations" in f]
