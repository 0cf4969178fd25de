"""Beats, pitches and levels as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch class names from C.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
LOWEST_SUNG_PITCH = 36
UNKNOWN_PITCH = 60


def as_col(x) -> Column:
    """A column for a name, a column or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def half_even(x: Column) -> Column:
    """Round to the nearest integer, halves to even."""
    return F.rint(x).cast("long")


def ms_to_beats(ms, bpm, gap) -> Column:
    """Milliseconds to sixteenth-note beats after ``gap`` milliseconds."""
    return half_even((as_col(ms) - as_col(gap)) / 1000 * (as_col(bpm) / 60) * 4)


def beat_ms(bpm) -> Column:
    """Length of one sixteenth-note beat."""
    return F.lit(60000.0) / as_col(bpm) / 4


def pulse_ms(bpm) -> Column:
    """Length of one quarter note."""
    return F.lit(60000.0) / as_col(bpm)


def beats_to_ms(beats, bpm, gap=0) -> Column:
    """Beats to milliseconds from the start of the audio."""
    return as_col(gap) + as_col(beats) * beat_ms(bpm)


def hz_to_midi(hz, silent: int = UNKNOWN_PITCH) -> Column:
    """Frequency to the nearest pitch number; ``silent`` where there is no tone."""
    hz = as_col(hz)
    return F.when(hz > 0, half_even(12 * F.log2(hz / 440) + 69)).otherwise(silent).cast("int")


def midi_to_hz(midi) -> Column:
    """Pitch number to frequency."""
    return 440 * F.pow(F.lit(2.0), (as_col(midi) - 69) / F.lit(12.0))


def note_name(pitch) -> Column:
    """Name and octave, such as C4 for 60."""
    pitch = as_col(pitch)
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    octave = (F.floor(pitch / 12) - 1).cast("string")
    return F.concat(F.element_at(names, (F.pmod(pitch, F.lit(12)) + 1).cast("int")), octave)


def lift_octaves(pitch, floor: int = LOWEST_SUNG_PITCH) -> Column:
    """Raise a pitch by whole octaves until it reaches ``floor``."""
    pitch = as_col(pitch)
    octaves = F.floor((floor - pitch + 11) / 12)
    return F.when(pitch >= floor, pitch).otherwise(pitch + octaves * 12).cast("int")


def octave_distance(a, b) -> Column:
    """Distance of two pitches in semitones, octaves apart counting as equal."""
    return F.abs(F.pmod(as_col(a) - as_col(b) + 6, F.lit(12)) - 6)


def clamp01(x, low, high) -> Column:
    """Place of ``x`` between ``low`` and ``high`` as 0..1; 0.5 for an empty range."""
    x, low, high = as_col(x), as_col(low), as_col(high)
    return F.when(high <= low, F.lit(0.5)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    )
