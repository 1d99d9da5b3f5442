"""Musical keys on the 12-step wheel and tempo distances, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col
from ..plans.ranking import finite

# Notes around the wheel from position 1 to 12, per mode.
MAJOR_WHEEL = ("B", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E")
MINOR_WHEEL = ("Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "Gb", "Db")
# Other spellings of a note.
SAME_NOTE = {
    "C#": "Db", "D#": "Eb", "F#": "Gb", "G#": "Ab", "A#": "Bb",
    "CIS": "Db", "DIS": "Eb", "FIS": "Gb", "GIS": "Ab", "AIS": "Bb",
    "E#": "F", "B#": "C", "Cb": "B", "Fb": "E",
}
# Cost of 0..6 steps on the wheel, of a mode change, of not knowing.
STEP_COST = (0.0, 0.0, 0.4, 0.6, 0.8, 0.9, 1.0)
MODE_COST = 0.2
UNKNOWN_COST = 0.5
# Pitch range, folding floor, range of trusted tempo tags.
TEMPO_TOLERANCE = 0.06
TEMPO_FLOOR = 70.0
TAG_TEMPO = (40.0, 220.0)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def to_camelot(key: Col, scale: Col | None = None) -> Column:
    """Any usual spelling of a key to its wheel code; unknown words give NULL."""
    text = F.trim(col(key).cast("string"))
    packed = F.upper(F.regexp_replace(text, " ", ""))
    number = F.regexp_extract(packed, "^([0-9]{1,2})[AB]$", 1).try_cast("int")
    coded = F.when(number.between(1, 12), F.concat(number.cast("string"), F.substring(packed, -1, 1)))
    words = F.split(F.trim(F.regexp_replace(text, "[-\\s]+", " ")), " ")
    first = F.element_at(words, 1)
    rest = F.lower(F.array_join(F.slice(words, 2, 100), " "))
    trailing = (rest == "") & (F.length(first) > 1) & first.endswith("m")
    note = F.when(trailing, F.regexp_replace(first, "m$", "")).otherwise(first)
    spoken = F.when(trailing, F.lit("minor")).otherwise(rest)
    given = F.lit(None).cast("string") if scale is None else F.nullif(F.lower(col(scale)), F.lit(""))
    mode = F.coalesce(given, F.nullif(spoken, F.lit("")), F.lit("major"))
    minor = mode.startswith("m") & ~mode.startswith("maj")
    tail = F.translate(F.regexp_replace(note, "^.", ""), "♯♭", "#b")
    note = F.concat(F.upper(F.substring(note, 1, 1)), tail)
    same = _lookup(SAME_NOTE)
    note = F.coalesce(F.try_element_at(same, F.upper(note)), F.try_element_at(same, note), note)
    major_code = _lookup({n: f"{i}B" for i, n in enumerate(MAJOR_WHEEL, 1)})
    minor_code = _lookup({n: f"{i}A" for i, n in enumerate(MINOR_WHEEL, 1)})
    named = F.when(minor, F.try_element_at(minor_code, note)).otherwise(F.try_element_at(major_code, note))
    return F.when(text != "", F.coalesce(coded, named))


def wheel_number(code: Col) -> Column:
    return F.regexp_extract(col(code), "^([0-9]+)[ABab]$", 1).try_cast("int")


def wheel_mode(code: Col) -> Column:
    """0 for A, 1 for B, NULL when the code does not parse."""
    letter = F.upper(F.substring(col(code), -1, 1))
    return F.when(wheel_number(code).isNotNull(), F.when(letter == "B", 1).otherwise(0))


def wheel_rank(code: Col) -> Column:
    return wheel_number(code) * 2 + wheel_mode(code)


def key_distance(a: Col, b: Col) -> Column:
    n1, n2 = wheel_number(a), wheel_number(b)
    steps = F.least(F.pmod(n1 - n2, F.lit(12)), F.pmod(n2 - n1, F.lit(12)))
    ring = F.element_at(F.array(*[F.lit(c) for c in STEP_COST]), steps + 1)
    other = (wheel_mode(a) != wheel_mode(b)) & (steps != 0)
    cost = F.when(other, F.least(F.lit(1.0), ring + MODE_COST)).otherwise(ring)
    return F.when(n1.isNotNull() & n2.isNotNull(), cost).otherwise(F.lit(UNKNOWN_COST))


def steps_between(a: Col, b: Col) -> Column:
    """Signed short way round the wheel between two places on it, -6..5."""
    return F.pmod(col(b) - col(a) + 6, F.lit(12)) - 6


def key_steps(a: Col, b: Col) -> Column:
    return steps_between(wheel_number(a), wheel_number(b))


def key_mode_changes(a: Col, b: Col) -> Column:
    return wheel_mode(a) != wheel_mode(b)


def tempo(value: Col) -> Column:
    """A usable tempo: finite and above zero."""
    number = finite(col(value).try_cast("double"))
    return F.when(number > 0, number)


def tag_tempo(value: Col) -> Column:
    number = tempo(F.trim(col(value).cast("string")))
    return F.when(number.between(*TAG_TEMPO), number)


def fold_tempo(value: Col) -> Column:
    """Doubled until it reaches the floor; never halved."""
    number = tempo(value)
    times = F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(TEMPO_FLOOR) / number)).cast("double"))
    folded = number * F.pow(F.lit(2.0), times)
    return F.when(folded < TEMPO_FLOOR, folded * 2).when(
        (times > 0) & (folded / 2 >= TEMPO_FLOOR), folded / 2).otherwise(folded)


def tempo_distance(a: Col, b: Col, tolerance: float = TEMPO_TOLERANCE) -> Column:
    """Relative gap to ``a`` over half, same and double tempo; not symmetric."""
    one, two = tempo(a), tempo(b)
    gap = F.least(*[F.abs(two * factor - one) / one for factor in (0.5, 1.0, 2.0)])
    far = F.least(F.lit(1.0), 0.5 + 0.5 * (gap - tolerance) / tolerance)
    cost = F.when(gap <= tolerance, 0.5 * gap / tolerance).otherwise(far)
    return F.when(one.isNotNull() & two.isNotNull(), cost).otherwise(F.lit(UNKNOWN_COST))


def tempo_shift(a: Col, b: Col) -> Column:
    """Signed change after folding to the closest octave (earlier factor wins a tie)."""
    one, two = tempo(a), tempo(b)
    shifts = [F.struct(F.abs(two * f - one).alias("size"), F.lit(i).alias("at"), (two * f - one).alias("shift"))
              for i, f in enumerate((0.5, 1.0, 2.0))]
    return F.when(one.isNotNull() & two.isNotNull(), F.array_min(F.array(*shifts))["shift"])


def onsets_per_beat(rate: Col, bpm: Col) -> Column:
    return finite(rate) * 60.0 / fold_tempo(bpm)
