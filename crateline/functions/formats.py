"""Values as they are read: sizes, times, pills, arrows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, clamp, col, two_places
from .text import base_name, suffix

# Extension to audio format.
AUDIO_FORMATS = {
    ".mp3": "MP3", ".flac": "FLAC", ".wav": "WAV", ".aiff": "AIFF", ".aif": "AIFF", ".m4a": "M4A",
    ".mp4": "M4A", ".m4b": "M4A", ".aac": "AAC", ".ogg": "OGG", ".oga": "OGG", ".opus": "OPUS",
    ".alac": "ALAC", ".wma": "WMA", ".wv": "WAVPACK", ".ape": "APE", ".mpc": "MUSEPACK",
    ".dsf": "DSD",
}
OTHER = "OTHER"
SIDECAR = "AppleDouble (._ macOS)"
NO_EXTENSION = "(no extension)"
# What a file that is not audio may hold; such files are not junk. Reasons are short codes.
NOT_JUNK = {
    ".xml": "library", ".nml": "library",
    ".m3u": "playlist", ".m3u8": "playlist", ".pls": "playlist",
    ".cue": "cut marks",
    ".db": "database", ".edb": "database", ".pdb": "database",
    ".json": "analyses", ".asd": "analyses",
}
# Half width of the neutral zone, bars of the energy glyph.
NEUTRAL_ZONE = 0.15
BARS = "▁▂▃▄▅▆▇█"
# Tempo bands and labels.
TEMPO_BANDS = ((0, 100, "Warm-Up"), (100, 118, "Groove"), (118, 128, "Peak-Time"), (128, 999, "High-Energy-Tempo"))
UNKNOWN_TEMPO = "Unknown-Tempo"
ENERGY_LABELS = ("Low", "Mid", "High")
UNKNOWN_ENERGY = "Unknown-Energy"
# Loudness target, silence limit and largest boost in decibels.
TARGET_LOUDNESS = -14.0
SILENT_LOUDNESS = -70.0
MAX_BOOST_DB = 12.0


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def is_sidecar(path: Col) -> Column:
    return base_name(path).startswith("._")


def extension_of(path: Col) -> Column:
    return F.coalesce(F.nullif(F.lower(suffix(path)), F.lit("")), F.lit(NO_EXTENSION))


def format_of(path: Col) -> Column:
    known = F.coalesce(F.try_element_at(_table(AUDIO_FORMATS), F.lower(suffix(path))), F.lit(OTHER))
    return F.when(is_sidecar(path), F.lit(SIDECAR)).otherwise(known)


def is_audio(fmt: Col) -> Column:
    return ~col(fmt).isin(OTHER, SIDECAR)


def not_junk_reason(path: Col) -> Column:
    return F.try_element_at(_table(NOT_JUNK), F.lower(suffix(path)))


def human_size(size: Col) -> Column:
    value = col(size).cast("double")
    out = F.when(F.abs(value) < 1024, F.format_string("%.0f B", F.bround(value, 0)))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        scaled = value / float(1024 ** power)
        out = out.when(F.abs(scaled) < 1024, F.format_string(f"%.1f {unit}", F.bround(scaled, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(value / float(1024 ** 4), 1)))


def human_duration(seconds: Col) -> Column:
    total = F.bround(F.greatest(F.lit(0.0), col(seconds).cast("double")), 0).cast("long")
    return F.when(col(seconds).isNotNull(), F.format_string(
        "%02d:%02d:%02d", F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60))


def _clock(seconds: Column) -> Column:
    total = F.bround(F.greatest(F.lit(0.0), seconds.cast("double")), 1)
    minutes = F.floor(total / 60)
    return F.format_string("%02d:%04.1f", minutes, F.bround(total - minutes * 60, 1))


def elapsed(time: Col) -> Column:
    return _clock(col(time))


def remaining(time: Col, duration: Col) -> Column:
    return F.when(col(duration).isNull(), two_places(time)).otherwise(
        F.concat(F.lit("-"), _clock(col(duration) - col(time))))


def parse_clock(text: Col) -> Column:
    """MM:SS or MM:SS.d as seconds; seconds must stay under 60."""
    pattern = "^\\s*([0-9]+):([0-9]{1,2}(?:\\.[0-9]+)?)\\s*$"
    minutes = F.regexp_extract(col(text), pattern, 1).try_cast("double")
    seconds = F.regexp_extract(col(text), pattern, 2).try_cast("double")
    return F.when(seconds < 60, minutes * 60 + seconds)


def length_told(seconds: Col) -> Column:
    minutes = F.bround(col(seconds).cast("double") / 60, 0).cast("long")
    hours = F.floor(minutes / 60)
    return F.when(hours > 0, F.format_string("%dh %02dm", hours, minutes % 60)).otherwise(
        F.format_string("%dm", minutes))


def energy_bar(mean: Col) -> Column:
    value = col(mean)
    step = F.least(F.lit(len(BARS) - 1), F.floor(value * len(BARS)).cast("int"))
    bar = F.element_at(F.array(*[F.lit(b) for b in BARS]), step + 1)
    return F.when(value.isNull() | F.isnan(value), F.lit("—")).otherwise(F.concat(two_places(value), F.lit(" "), bar))


def groove_pill(value: Col) -> Column:
    return F.when(col(value).isNotNull(), two_places(clamp(value, 0.0, 1.0)))


def decile(rank: Col) -> Column:
    """Rank 0..1 to 1..10."""
    value = col(rank)
    return F.when(value.isNotNull() & ~F.isnan(value),
                  F.least(F.lit(10), F.greatest(F.lit(1), 1 + F.floor(value * 10).cast("int"))))


def emotion_arrow(rank: Col) -> Column:
    value = col(rank)
    return F.when(value > 0.5 + NEUTRAL_ZONE, F.lit("↑")).when(value < 0.5 - NEUTRAL_ZONE, F.lit("↓"))


def tempo_band(bpm: Col) -> Column:
    out = None
    for low, high, name in TEMPO_BANDS:
        inside = (col(bpm) >= low) & (col(bpm) < high)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out.otherwise(F.lit(UNKNOWN_TEMPO))


def gain_for_target(loudness: Col, target: float = TARGET_LOUDNESS) -> Column:
    value = col(loudness).cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (value >= SILENT_LOUDNESS)
    gain = F.least(F.pow(F.lit(10.0), (target - value) / 20.0), F.lit(10 ** (MAX_BOOST_DB / 20)))
    return F.when(usable, gain).otherwise(F.lit(1.0))


def genre_level(genre: Col, level: str) -> Column:
    """``parent`` before the dash, ``leaf`` the whole label, ``none`` nothing."""
    if level == "none":
        return F.lit("")
    text = F.coalesce(col(genre), F.lit(""))
    return F.split_part(text, F.lit(" - "), F.lit(1)) if level == "parent" else text


def signed(value: Col) -> Column:
    return F.format_string("%+d", col(value).cast("long"))


def direction(value: Col) -> Column:
    return F.signum(col(value).cast("double")).cast("int")


# Share of the body level from which an ending is abrupt.
ABRUPT_ENDING = 0.5


def short_file_verdict(ending: Col, artist: Col, title: Col, error: Col) -> Column:
    said = lambda c: F.coalesce(col(c), F.lit("")) != ""
    sharp = F.coalesce(col(ending) >= ABRUPT_ENDING, F.lit(False))
    return (F.when(said(error), F.lit("unreadable"))
            .when(sharp & said(artist) & said(title), F.lit("cut off"))
            .when(sharp, F.lit("ends sharp, untagged"))
            .otherwise(F.lit("finished")))
