"""A dark-to-bright reading of weighted labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col, labels

# Labels that pull down and labels that pull up; all others are neutral.
DARK = ("Dark", "Deep", "Drama", "Dramatic", "Emotional", "Heavy", "Melancholic", "Sad")
BRIGHT = ("Fun", "Funny", "Happy", "Hopeful", "Inspiring", "Love", "Motivational", "Party", "Positive",
          "Romantic", "Summer", "Upbeat", "Uplifting")
# Thresholds and caps of the stored readings.
WORD_THRESHOLD = 0.05
WEIGHT_THRESHOLD = 0.02
MAX_WEIGHTS = 8


def polarity(label: Column) -> Column:
    return F.when(label.isin(*DARK), -1.0).when(label.isin(*BRIGHT), 1.0).otherwise(0.0)


def word_valence(moods: Col) -> Column:
    """Mean polarity, the k-th label weighing 1/k; no label at all gives NULL."""
    words = labels(moods)
    weights = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: 1.0 / k)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    signed = F.zip_with(words, weights, lambda w, k: polarity(w) * k)
    return F.when(F.size(words) > 0, total(signed) / total(weights))


def weights(text: Col) -> Column:
    """``"Dark:0.62; Deep:0.41"`` as label/value pairs; pieces that do not parse are left out."""
    pairs = F.transform(labels(text), lambda p: F.struct(
        F.trim(F.regexp_replace(p, ":[^:]*$", "")).alias("label"),
        F.trim(F.regexp_extract(p, ":([^:]*)$", 1)).try_cast("double").alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def spell_weights(pairs: Col) -> Column:
    """Pairs written strongest first with three decimals; equal ones keep their order."""
    placed = F.transform(col(pairs), lambda p, i: F.struct(
        (-p["value"]).alias("key"), i.alias("at"), p["label"].alias("label"), p["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: F.concat(
        p["label"], F.lit(":"), F.format_string("%.3f", F.bround(p["value"], 3)))), "; ")


def sides(pairs: Col, floor: float = 0.0, ceiling: float | None = None, balanced: bool = True) -> tuple[Column, ...]:
    """Dark, bright and neutral totals of the scores above ``floor`` and not above ``ceiling``."""
    def total(test) -> Column:
        kept = F.filter(col(pairs), lambda p: (p["value"] > floor) & test(p["label"])
                        & (F.lit(True) if ceiling is None else p["value"] <= ceiling))
        return F.aggregate(kept, F.lit(0.0), lambda s, p: s + p["value"])

    dark, bright = total(lambda x: x.isin(*DARK)), total(lambda x: x.isin(*BRIGHT))
    plain = total(lambda x: ~x.isin(*DARK, *BRIGHT))
    if balanced:
        dark, bright = dark / len(DARK), bright / len(BRIGHT)
    return dark, bright, plain


def valence_of(pairs: Col, floor: float = 0.0, ceiling: float | None = None, balanced: bool = True,
               dilute: bool = False) -> Column:
    """(bright - dark) / (bright + dark); no colour at all gives NULL."""
    dark, bright, plain = sides(pairs, floor, ceiling, balanced)
    coloured = dark + bright
    return F.when(coloured > 0, (bright - dark) / (coloured + plain if dilute else coloured))


def evidence(pairs: Col) -> Column:
    dark, bright, _ = sides(pairs)
    return dark + bright


def faint_only(pairs: Col, threshold: float = WORD_THRESHOLD) -> Column:
    """Colour that comes only from scores under the word threshold."""
    return valence_of(pairs, floor=threshold).isNull() & valence_of(pairs).isNotNull()


def select_labels(pairs: Col, threshold: float, limit: int, fallback: bool = True) -> Column:
    """Strongest labels at or above the threshold; optionally the best one when none pass."""
    placed = F.transform(col(pairs), lambda p, i: F.struct(
        (-p["value"]).alias("key"), i.alias("at"), p["label"].alias("label"), p["value"].alias("value")))
    ordered = F.slice(F.array_sort(placed), 1, limit)
    plain = lambda a: F.transform(a, lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value")))
    chosen = F.filter(ordered, lambda p: p["value"] >= threshold)
    if not fallback:
        return plain(chosen)
    return plain(F.when(F.size(chosen) == 0, F.slice(ordered, 1, 1)).otherwise(chosen))


def mood_numbers(pairs: Col) -> dict[str, Column]:
    """The three stored fields of a scored row."""
    return {
        "valence": F.bround(valence_of(pairs), 4),
        "mood_evidence": F.bround(evidence(pairs), 3),
        "mood_conf": spell_weights(select_labels(pairs, WEIGHT_THRESHOLD, MAX_WEIGHTS)),
    }


def positive_class(classes: Col) -> Column:
    """0-based index of the only class that is not a negation, else 0."""
    at = F.transform(col(classes), lambda c, i: F.when(~F.lower(c).rlike("^(non|not)"), i))
    found = F.array_compact(at)
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(0)


def distinctive(moods: Col, common: Col) -> Column:
    """The label that is rarest in the catalogue; the earlier one of equals."""
    placed = F.transform(labels(moods), lambda m, i: F.struct(
        F.coalesce(F.try_element_at(col(common), m), F.lit(0)).cast("long").alias("count"),
        i.alias("at"), m.alias("label")))
    return F.array_min(placed)["label"]


def summary(moods: Col, common: Col) -> Column:
    rare = distinctive(moods, common)
    rest = F.array_join(F.array_remove(labels(moods), rare), "; ")
    return F.when(rare.isNull(), F.lit("")).when(rest == "", rare).otherwise(F.concat(rare, F.lit(" · "), rest))
