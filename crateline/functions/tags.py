"""Reading and writing label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, blank_to_null, col, percent


def split_tag(value: Col, hierarchy: bool = True) -> Column:
    """Split on ``;`` and ``,`` (and `` - ``), trimmed, first spelling of equal words kept."""
    pattern = "[;,]| - " if hierarchy else "[;,]"
    pieces = F.filter(F.transform(F.split(F.coalesce(col(value), F.lit("")), pattern), lambda p: F.trim(p)), lambda p: p != "")
    lowered = F.transform(pieces, F.lower)
    return F.filter(pieces, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1)


def genre_tag(raw: Col, style: str = "parent_child") -> Column:
    """``Parent---Child`` rewritten in one of the reading styles."""
    text = col(raw)
    if style == "raw":
        return text
    above = F.trim(F.regexp_extract(text, "(?s)^(.*?)---", 1))
    below = F.trim(F.regexp_extract(text, "(?s)^.*?---(.*)$", 1))
    shown = {
        "child_parent": F.concat(below, F.lit(" - "), above),
        "child_only": below,
        "parent_child": F.concat(above, F.lit(" - "), below),
    }[style]
    return F.when(~text.contains("---"), text).when(below == "", above).otherwise(shown)


def title_case(text: Col) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    lowered = F.lower(col(text))
    marked = F.regexp_replace(lowered, "(?<!\\p{L})(\\p{L})", "\u0000$1")
    pieces = F.split(marked, "\u0000")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.upper(F.substring(p, 1, 1)), F.regexp_replace(p, "(?s)^.", "")))), "")


def first_genre(raw: Col) -> Column:
    text = F.trim(F.split_part(F.split_part(F.coalesce(col(raw), F.lit("")), F.lit(","), F.lit(1)), F.lit("/"), F.lit(1)))
    return F.when(text == "", F.lit("Unclassified")).otherwise(title_case(text))


def first_filled(values: Col) -> Column:
    """First non-blank text of an array, trimmed."""
    return F.try_element_at(F.filter(F.transform(col(values), lambda v: F.trim(v)), lambda v: v != ""), F.lit(1))


def coverage(genre: Col, comment: Col) -> dict[str, Column]:
    has_genre, has_comment = blank_to_null(genre).isNotNull(), blank_to_null(comment).isNotNull()
    return {"has_genre": has_genre, "has_comment": has_comment, "complete": has_genre & has_comment}


def tag_values(genres: Col, moods: Col, moods_in_tag: int = 3, style: str = "parent_child",
               percents: bool = True) -> dict[str, Column]:
    """The texts to write for label/value arrays."""
    picked = F.slice(col(moods), 1, moods_in_tag)
    join = lambda array, spell, by: F.nullif(F.array_join(F.transform(array, spell), by), F.lit(""))
    mood = join(picked, lambda m: title_case(m["label"]), "; ")
    spelled = join(picked, lambda m: F.concat(title_case(m["label"]), F.lit(" "), percent(m["value"])), "; ")
    with_share = lambda p: F.concat(p["label"], F.lit(": "), percent(p["value"], 2))
    return {
        "genre": join(col(genres), lambda g: genre_tag(g["label"], style), "; "),
        "genre_confidence": join(col(genres), with_share, ", "),
        "mood": mood,
        "mood_confidence": join(picked, with_share, ", "),
        "comment": spelled if percents else mood,
    }
