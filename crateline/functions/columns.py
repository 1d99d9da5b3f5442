"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Col) -> Column:
    return F.nullif(F.trim(col(value)), F.lit(""))


def labels(value: Col, separator: str = ";") -> Column:
    """A joined text as an array of trimmed, non-blank labels."""
    pieces = F.transform(F.split(F.coalesce(col(value), F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(pieces, lambda x: x != "")


def clamp(value: Col, low: float, high: float) -> Column:
    value = col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def two_places(value: Col) -> Column:
    return F.format_string("%.2f", F.bround(col(value).cast("double"), 2))


def percent(value: Col, places: int = 0) -> Column:
    return F.format_string(f"%.{places}f%%", F.bround(col(value).cast("double") * 100, places))
