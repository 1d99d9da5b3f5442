"""Dense vectors held as arrays; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col

TINY = 1e-9


def _zero() -> Column:
    return F.lit(0.0)


def dot(a: Col, b: Col) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, _zero(), lambda s, x: s + x)


def norm(a: Col) -> Column:
    return F.sqrt(F.aggregate(col(a), _zero(), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Col) -> Column:
    length = F.greatest(norm(a), F.lit(TINY))
    return F.transform(col(a), lambda x: x.cast("double") / length)


def cosine(a: Col, b: Col) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def sound_distance(a: Col, b: Col) -> Column:
    """1 - cosine, kept inside 0..1."""
    return F.greatest(_zero(), F.least(F.lit(1.0), 1.0 - cosine(a, b)))


def seed_distance(a: Col, seed: Col) -> Column:
    """1 - cosine inside 0..2; a seed of length zero is at distance 0 of everything."""
    raw = F.greatest(_zero(), F.least(F.lit(2.0), 1.0 - cosine(a, seed)))
    return F.when(norm(seed) > 0, raw).otherwise(_zero())


def ahead(previous: Col, last: Col, trend: float) -> Column:
    """One more step of the same direction, shortened or stretched by ``trend``."""
    return F.zip_with(col(last), col(previous),
                      lambda x, y: x.cast("double") + trend * (x.cast("double") - y.cast("double")))


def ahead_number(previous: Col, last: Col, trend: float) -> Column:
    """The same step for a number; stays put when the earlier one is unknown."""
    return F.when(col(previous).isNull(), col(last)).otherwise(col(last) + trend * (col(last) - col(previous)))
