"""Column expressions whose null and rounding rules differ from Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _null_if_any(value: Column, columns: tuple[Column, ...]) -> Column:
    return F.when(reduce(lambda a, b: a | b, (c.isNull() for c in columns)), None).otherwise(value)


def null_greatest(*columns: Column) -> Column:
    """The greatest, or null if any is null (Spark's own skips nulls)."""
    return _null_if_any(F.greatest(*columns), columns)


def null_least(*columns: Column) -> Column:
    return _null_if_any(F.least(*columns), columns)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """c held within lo and hi; null stays null."""
    return null_greatest(F.lit(lo), null_least(F.lit(hi), c))


def q_round(c: Column, n: int) -> Column:
    """Rounds half up by way of a decimal, so that every engine agrees."""
    return F.round(c.cast("decimal(28,9)"), n).cast("double")


def flag(c: Column) -> Column:
    """A "true"/"false" text in any case; missing means false."""
    return F.coalesce(F.lower(c) == "true", F.lit(False))
