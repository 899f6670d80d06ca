"""Small numeric expressions whose null rules matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, null where the denominator is zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def clamp(value: Column) -> Column:
    """Clamp to [0, 1].  Nulls are skipped by least/greatest, so a null becomes 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def at_most_one(value: Column) -> Column:
    """Upper clamp alone; a null becomes 1 as well."""
    return F.least(F.lit(1.0), value)


def decade(period: Column, size: int = 10) -> Column:
    """First period of the block of ``size`` periods, with the type of the input kept."""
    return period - period % F.lit(size)
