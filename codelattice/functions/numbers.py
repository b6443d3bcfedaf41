"""Rounding and clamping with the same tie behaviour everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIE = 1e-9


def rounded(col: Column, digits: int = 4) -> Column:
    """Round with a nudge, so binary noise at a tie cannot change the digit."""
    return F.round(col + F.lit(_TIE), digits)


def unit(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def capped(col: Column, cap: float) -> Column:
    return F.least(col, F.lit(cap))
