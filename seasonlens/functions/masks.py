"""Column helpers for raster-mask semantics on SQL NULLs.

A masked pixel is NULL and a mask must survive every binary operation.  SQL
arithmetic already does that; ``least``/``greatest`` do not (they skip NULLs),
so pixel-wise min/max/clamp go through the helpers here.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def nmin(a, b) -> Column:
    """Smaller of two values; NULL if either is NULL."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def nmax(a, b) -> Column:
    """Larger of two values; NULL if either is NULL."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def floor_at(x, lo: float) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))


def cap_at(x, hi: float) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(x, F.lit(hi)))


def clamp(x, lo: float, hi: float) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def unit_scale(x, lo: float, hi: float) -> Column:
    """Linear map of [lo, hi] onto [0, 1], clamped."""
    return clamp((as_col(x) - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0)


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(as_col(a), as_col(b))


def norm_diff(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    return F.try_divide(a - b, a + b)


def self_mask(x) -> Column:
    """Mask zeros."""
    return F.nullif(as_col(x), F.lit(0))


def keep_if(x, cond: Column) -> Column:
    """Mask x wherever cond is not true."""
    return F.when(cond, as_col(x))


def unmask(x, fill) -> Column:
    return F.coalesce(as_col(x), as_col(fill))


def in_range(x, lo: float, hi: float) -> Column:
    x = as_col(x)
    return F.when((x >= lo) & (x <= hi), x)


def flag(cond: Column) -> Column:
    """Boolean to 1.0 / 0.0, NULL kept, for averaging into shares."""
    return cond.cast("int").cast("double")
