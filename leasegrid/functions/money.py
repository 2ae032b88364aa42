"""Money as doubles: rounding of the exact binary value, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(x: Column, scale: float) -> Column:
    # p is |x| * scale as a double; what that product lost is recovered by splitting |x| in two
    # halves of 26 bits, so that a tie is decided by the exact product.
    y = F.abs(x)
    p = y * F.lit(scale)
    t = y * F.lit(134217729.0)
    high = t - (t - y)
    lost = (high * F.lit(scale) - p) + (y - high) * F.lit(scale)
    up = F.when((p - F.floor(p).cast("double") - F.lit(0.5)) + lost >= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.signum(x) * (F.floor(p).cast("double") + up) / F.lit(scale) + F.lit(0.0)


def fix2(x: Column | str) -> Column:
    """x to cents."""
    return _fixed(F.col(x) if isinstance(x, str) else x, 1e2)


def fix6(x: Column | str) -> Column:
    """x to six decimals."""
    return _fixed(F.col(x) if isinstance(x, str) else x, 1e6)


def whole_cents(x: Column | str) -> Column:
    """An amount of whole cents as their number."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 100 + 0.5)


def half_up2(x: Column) -> Column:
    """x to cents by floor(100 x + 1/2), as rent steps of a quick entry are."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def growth(year1: Column, rate: Column, years: Column) -> Column:
    return year1 * F.pow(F.lit(1.0) + rate, years.cast("double"))


def clamp_percent(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) <= tolerance
