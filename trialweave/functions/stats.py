"""Numeric column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Report rounding: six decimals, never a negative zero.

    The small nudge sends decimal halves (0.0000005) the same way whatever the last bit
    of a distributed sum. Decimal rounding costs about a microsecond a value; away from a
    half the nearest whole number of millionths is the same double and costs next to nothing.
    """
    x = col(c).cast("double") + F.lit(1e-10)
    y = x * F.lit(1e6)
    k = F.rint(y)
    plain = (F.abs(y) < 1e12) & (F.abs(y - k) < 0.499)  # false for NaN, which is above every number
    return F.when(plain, k / F.lit(1e6)).otherwise(F.round(x, 6)) + F.lit(0.0)


def clamp(c, bound: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(-bound)), F.lit(bound))


def fisher_z(r, epsilon: float = 1e-12) -> Column:
    """Inverse hyperbolic tangent of a correlation kept away from +-1."""
    return F.atanh(clamp(r, 1.0 - epsilon))


def finite(c) -> Column:
    """True where a value is neither missing, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def only_finite(c) -> Column:
    """The value where it is finite, else NULL."""
    return F.when(finite(c), col(c))


def nan_to_null(c) -> Column:
    """NaN means missing in files; inside Spark missing is NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def seeded_key(seed, *parts) -> Column:
    """Reproducible random text key: the order it gives depends on no partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def seeded_chunk(key, hex_digits: int = 1) -> Column:
    """Leading hex digits of a seeded key: an even split that keeps the key order."""
    return F.substring(col(key), 1, hex_digits)


def pearson(a, b) -> Column:
    """Correlation aggregate that is NULL, not an error, where a side has no variance."""
    a, b = col(a), col(b)
    sd = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.covar_pop(a, b) / F.nullif(sd, F.lit(0.0))
