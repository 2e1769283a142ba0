"""Normal distribution, which Spark SQL does not offer, as column expressions, and the same formulas as SQL text.

Published rational approximations: the distribution function to about 1e-15, the quantile to a relative 1.2e-9.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import col

# Coefficients of the approximations, highest power first.
CDF_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
CDF_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
MIDDLE_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
MIDDLE_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
TAIL_TOP = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_BOTTOM = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
SPLIT, FAR, ROOT, TAIL = 7.07106781186547, 37.0, 2.506628274631, 0.02425


def _poly(c: list[float], x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + k
    return out


def normal_cdf(x) -> Column:
    """Distribution function; NULL and NaN stay what they are."""
    x = col(x).cast("double")
    z = F.abs(x)
    density, fraction = F.exp(-z * z / 2), z + 0.65
    for k in (4, 3, 2, 1):
        fraction = z + k / fraction
    lower = F.when(z > FAR, 0.0).when(z < SPLIT, density * _poly(CDF_TOP, z) / _poly(CDF_BOTTOM, z)).otherwise(density / fraction / ROOT)
    return F.when(F.isnan(x), x).when(x > 0, 1 - lower).otherwise(lower)


def normal_quantile(p) -> Column:
    """Inverse distribution function; NaN outside 0 to 1, infinite at the ends, NULL for NULL."""
    p = col(p).cast("double")
    less = F.least(p, 1 - p)
    centre, tail = p - 0.5, F.sqrt(-2 * F.log(less))
    middle = _poly(MIDDLE_TOP, centre * centre) * centre / _poly(MIDDLE_BOTTOM, centre * centre)
    outer = _poly(TAIL_TOP, tail) / _poly(TAIL_BOTTOM, tail)
    infinite = F.lit(float("inf"))
    return (
        F.when(F.isnan(p) | (p < 0) | (p > 1), F.lit(float("nan"))).when(p == 0, -infinite).when(p == 1, infinite)
        .when(less >= TAIL, middle).when(p < 0.5, outer).otherwise(-outer)
    )


def _poly_sql(c: list[float], x: str) -> str:
    out = f"CAST({c[0]!r} AS DOUBLE)"
    for k in c[1:]:
        out = f"({out} * {x} + CAST({k!r} AS DOUBLE))"
    return out


def cdf_sql(x: str) -> str:
    """SQL text of ``normal_cdf`` of a column."""
    z, fraction = f"abs({x})", f"(abs({x}) + 0.65)"
    for k in (4, 3, 2, 1):
        fraction = f"({z} + {k} / {fraction})"
    density = f"exp(-{z} * {z} / 2)"
    lower = f"CASE WHEN {z} > {FAR} THEN 0.0 WHEN {z} < {SPLIT} THEN {density} * {_poly_sql(CDF_TOP, z)} / {_poly_sql(CDF_BOTTOM, z)} ELSE {density} / {fraction} / {ROOT} END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({lower}) ELSE {lower} END"


def quantile_sql(p: str) -> str:
    """SQL text of ``normal_quantile`` of a column inside 0 to 1."""
    less, centre = f"least({p}, 1 - {p})", f"({p} - 0.5)"
    square, tail = f"({centre} * {centre})", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{_poly_sql(MIDDLE_TOP, square)} * {centre} / {_poly_sql(MIDDLE_BOTTOM, square)}"
    outer = f"{_poly_sql(TAIL_TOP, tail)} / {_poly_sql(TAIL_BOTTOM, tail)}"
    return f"CASE WHEN {less} >= {TAIL} THEN {middle} WHEN {p} < 0.5 THEN {outer} ELSE -({outer}) END"
