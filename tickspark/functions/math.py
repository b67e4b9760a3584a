"""Numeric column expressions missing from the built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal tail by Hart (1968),
# as given by West, "Better approximations to cumulative normal functions" (2005).
HART_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Polynomial with the highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error about 1e-15.

    A closed expression, so it stays inside generated code.  Beyond 37 deviations the tail is 0.
    """
    a = F.abs(z)
    decay = F.exp(-a * a / 2)
    near = decay * horner(a, HART_NUMERATOR) / horner(a, HART_DENOMINATOR)
    far = decay / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + F.lit(0.65)))))) / F.lit(2.506628274631)
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """``a / b``, or ``default`` where ``b`` is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))
