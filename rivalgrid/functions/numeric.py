"""Numeric Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str) -> Column:
    """NULL and absent measures read as zero."""
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Bound a value. A NULL stays NULL (greatest/least alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when the denominator is not positive."""
    den = col(den)
    return F.when(den > 0, col(num) / den)


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def credibility(n: Column | str, k: float = 15.0) -> Column:
    """n / (n + k), zero for nothing observed."""
    n = col(n)
    return F.when(n > 0, n / (n + F.lit(k))).otherwise(F.lit(0.0))


def shrink_to_one(ratio_col: Column, n: Column | str, k: float = 10.0) -> Column:
    """Pull a ratio towards 1 when few rows back it."""
    n = col(n)
    return 1 + (ratio_col - 1) * (n / (n + F.lit(k)))


def bracket_byes(n: Column | str) -> Column:
    """Empty places in a single-elimination bracket of ``n`` entrants."""
    n = col(n)
    size = F.when(n > 1, F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-12))).otherwise(n)
    return (size - n).cast("int")


# Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function as a polynomial, so it stays inside generated code."""
    t = 1 / (1 + F.lit(_ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def win_probability(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column) -> Column:
    """P(A > B) for two independent normals; a step function when neither varies."""
    spread = F.sqrt(sd_a * sd_a + sd_b * sd_b)
    gap = mean_a - mean_b
    step = F.when(gap > 0, 1.0).when(gap < 0, 0.0).otherwise(0.5)
    return F.when(spread > 0, 0.5 * (1 + erf(gap / (spread * F.sqrt(F.lit(2.0)))))).otherwise(step)
