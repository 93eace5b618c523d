"""Statistical column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Rational approximation of the normal tail (Hart 1968), highest power first.
TAIL_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
TAIL_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of the standard normal, to about 1e-15."""
    x = F.abs(z)
    bell = F.exp(-x * x / F.lit(2.0))
    near = bell * _horner(x, TAIL_NUMERATOR) / _horner(x, TAIL_DENOMINATOR)
    f = x + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        f = x + F.lit(k) / f
    far = bell / f / F.lit(math.sqrt(2 * math.pi))
    return F.when(x.isNull(), None).when(x > 37, F.lit(0.0)).when(x < 7.07106781186547, near).otherwise(far)


def two_sided_p(z: Column) -> Column:
    return normal_tail(z) * F.lit(2.0)


def chi2_tail(x: Column, df: int) -> Column:
    """P(X > x) of chi-square with an even number of degrees of freedom (closed form)."""
    if df % 2:
        raise ValueError("closed form needs an even number of degrees of freedom")
    half = x / F.lit(2.0)
    term = F.lit(1.0)
    total = F.lit(1.0)
    for i in range(1, df // 2):
        term = term * half / F.lit(float(i))
        total = total + term
    return F.exp(-half) * total


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = 2.0) -> Column:
    """F-beta from counts, 0 when undefined."""
    b2 = F.lit(float(beta) ** 2)
    hit = (F.lit(1.0) + b2) * tp
    return F.coalesce(F.try_divide(hit, hit + b2 * fn + fp), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(small / (F.lit(1.0) + small))
