"""Distribution tails without a statistics library."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) with ``dof`` degrees of freedom."""
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile(prob: float, dof: float) -> float:
    """Upper quantile ``q`` with P(T <= q) = prob, prob >= 0.5.

    Above a thousand degrees the normal expansion is exact to double
    precision; below, bisection on the tail.
    """
    if dof > 1000:
        z = _normal_quantile(prob)
        return (
            z
            + (z**3 + z) / (4 * dof)
            + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof**2)
            + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * dof**3)
        )
    target = 2.0 * (1.0 - prob)
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > target:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if t_two_sided(mid, dof) > target:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def _normal_quantile(prob: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(prob)


# Up to this many terms the tail is summed from the first term; beyond it the
# sum starts at the largest index, where Stirling's series is exact.
DIRECT_TERMS = 256


def chi2_even_tail(half_stat: Column, pairs: Column) -> Column:
    """P(chi-square with ``2*pairs`` degrees >= ``2*half_stat``), JVM-side.

    The tail equals ``exp(-s) * sum_{i<k} s**i/i!``. Up to
    :data:`DIRECT_TERMS` terms are added in order. For more terms, only those
    near the dominant index can reach double precision: about ``9*sqrt(k)`` of
    them, walking away from ``k`` with the leading term from Stirling's series.
    """
    k = pairs.cast("double")
    s = half_stat.cast("double")
    # sum with a running log-scale: state (log of term, log of sum)
    ordered = F.aggregate(
        F.sequence(
            F.lit(1),
            F.greatest(F.least(pairs.cast("int"), F.lit(DIRECT_TERMS)) - 1, F.lit(1)),
            F.lit(1),
        ),
        F.struct((-s).alias("t"), (-s).alias("acc")),
        lambda a, i: F.struct(
            (a["t"] + F.ln(s / i)).alias("t"),
            _log_add(a["acc"], a["t"] + F.ln(s / i)).alias("acc"),
        ),
        lambda a: F.exp(a["acc"]),
    )
    direct = F.when(k == 1, F.exp(-s)).otherwise(ordered)
    # beyond: term index k-1 (walk down) when s >= k, index k (walk up) otherwise
    steps = (F.lit(9.0) * F.sqrt(F.greatest(k, s)) + F.lit(60.0)).cast("int")
    down = _lead(k - 1, s) * _series(F.least(steps, pairs.cast("int") - 1), lambda i: (k - i) / s)
    up = F.lit(1.0) - _lead(k, s) * _series(steps, lambda i: s / (k + i))
    tail = F.when(k <= DIRECT_TERMS, direct).when(s >= k, down).otherwise(up)
    return F.when(s <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def _log_add(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(F.least(a, b) - top))


def _lead(i: Column, s: Column) -> Column:
    """``exp(-s) * s**i / i!`` with Stirling's series for the factorial."""
    m = i + 1.0
    log_gamma = (
        (m - 0.5) * F.ln(m) - m + F.lit(0.5 * math.log(2 * math.pi))
        + 1.0 / (12.0 * m) - 1.0 / (360.0 * m * m * m)
    )
    return F.exp(-s + i * F.ln(s) - log_gamma)


def _series(n: Column, ratio) -> Column:
    """``1 + r1 + r1*r2 + ...`` for ``n`` ratios."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(1)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("acc")),
        lambda a, i: F.struct(
            (a["t"] * ratio(i)).alias("t"), (a["acc"] + a["t"] * ratio(i)).alias("acc")
        ),
        lambda a: a["acc"],
    )
