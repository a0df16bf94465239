"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' approximation of the gamma function with g = 7 and nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    y = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, two terms a step."""
    off_zero = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d1, c1 = 1 / off_zero(1 + even * s["d"]), off_zero(1 + even / s["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        half = F.struct(d1.alias("d"), c1.alias("c"), (s["h"] * d1 * c1).alias("h"), odd.alias("odd"))
        return F.transform(F.array(half), lambda t: _second(t, off_zero))[0]

    first = 1 / off_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])


def _second(t: Column, off_zero) -> Column:
    d, c = 1 / off_zero(1 + t["odd"] * t["d"]), off_zero(1 + t["odd"] / t["c"])
    return F.struct(d.alias("d"), c.alias("c"), (t["h"] * d * c).alias("h"))


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """The regularised incomplete beta function I_x(a, b): its fraction, on the side where that converges."""
    inside = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    near = inside < (a + 1) / (a + b + 2)
    p, q, y = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, inside).otherwise(1 - inside)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(inside) + b * F.log(1 - inside)) / p
    part = front * _fraction(p, q, y, steps)
    return F.when(inside <= 0, 0.0).when(inside >= 1, 1.0).otherwise(F.when(near, part).otherwise(1 - part))


def correlation_p_value(r: Column, n: Column, steps: int = 300) -> Column:
    """Two-sided probability of a correlation at least as far from 0 among ``n`` independent pairs (Student's t of n - 2 degrees); null below three pairs, 0 at 1."""
    x, free = r.cast("double"), (n - 2).cast("double")
    return F.when((n >= 3) & x.isNotNull(), incomplete_beta(free / 2, F.lit(0.5), 1 - x * x, steps))
