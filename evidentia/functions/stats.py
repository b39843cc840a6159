"""Tail probabilities and quantiles that neither Spark nor this image's Python has: series and bisection."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    # Continued fraction by the modified Lentz steps.
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def bisect(f, low: float, high: float, target: float) -> float:
    """Where a growing function reaches the target."""
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < target else (low, middle)
    return (low + high) / 2


@functools.cache
def gamma_quantile(p: float, shape: float) -> float:
    high = shape + 10
    while gamma_p(shape, high) < p:
        high *= 2
    return bisect(lambda x: gamma_p(shape, x), 0, high, p)


def chi2_quantile(p: float, k: float) -> float:
    return 2 * gamma_quantile(p, k / 2)


def clopper_pearson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval for a binomial share."""
    if not n:
        return 0.0, 1.0
    tail = (1 - level) / 2
    low = 0.0 if hits == 0 else bisect(lambda p: beta_i(hits, n - hits + 1, p), 0, 1, tail)
    high = 1.0 if hits == n else bisect(lambda p: beta_i(hits + 1, n - hits, p), 0, 1, 1 - tail)
    return low, high


def cfar_alpha(pfa: float, cells: int) -> float:
    """Factor on the mean of so many noise cells that a cell of exponential power exceeds with this chance."""
    return cells * (pfa ** (-1 / cells) - 1)


def floor_alpha(pfa: float, pooled: int = 1) -> float:
    """Factor on a known floor for the mean of ``pooled`` cells."""
    return gamma_quantile(1 - pfa, pooled) / pooled


def pfa_of_alpha(alpha: float, cells: int) -> float:
    return (1 + alpha / cells) ** -cells


def sidak(p: float, trials: int) -> float:
    """The chance of at least one of so many independent trials."""
    return -math.expm1(trials * math.log1p(-min(p, 1 - 1e-16)))


def _log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    below = x
    for i in range(1, 8):
        below = below * (x + i)
    return series - F.ln(below)


#: Up to this count a Poisson tail's terms are written out, so that they are compiled.
SHORT_TAIL = 40


def poisson_tail(count: Column, mean: Column) -> Column:
    """P(X >= count) of a Poisson variable: terms from the count away from the mean, in units of the first, till they vanish.

    Above a count of n some 6 sqrt(n) terms matter, below it n: for small counts all are one nested product.
    """
    n, m = count.cast("double"), F.greatest(mean.cast("double"), F.lit(1e-300))
    above = n > m
    first = F.when(above, n).otherwise(n - 1)
    ratio = F.when(above, m / (n + 1)).otherwise(first / m)
    most = F.least(10 * F.sqrt(n) + 50, F.when(ratio <= 0, F.lit(1.0)).when(ratio < 1, -40 / F.ln(ratio) + 1)).cast("int")
    step = lambda k: F.when(above, m / (n + k)).otherwise(F.greatest(n - k, F.lit(0)) / m)
    total = F.aggregate(
        F.sequence(F.lit(1), most), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct((a["t"] * step(k)).alias("t"), (a["s"] + a["t"]).alias("s"))
    )["s"]
    over = under = F.lit(1.0)
    for k in range(SHORT_TAIL, 0, -1):
        over, under = 1 + over * m / (n + k), 1 + under * F.greatest(n - k, F.lit(0.0)) / m
    total = F.when(count <= SHORT_TAIL, F.when(above, over).otherwise(under)).otherwise(total)
    part = F.exp(first * F.ln(m) - m - _log_gamma(first + 1)) * total
    tail = F.when(above, part).otherwise(1 - part)
    return F.when(count <= 0, F.lit(1.0)).when(mean <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
