"""Tail probabilities and quantiles on the driver, in plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def clamp(p: float) -> float:
    return 1.0 if math.isnan(p) else min(1.0, max(0.0, p))


def _fraction(first, terms, tiny: float = 1e-300, close: float = 1e-15, most: int = 10_000) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by Lentz's method."""
    f = first or tiny
    c, d = f, 0.0
    for _, (a, b) in zip(range(most), terms, strict=False):
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        step = c * d
        f *= step
        if abs(step - 1) < close:
            break
    return f


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)

    def terms():
        yield 1.0, 1.0
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _fraction(0.0, terms())


def gamma_above(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front

    def terms():
        n = 0
        yield 1.0, x + 1 - a
        while True:
            n += 1
            yield -n * (n - a), x + 2 * n + 1 - a

    return front * _fraction(0.0, terms())


def t_two_sided(t: float, df: float) -> float:
    if df <= 0:
        return 1.0
    return clamp(beta_share(df / (df + t * t), df / 2, 0.5))


def t_critical(df: float, level: float = 0.95) -> float:
    """The value that a share ``level`` of a t distribution lies within."""
    if df <= 0:
        return 0.0
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - level:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(middle, df) > 1 - level else (low, middle)
    return (low + high) / 2


def chi_square_above(x: float, df: float) -> float:
    return 1.0 if df <= 0 else clamp(gamma_above(df / 2, x / 2))


def f_above(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return 1.0 if f <= 0 else clamp(beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2))


def normal_quantile(p: float) -> float:
    return NORMAL.inv_cdf(p)


def normal_above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def polynomial(coefficients, x: float) -> float:
    out = 0.0
    for c in reversed(coefficients):
        out = out * x + c
    return out


# Royston's coefficients (Applied Statistics algorithm AS R94, 1995).
C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
C3 = (0.5440, -0.39978, 0.025054, -6.714e-4)
C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
C6 = (-0.4803, -0.082676, 0.0030302)
G = (-2.273, 0.459)


def shapiro_wilk(values: list[float]) -> tuple[float, float, str]:
    """(W, p, note) of a sample in ascending order."""
    n = len(values)
    if n < 3:
        return 1.0, 1.0, "sample too small"
    if values[0] == values[-1]:
        return 1.0, 1.0, "constant data"
    if n == 3:
        weights = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        m = [normal_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
        size = sum(x * x for x in m)
        u = 1 / math.sqrt(n)
        top = m[-1] / math.sqrt(size) + polynomial(C1, u)
        if n <= 5:
            phi = (size - 2 * m[-1] ** 2) / (1 - 2 * top * top)
            weights = [-top, *(x / math.sqrt(phi) for x in m[1:-1]), top]
        else:
            second = m[-2] / math.sqrt(size) + polynomial(C2, u)
            phi = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * top * top - 2 * second * second)
            weights = [-top, -second, *(x / math.sqrt(phi) for x in m[2:-2]), second, top]
    mean = sum(values) / n
    w = sum(a * x for a, x in zip(weights, values, strict=True)) ** 2 / sum((x - mean) ** 2 for x in values)
    w = min(w, 1.0)
    if n == 3:
        return _verdict(w, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:  # its logarithm has no bound
        return _verdict(1.0, 1.0)
    if n <= 11:
        lift = max(1e-12, polynomial(G, n) - math.log1p(-w))
        z = (-math.log(lift) - polynomial(C3, n)) / math.exp(polynomial(C4, n))
    else:
        u = math.log(n)
        z = (math.log1p(-w) - polynomial(C5, u)) / math.exp(polynomial(C6, u))
    return _verdict(w, normal_above(z))


def _verdict(w: float, p: float) -> tuple[float, float, str]:
    """W, p, and the text that must be shown with them."""
    p = clamp(p)
    return w, p, "deviates from normality (p < 0.05)" if p < 0.05 else "consistent with normality (p >= 0.05)"
