"""Tail probabilities of a few distributions, for single aggregated values on the driver."""

from __future__ import annotations

import math
from fractions import Fraction


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, dof: int) -> float:
    """P(X >= x): regularised upper incomplete gamma of dof/2, x/2 by series below and continued fraction above."""
    if x <= 0:
        return 1.0
    a, t = dof / 2, x / 2
    front = math.exp(a * math.log(t) - t - math.lgamma(a))
    if t < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= t / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b = t + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for n in range(1, 1000):
        k = -n * (n - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 2000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    return _beta(dof / 2, 0.5, dof / (dof + t * t))


def _orders(m: int, n: int) -> list[int]:
    """For each U from 0 to m n the number of orders of m and n values that have it: the coefficients of the product
    of (1 - q^(n+i)) / (1 - q^i) over i up to m, filled in one pass per factor."""
    ways = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            ways[u] -= ways[u - n - i]
        for u in range(i, m * n + 1):
            ways[u] += ways[u - i]
    return ways


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p: exact if a sample has at most 8 values and there are no ties, else normal with tie and continuity correction.

    ``ties`` is the sum of t^3 - t over groups of tied values.
    """
    top = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= 8:
        k = math.ceil(top)
        tail = sum(_orders(min(n1, n2), max(n1, n2))[k:])
        return min(1.0, float(Fraction(2 * tail, math.comb(n1 + n2, n1))))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, normal_two_sided(max(0.0, top - n1 * n2 / 2 - 0.5) / math.sqrt(var)))
