"""Chi-square quantile: one scalar for a threshold, computed on the driver."""

from __future__ import annotations

import math


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function P(a, x)."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return scale * total
    # Lentz's method for the continued fraction of the upper function.
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        step = c * d
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1.0 - scale * h


def chi2_quantile(q: float, df: float, scale: float = 1.0) -> float:
    """x with P(chi2(df) * scale <= x) = q."""
    low, high = 0.0, max(1.0, df)
    while _lower_gamma(df / 2, high / 2) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _lower_gamma(df / 2, mid / 2) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2 * scale
