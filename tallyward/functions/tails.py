"""Tail probability used on the few aggregated chi-squared rows."""

from __future__ import annotations

import math

# Far more than the continued fraction needs near its slowest point, where it takes about the root of ``a``.
STEPS = 1_000_000


def upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    # Continued fraction, evaluated from the front.
    b = x + 1.0 - a
    c = 1e300
    d = 1.0 / b
    value = d
    for i in range(1, STEPS):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-15:
            return min(1.0, scale * value)
    raise ArithmeticError(f"no tail probability for {a}, {x}")
