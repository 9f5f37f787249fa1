"""Distribution functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Lanczos' approximation of the gamma function for g = 7.
_G, _LANCZOS = 7, (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
_HALF_LN_2PI = 0.9189385332046727
#: Steps of the continued fraction; it converges in some ten times the square root of the larger parameter, and in far fewer here.
STEPS = 300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive x."""
    z = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + (_G + 0.5)
    return F.lit(_HALF_LN_2PI) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the front."""
    off_zero = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def turn(s: Column, term: Column) -> Column:
        d, c = 1 / off_zero(1 + term * s.d), off_zero(1 + term / s.c)
        return state(c, d, s.h * c * d)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.aggregate(F.array(even, odd), s, turn)

    d = 1 / off_zero(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), state(F.lit(1.0), d, d), step, lambda s: s.h)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) of positive a and b; null where something is null."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    below = front * _fraction(a, b, x) / a
    above = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), below).otherwise(above)


def student_p(t: Column, degrees: Column) -> Column:
    """The probability of a t at least as far from 0, on either side."""
    return F.when(degrees > 0, incomplete_beta(degrees / 2, F.lit(0.5), degrees / (degrees + t * t)))
