"""Distribution functions as native column expressions (fixed Gauss-Legendre nodes, no Python at run time)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.safe import col

_NODES, _WEIGHTS = (x.tolist() for x in np.polynomial.legendre.leggauss(32))


def t_constant(nu: float) -> float:
    return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)


def student_t_cdf(x: str | Column, nu: float | Column, loc=0.0, scale=1.0, constant: Column | None = None) -> Column:
    """P(T <= x). With t = sqrt(nu) tan(theta) the density becomes cos(theta)^(nu - 1), smooth on the whole line.

    nu is a number, or a column together with ``constant`` (t_constant of each row's nu, from the parameter table).
    """
    if constant is None:
        constant, nu = F.lit(t_constant(nu)), F.lit(float(nu))
    theta = F.atan((col(x) - loc) / scale / F.sqrt(nu))
    total = sum((F.lit(w) * F.pow(F.cos(theta * ((1 + n) / 2)), nu - 1) for n, w in zip(_NODES, _WEIGHTS)), F.lit(0.0))
    return F.lit(0.5) + constant * F.sqrt(nu) * theta / 2 * total


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, and the recurrence down."""
    y = x + 8
    i = 1 / (y * y)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / y
    steps = F.lit(1.0)
    for k in range(8):
        steps = steps * (x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def t_constants(nu: Column) -> Column:
    """t_constant of each row's nu."""
    return F.exp(log_gamma((nu + 1) / 2) - log_gamma(nu / 2)) / F.sqrt(nu * math.pi)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """The regularised incomplete beta function I_x(a, b), for any a, b > 0.

    Its continued fraction, evaluated from the front, converges quickly below x = (a + 1) / (a + b + 2); above, by symmetry.
    """
    one, tiny = F.lit(1.0), 1e-300
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)
    given = F.struct(p.alias("p"), q.alias("q"), y.alias("y"))
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(g: Column) -> Column:
        p, q, y = g["p"], g["q"], g["y"]
        first = 1 / safe(1 - (p + q) * y / (p + 1))

        def step(s, i):
            m = i.cast("double")
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            # Nested structs, so that each value is computed once.
            s1 = F.struct((1 / safe(1 + even * s["d"])).alias("d"), safe(1 + even / s["c"]).alias("c"), s["h"].alias("h"))
            return F.transform(
                F.transform(F.array(s1), lambda t: F.struct((1 / safe(1 + odd * t["d"])).alias("d"), safe(1 + odd / t["c"]).alias("c"), (t["h"] * t["d"] * t["c"]).alias("h"))),
                lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"), (t["h"] * t["d"] * t["c"]).alias("h")),
            )[0]

        start = F.struct(first.alias("d"), one.alias("c"), first.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])

    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(y) + q * F.ln(1 - y)) / p
    share = front * F.transform(F.array(given), fraction)[0]
    inside = F.when(turned, 1 - share).otherwise(share)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def two_sided_t(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) for any degrees of freedom."""
    n = freedom.cast("double")
    return incomplete_beta(n / 2, F.lit(0.5), n / (n + t * t))


def normal_cdf(x: str | Column) -> Column:
    """Phi(x), with x clipped to +-8.5; one half for NaN."""
    z = F.least(F.greatest(F.nanvl(col(x), F.lit(0.0)), F.lit(-8.5)), F.lit(8.5))
    z = F.when(col(x).isNotNull(), z)
    total = sum((F.lit(w) * F.exp(-F.pow(z * ((1 + n) / 2), F.lit(2.0)) / 2) for n, w in zip(_NODES, _WEIGHTS)), F.lit(0.0))
    return F.lit(0.5) + z / 2 * total / math.sqrt(2 * math.pi)


def signed_imbalance(buy: str | Column) -> Column:
    return 2 * col(buy) - 1


def wilson(correct: Column, scored: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    n = F.nullif(scored.cast("double"), F.lit(0.0))
    p = correct / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def z_against_half(correct: Column, scored: Column) -> Column:
    n = F.nullif(scored.cast("double"), F.lit(0.0))
    return (correct / n - 0.5) / F.sqrt(F.lit(0.25) / n)


def detectable_effect(scored: Column, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """The least departure from one half found with 80 % power."""
    return F.lit(z_alpha + z_power) * F.sqrt(F.lit(0.25) / F.nullif(scored.cast("double"), F.lit(0.0)))
