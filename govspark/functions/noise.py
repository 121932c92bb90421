"""Laplace noise.

Plain floating-point Laplace sampling (``laplace``) leaks information through the spacing of doubles (Mironov 2012); use it for
reporting, not against an adversary who sees many releases. ``discrete_laplace`` is for values on a fixed grid: a
released value is one of the grid's, whatever the true value was, so its low bits tell nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 2.0**52


def seeded_uniform(*parts: Column) -> Column:
    """Repeatable uniform value in (0, 1) from a hash of the parts; tests only, the noise is guessable."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(_STEPS)


def laplace(scale: Column, uniform: Column | None = None) -> Column:
    """Inverse-CDF Laplace sample with mean 0; a fresh draw per row unless ``uniform`` is given."""
    centred = (F.rand() if uniform is None else uniform) - F.lit(0.5)
    # rand() may return 0 exactly; the floor keeps the logarithm finite.
    tail = F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(centred), F.lit(1.0 / _STEPS))
    return -scale * F.signum(centred) * F.log(tail)


def geometric(rate: Column, uniform: Column) -> Column:
    """Failures before the first success, where each of them has probability exp(-rate)."""
    return F.floor(-F.log(F.greatest(uniform, F.lit(0.5 / _STEPS))) / rate)


def discrete_laplace(rate: Column, first: Column | None = None, second: Column | None = None) -> Column:
    """Whole number z with probability proportional to exp(-rate * |z|): the difference of two geometric draws.

    Two fresh draws per row unless uniform values are given. The draws have 52 bits, so numbers rarer than that do not
    occur.
    """
    up = F.lit(1.0) - F.rand() if first is None else first
    down = F.lit(1.0) - F.rand() if second is None else second
    return geometric(rate, up) - geometric(rate, down)
