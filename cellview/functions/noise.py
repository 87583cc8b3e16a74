"""Keyed random columns.

Every draw is a pure function of a key: ``u = (h + 0.5) / 2**52`` where ``h``
is the first 13 hex digits of SHA-256 over the key text.  A retried or
speculative task therefore redraws the same value, and the result does not
depend on how rows are partitioned, which ``rand()`` cannot promise.  The seed
inside the key is the secret of a release.

Draws are rounded to ``DIGITS`` decimals so that they compare equal across
engines.  Rounding narrows, but does not close, the known leak through the low
bits of floating-point noise; ``discrete_laplace`` draws integers instead.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
TWO_52 = 4503599627370496.0


def _column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def key_of(*parts) -> Column:
    """Join key parts with ``|``; plain Python values become literals, one for each run of them."""
    runs = groupby(parts, lambda p: isinstance(p, Column))
    joined = [x for columns, run in runs for x in (run if columns else ["|".join(map(str, run))])]
    return F.concat_ws("|", *[_column(p).cast("string") for p in joined])


def unit(*key) -> Column:
    """Uniform draw in the open interval (0, 1)."""
    head = F.substring(F.sha2(key_of(*key), 256), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_52)


def rounded(u: Column, digits: int) -> Column:
    """``round(u, digits)`` of draws in (0, 1), to at most 9 digits.

    Spark rounds a double by way of its decimal text.  A draw that is clear of the middle between two
    decimals gets the same one from its number, and only one in 50,000 goes by the text.  ``u`` is read
    several times and should be a column, not the draw itself.
    """
    if not 0 <= digits <= 9:
        raise ValueError("digits must be between 0 and 9")
    power = F.lit(float(10**digits))
    near = u * power + F.lit(0.5)
    return F.when((near - F.floor(near)).between(1e-5, 1 - 1e-5), F.floor(near) / power).otherwise(F.round(u, digits))


def settle(c: Column, digits: int = DIGITS) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(c, digits) + F.lit(0.0)


def laplace(scale, *key) -> Column:
    x = unit(*key) - F.lit(0.5)
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return settle(-scale * F.signum(x) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(x)))


def gumbel(*key) -> Column:
    return -F.log(-F.log(unit(*key)))


def exponential(rate: float, *key) -> Column:
    return settle(-F.log(F.lit(1.0) - unit(*key)) / F.lit(float(rate)))


def gaussian(mean: float, std: float, *key) -> Column:
    """Box-Muller on two independent keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(unit(*key, "radius")))
    angle = F.cos(F.lit(2.0 * math.pi) * unit(*key, "angle"))
    return settle(F.lit(float(mean)) + F.lit(float(std)) * radius * angle)


def uniform_real(low: float, high: float, *key) -> Column:
    return settle(F.lit(float(low)) + F.lit(float(high - low)) * unit(*key))


def uniform_int(low, high, *key) -> Column:
    """Integer in ``low .. high-1``; bounds may be columns."""
    low = low if isinstance(low, Column) else F.lit(int(low))
    high = high if isinstance(high, Column) else F.lit(int(high))
    return (low + F.floor(unit(*key) * (high - low))).cast("int")


def sign(*key) -> Column:
    return F.lit(2) * uniform_int(0, 2, *key) - F.lit(1)


def geometric(p: float, *key) -> Column:
    """Failures before the first success (0, 1, 2, ...)."""
    return F.floor(F.log(F.lit(1.0) - unit(*key)) / F.lit(math.log(1.0 - p))).cast("bigint")


def discrete_laplace(scale: float, *key) -> Column:
    """Two-sided geometric integer noise."""
    alpha = math.exp(-1.0 / scale)
    stay = unit(*key, "stay") < F.lit((1.0 - alpha) / (1.0 + alpha))
    step = geometric(1.0 - alpha, *key, "step") + F.lit(1)
    return F.when(stay, F.lit(0).cast("bigint")).otherwise(sign(*key, "side") * step)


def cauchy(scale: float, *key) -> Column:
    return settle(F.lit(float(scale)) * F.tan(F.lit(math.pi) * (unit(*key) - F.lit(0.5))))


def utility(score, epsilon, sensitivity, *key) -> Column:
    """Gumbel-perturbed score whose arg-max is the exponential mechanism.

    A sensitivity of zero means "all candidates alike" and keeps the draw only.
    """
    score = score if isinstance(score, Column) else F.lit(float(score))
    epsilon = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    sensitivity = sensitivity if isinstance(sensitivity, Column) else F.lit(float(sensitivity))
    weight = F.when(sensitivity > 0, epsilon * score / (F.lit(2.0) * sensitivity)).otherwise(F.lit(0.0))
    return settle(weight + gumbel(*key))
