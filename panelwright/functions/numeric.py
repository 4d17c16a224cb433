"""Numeric expressions that give, bit for bit, what IEEE arithmetic with exact rounding gives.

Spark's ``round`` and ``bround`` round the shortest decimal form of a double. Here the exact binary
value is rounded, ties to even, so that 2.675 at two places is 2.67. Comparisons treat NaN as equal
to nothing and larger than nothing. All of it stays within generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 134217729.0


def finite(x: Column) -> Column:
    """True for numbers other than NaN and the infinities; false for null."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def py_round(x: Column, places: int) -> Column:
    """``x`` rounded to ``places``; null, NaN and infinities pass through.

    Only where the product with the scale ends on a half can its own rounding have hidden on which side of
    the half ``x`` is. There the product's error, found by splitting ``x`` in two, decides; without one it is a tie.
    """
    scale = F.lit(10.0**places)
    product = x * scale
    split = F.lit(SPLITTER) * x
    high = split - (split - x)
    error = (high * scale - product) + (x - high) * scale
    near = F.rint(product)
    half = F.abs(product - near) == F.lit(0.5)
    # adding zero turns a negative zero into a positive one
    return F.when(half, F.rint(product + F.signum(error) * F.lit(0.25))).otherwise(near) / scale + F.lit(0.0)


def larger(a: Column, b: Column) -> Column:
    """``b`` if it is larger than ``a``, else ``a``: NaN first stays NaN, NaN second is passed over; null gives null."""
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a) | F.isnan(b), a).when(b > a, b).otherwise(a)


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a) | F.isnan(b), a).when(b < a, b).otherwise(a)


def clamp(x: Column, low: float, high: float) -> Column:
    """NaN and null pass through."""
    return F.when(x < low, F.lit(low)).when((x > high) & ~F.isnan(x), F.lit(high)).otherwise(x)


def floor_mod(x: Column, n: float) -> Column:
    """The remainder with the sign of ``n``."""
    return F.pmod(x, F.lit(n))


def at_least(x: Column, limit: float) -> Column:
    """``x >= limit``, false for NaN."""
    return ~F.isnan(x) & (x >= limit)


def more_than(x: Column, limit: Column | float) -> Column:
    """``x > limit``, false if either is NaN."""
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return ~F.isnan(x) & ~F.isnan(limit) & (x > limit)


def fixed(x: Column, places: int) -> Column:
    """Text with ``places`` decimals, exact ties to even."""
    return F.format_string(f"%.{places}f", py_round(x, places))


def percent(x: Column, places: int) -> Column:
    return F.concat(fixed(x * F.lit(100.0), places), F.lit("%"))


#: Powers of ten that are exact doubles.
_EXACT_TENS = tuple(float(10**k) for k in range(23))


def significant(x: Column, digits: int) -> Column:
    """Text with ``digits`` significant digits like C's %g: no trailing zeros, an exponent below -4 and from ``digits`` on.

    The exact value is rounded, ties to even. Java's decimal format does that but for whole numbers halfway between two results,
    which are therefore rounded before. Numbers below 1e-300 may show fewer digits than they have. Null stays null.
    """
    size = F.abs(x)
    place = F.floor(F.log10(size)).cast("int") + (1 - digits)
    step = F.get(F.array(*[F.lit(t) for t in _EXACT_TENS]), F.when(place.between(0, len(_EXACT_TENS) - 1), place))
    rest = size % step
    whole = (size - rest) / step
    even = F.when(rest * 2 == step, F.signum(x) * (whole + whole % 2) * step).otherwise(x)
    text = F.call_function("format_number", even, F.lit("0." + "#" * (digits - 1) + "E0"))
    # named once, used many times
    shown = F.get(F.transform(F.array(text), lambda t: _as_g(t, digits)), F.lit(0))
    return F.when(F.isnan(x), "nan").when(size == F.lit(math.inf), F.when(x > 0, "inf").otherwise("-inf")).when(x.isNotNull(), shown)


def _as_g(text: Column, digits: int) -> Column:
    """From a number in the form -1.234E5."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    figures = F.regexp_replace(F.substring_index(text, "E", 1), "[-.]", "")
    power = F.substring_index(text, "E", -1).cast("int")
    rest = lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("."), t))
    plain = F.when(
        power >= 0,
        F.concat(F.rpad(figures.substr(F.lit(1), power + 1), power + 1, F.lit("0")), rest(figures.substr(power + 2, F.lit(digits)))),
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures))
    exponent = F.abs(power).cast("string")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(exponent, F.greatest(F.lit(2), F.length(exponent)), F.lit("0")))
    scientific = F.concat(F.substring(figures, 1, 1), rest(figures.substr(F.lit(2), F.lit(digits))), exponent)
    return F.concat(sign, F.when(power.between(-4, digits - 1), plain).otherwise(scientific))
