"""Decimal rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_BITS = 56
_SMALL_BITS = 60


def exact_round(value: Column, digits: int) -> Column:
    """Round to 1 or 2 digits by the exact binary value of a double.

    ``round`` and ``bround`` first print the double in decimal, so 98.695 (which
    is a little below in binary) would go up.  Here the fraction is scaled to a
    whole number of 2**-56 and rounded in BIGINT arithmetic.  That is exact from
    1/16 on; below, 2**-60 is, down to 1/256, and what is less rounds to zero.
    """
    ten = 10**digits
    whole = F.floor(value)
    fraction = value - whole
    steps = F.when(fraction < 1 / 16, _steps(fraction, _SMALL_BITS, ten)).otherwise(_steps(fraction, _BITS, ten))
    return (whole * ten + steps).cast("double") / F.lit(float(ten))


def _steps(fraction: Column, bits: int, ten: int) -> Column:
    scaled = (fraction * F.lit(float(1 << bits))).cast("bigint") * F.lit(ten)
    # half a step up, less one unit where the step below is even: half goes to even
    odd = F.shiftright(scaled, bits).bitwiseAND(F.lit(1).cast("bigint"))
    return F.shiftright(scaled + F.lit((1 << (bits - 1)) - 1) + odd, bits)


def fixed_text(value: Column, digits: int) -> Column:
    """The rounded value with all its digits; a decimal prints faster than a format."""
    return exact_round(value, digits).cast(f"decimal(30,{digits})").cast("string")
