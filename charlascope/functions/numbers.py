"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary places kept of the fraction: exact for every value of at least 2^-8, and smaller ones round to zero anyway.
_PLACES = 60


def round_half_even(value: Column, digits: int = 2) -> Column:
    """``value`` rounded to ``digits`` (1 or 2) decimals by its exact binary value; exact ties go to the even digit.

    0.985 is slightly less than its decimal text says and becomes 0.98; 0.125 is a tie and becomes 0.12. The fraction is
    turned into a whole number of 2^-60 without loss, so all comparisons are between whole numbers. Values so large that
    neighbouring doubles lie further apart than a step, infinities, NaN and null stay as they are.
    """
    steps = 10**digits
    limit = 2.0 ** (53 - math.ceil(math.log2(steps)))
    small = F.abs(value) < limit
    size = F.when(small, F.abs(value)).otherwise(0.0)
    whole = F.floor(size)
    units = ((size - whole.cast("double")) * 2.0**_PLACES).cast("bigint").cast("decimal(19,0)") * F.lit(Decimal(steps))
    one = F.lit(Decimal(2**_PLACES))
    down, rest = F.call_function("div", units, one), units % one
    half = F.lit(Decimal(2 ** (_PLACES - 1)))
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    rounded = (whole * steps + down + up.cast("bigint")).cast("double") / float(steps)
    return F.when(small, F.when(value < 0, -rounded).otherwise(rounded)).otherwise(value)
