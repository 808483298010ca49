"""Column helpers for numbers: reproducible rounding and random draws."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wide enough for sums of prices, with digits to spare below every rounding in use.
EXACT = "decimal(28,12)"


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded half up in decimal, so that engines agree on values beside a tie.

    Away from a tie the nearest whole number of units is the same one, without decimals.
    A double from 2**53 on has no fraction and stays as it is; it may be too large for a
    decimal.  NaN and infinity give NULL.
    """
    c = F.col(c) if isinstance(c, str) else c
    whole = F.abs(c).between(float(1 << 53), sys.float_info.max)
    exact = F.when(whole, c.cast("double")).otherwise(F.round(c.cast(EXACT), digits).cast("double"))
    if digits > 8:  # the last digits of EXACT are too near
        return exact
    scaled = c * F.lit(float(10**digits))
    nearest = F.floor(scaled + 0.5)
    clear = (F.abs(scaled) < float(1 << 40)) & (F.abs(scaled - nearest) < 0.499)
    return F.when(clear, nearest / F.lit(float(10**digits))).otherwise(exact)


def uniform(seed: int | Column, *keys: Column | str) -> Column:
    """A draw from [0, 1) that depends on seed and keys alone, not on partitions."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.shiftrightunsigned(F.xxhash64(seed, *keys), 11) / F.lit(float(1 << 53))


def normal(seed: int | Column, *keys: Column | str) -> Column:
    """A standard normal draw (Box-Muller) that depends on seed and keys alone."""
    radius = F.sqrt(-2 * F.log(1 - uniform(2 * seed, *keys)))
    return radius * F.cos(2 * F.pi() * uniform(2 * seed + 1, *keys))
