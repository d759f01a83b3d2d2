"""Rounding of a double's binary value (C17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the two parts into which the fraction is split.
HIGH, LOW = 35, 34


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with ``x`` computed once, however often it is used; else the
    generated code of a large ``x`` would not fit a method."""
    return F.get(F.transform(F.array(x), then), 0)


def round_binary(x: Column, places: int) -> Column:
    """``x`` (0 <= x < 2**38) rounded to at most 4 places, half to even, by its exact binary value.

    ``bround`` rounds the shortest decimal that names the double: 0.00015 is a tie to it,
    while the double itself lies below the tie (0.0001) and 0.03125 is one (0.0312).
    The fraction is cut into whole numbers of 35 and 34 bits, which loses no bit of a
    fraction above 2**-16, and smaller ones are far from half a unit; all
    further steps are on 64-bit integers.
    """
    if not 0 <= places <= 4:
        raise ValueError("0 to 4 places")
    unit = 10 ** places

    def cut(v: Column) -> Column:
        return F.struct(F.floor(v).alias("whole"), ((v - F.floor(v)) * F.lit(2.0 ** HIGH)).alias("scaled"))

    def doubled(p: Column) -> Column:
        # Twice the fraction in units, as (high + low / 2**LOW) / 2**HIGH.
        low = F.floor((p["scaled"] - F.floor(p["scaled"])) * F.lit(2.0 ** LOW)) * F.lit(2 * unit)
        high = F.floor(p["scaled"]) * F.lit(2 * unit) + F.shiftright(low, LOW)
        below = p["whole"] * F.lit(unit) + F.shiftright(high, HIGH + 1)
        return F.struct(below.alias("below"), high.bitwiseAND(F.lit((1 << (HIGH + 1)) - 1)).alias("rest"),
                        low.bitwiseAND(F.lit((1 << LOW) - 1)).alias("low"))

    def nearest(r: Column) -> Column:
        half = F.lit(1 << HIGH)
        up = (r["rest"] > half) | ((r["rest"] == half) & ((r["low"] > 0) | (r["below"] % 2 == 1)))
        return (r["below"] + up.cast("long")).cast("double") / F.lit(float(unit))

    return _once(_once(_once(x, cut), doubled), nearest)
