"""Rounding and number text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 2) -> Column:
    """Round half towards +infinity on doubles; ``round`` differs on ties and on values like 1.005."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(x: Column) -> Column:
    """Into [0, 100]; ``least`` and ``greatest`` alone would turn NULL into a bound."""
    return F.when(x < 0, F.lit(0.0)).when(x > 100, F.lit(100.0)).otherwise(x)


def scaled_to_range(x: Column, low: Column, high: Column) -> Column:
    """0-100 position of ``x`` in [low, high]; 50 where the range is missing or flat."""
    no_range = low.isNull() | high.isNull() | (low == high)
    return F.when(no_range, F.lit(50.0)).otherwise(
        clamp((x - low) / F.nullif(high - low, F.lit(0.0)) * 100.0)
    )


def discount_pct(price: Column, mrp: Column) -> Column:
    usable = (mrp > 0) & (price <= mrp)
    return F.when(usable, F.floor((mrp - price) / F.nullif(mrp, F.lit(0.0)) * 10000.0 + 0.5).cast("double") / 100.0)


def text(x: Column, digits: int = 10) -> Column:
    """Shortest plain decimal: 5, 4.1, -33.33 — never 5.0 or 1.0E7."""
    full = x.cast(f"decimal(30,{digits})").cast("string")
    return F.when(full.contains("."), F.regexp_replace(full, r"\.?0+$", "")).otherwise(full)


def grouped(x: Column) -> Column:
    """Indian digit grouping with at most three decimals: 123456.5 -> 1,23,456.5."""
    plain = text(half_up(x, 3), 3)
    whole = F.substring_index(plain, ".", 1)
    fraction = F.when(plain.contains("."), F.concat(F.lit("."), F.substring_index(plain, ".", -1))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(whole, r"(\d)(?=(\d\d)+\d$)", "$1,"), fraction)


def rupees(x: Column, missing: str) -> Column:
    return F.coalesce(F.concat(F.lit("₹"), grouped(x)), F.lit(missing))
