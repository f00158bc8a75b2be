"""Ratios without ANSI division errors, and decimal display of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def ratio_or_nan(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(float("nan")))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when(a + b == 0.0, F.lit(0.0)).otherwise(F.try_divide(F.lit(2.0) * a * b, a + b))


def fixed_decimals(value: Column, decimals: int) -> Column:
    """Text with ``decimals`` places, rounded on the exact binary value, half to even.

    The built-in formatter rounds the shortest decimal text instead and so moves
    ties.  Here the value is split into a 24-bit head and an exact tail, which
    makes the distance to the rounding point exact for display-sized numbers.
    From 2**53 / 10**decimals on, the whole part is taken apart exactly (below 2**106, about 8e31) and the
    fraction has so few bits that its product with the scale is exact.  Null stays null; infinity prints as ``inf``.
    """
    scale = float(10 ** decimals)
    size = F.abs(value)
    head = size.cast("float").cast("double")
    tail = size - head
    low = F.floor(size * scale).cast("double")
    over = (head * scale - low - 0.5) + tail * scale
    units = F.when((over > 0) | ((over == 0) & (low % 2 == 1)), low + 1).otherwise(low)
    text = F.format_string(f"%.{decimals}f", units / scale)
    safe = F.when(size < 2.0 ** 106, size)
    high = F.floor(safe / 2.0 ** 53)
    rest = safe - high * 2.0 ** 53
    part = F.bround((rest - F.floor(rest)) * scale, 0).cast("long")
    carry = F.when(part == 10 ** decimals, 1).otherwise(0)
    whole = high.cast("decimal(19,0)") * F.lit(2 ** 53).cast("decimal(16,0)") + (F.floor(rest) + carry).cast("decimal(19,0)")
    digits = F.lpad(F.when(carry == 1, 0).otherwise(part).cast("string"), decimals, "0")
    large = F.concat(whole.cast("string"), F.lit("." if decimals else ""), digits if decimals else F.lit(""))
    large = F.coalesce(large, F.format_string(f"%.{decimals}f", size))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(value.isNull(), F.lit(None).cast("string")).when(F.isnan(value), F.lit("nan"))
            .when(size == float("inf"), F.concat(sign, F.lit("inf")))
            .when(size >= 2.0 ** 53 / scale, F.concat(sign, large)).otherwise(F.concat(sign, text)))
