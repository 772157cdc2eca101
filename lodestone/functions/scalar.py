"""Rounding and quantising of output values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(value: Column, low: Column, high: Column, bits: int) -> Column:
    """Value between low and high as an unsigned integer of so many bits; 0 without a width."""
    top = float((1 << bits) - 1)
    return F.when(high > low, F.floor((value - low) / (high - low) * top + 0.5)).otherwise(0).cast("int")


def rounded_outward(low: Column, high: Column) -> tuple[Column, Column]:
    """A box's side moved out to a power-of-ten grid of about six digits of its size."""
    digits = F.least(F.lit(9), F.greatest(F.lit(0), 6 - F.floor(F.log10(high - low)))).cast("double")
    scale = F.pow(F.lit(10.0), digits)
    return F.floor(low * scale) / scale, F.ceil(high * scale) / scale


def five_digits(value: Column) -> Column:
    return F.format_string("%.4e", value.cast("double")).cast("double")


FRACTION_BITS = 12  # at most
LARGEST = (1 << 23) - 1  # of a signed 24-bit number


def fraction_bits(most: Column) -> Column:
    """The most fractional bits, up to FRACTION_BITS, with which a signed 24-bit number holds ``most``; null if none does."""
    fits = lambda bits: F.floor(most * float(1 << bits) + 0.5) <= LARGEST
    return F.coalesce(*(F.when(fits(bits), F.lit(bits)) for bits in range(FRACTION_BITS, -1, -1)))


def zigzag(value: Column) -> Column:
    return F.when(value >= 0, value * 2).otherwise(-2 * value - 1)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))
